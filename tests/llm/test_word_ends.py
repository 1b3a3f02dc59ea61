"""A new word with signs after it is encoded as its letters and its signs, with the library's ids."""

import numpy as np
import pytest

from sparkwave.llm.op10_token_ids import tokenizer_file
from sparkwave.llm.tokenize import ENDS, ChunkTokenizer


@pytest.fixture(scope="module")
def tok():
    return ChunkTokenizer(tokenizer_file())


def test_letters_are_encoded_once_for_all_signs(tok, monkeypatch):
    given, real = [], tok._encode_chunks
    monkeypatch.setattr(tok, "_encode_chunks", lambda chunks, sign: given.extend(chunks) or real(chunks, sign))
    tok.encode(["a " + " ".join(f"Zwölfboxkämpfer{e}" for e in (".", ",", "!!", "###", "", ");"))])
    assert [g for g in given if "kämpfer" in g] == [" Zwölfboxkämpfer"]


@pytest.mark.parametrize("seed", range(6))
def test_ids_are_the_librarys(tok, seed):
    rng = np.random.default_rng(seed)
    signs = [*ENDS, "'", "'s", "’", "1", "ǅ", "ʰ", "ß", "é", "é", "ͅ", "一", "Ⅷ", "ª", " ", "　", "\n", "\t", "  ", "<|endoftext|>", "\U0001f600"]
    texts = []
    for _ in range(200):
        words = ["".join(rng.choice(["ab", "Haus", "été", *signs], rng.integers(1, 5))) + "".join(rng.choice(signs, rng.integers(0, 4))) for _ in range(rng.integers(1, 12))]
        texts.append(" ".join(words))
    wanted = [np.array(e.ids, dtype=tok.dtype).tobytes() for e in tok._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tok.encode(texts) == wanted and tok.encode(texts) == wanted
