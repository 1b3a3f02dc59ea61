"""Token ids by the ``tokenizers`` library, with a bounded cache of word chunks.

A byte-level BPE never joins a character and a white-space character after it. So where a single space or line feed
stands between two characters that aren't white space, a text may be cut before it and its parts encoded alone. Each
distinct part is encoded by the library once, together with the other new ones of its batch, and then looked up. A text
with any other white space at such a cut is encoded whole. Where the library parts letters from signs, as the usual
pattern does, a new word with signs after it is its letters, encoded or looked up, and its signs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np

from . import common  # sets TOKENIZERS_PARALLELISM, too

CACHE_ENTRIES = 700_000
#: Slots that remember by hash which chunks came before: only those that come again stay in the cache.
SLOTS = 1 << 24
LONGEST_CACHED = 48
#: Signs that may end a word, and the end of the letters that every Unicode version takes for letters.
ENDS, OLD_LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "\u0220"


class ChunkTokenizer:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self._entries = cache_entries
        self._cache: dict[str, bytes | None] = {}
        self._met = np.zeros(SLOTS, dtype=bool)
        pattern = self._tokenizer.pre_tokenizer
        self._ends = ENDS if pattern is not None and [p for p, _ in pattern.pre_tokenize_str(f" ab{ENDS}")] == ["Ġab", ENDS] else ""
        self._starts = {}  # the ids of tokens that begin with a space or a line feed, as the vocabulary spells them
        for sign, spelt in ((" ", "Ġ"), ("\n", "Ċ")):
            self._starts[sign] = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self._starts[sign][[i for token, i in vocabulary.items() if token.startswith(spelt)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in encoded]

    def _encode_chunks(self, chunks: list[str], sign: str) -> list[bytes]:
        """Encode chunks, each with ``sign`` first and nowhere else, as one text; each begins at a token with ``sign``."""
        if not chunks:
            return []
        ids = np.array(self._tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        at = np.flatnonzero(self._starts[sign][ids])
        if len(at) != len(chunks) or at[0]:
            return self._encode(chunks)
        data, edges = ids.tobytes(), (np.append(at, len(ids)) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """Each text's ids, little-endian in ``dtype``, with the id ``end`` after them if it is given."""
        cache = self._cache
        if len(cache) > self._entries:
            cache.clear()
            self._met[:] = False
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        new = list(set().union(*parts).difference(cache))
        whole = [p for p in new if p and not p[-1].isspace()]
        spaced = [p for p in whole if not p[0].isspace()]
        lined = [p for p in whole if p[0] == "\n" and not p[1].isspace()]
        ended = [(p, s) for p, s in zip(spaced, map(str.rstrip, spaced, repeat(self._ends)), strict=True) if len(s) < len(p) and s.isalpha() and s[-1] < OLD_LETTERS]
        cache.update(dict.fromkeys(new))  # None: can't stand alone
        if ended:
            stems = {s for _, s in ended}.difference(cache)
            spaced = [*set(spaced).difference([p for p, _ in ended]), *stems]
            new += stems
        cache.update(zip(spaced, self._encode_chunks([" " + p for p in spaced], " "), strict=True))
        cache.update(zip(lined, self._encode_chunks(lined, "\n"), strict=True))
        if ended:
            tails = list({p[len(s) :] for p, s in ended})
            ids_of = dict(zip(tails, self._encode(tails), strict=True))
            cache.update([(p, cache[s] + ids_of[p[len(s) :]]) for p, s in ended])
        heads = self._encode([p[0] for p in parts])
        last = b"" if end is None else np.array([end], dtype=self.dtype).tobytes()
        out: list[bytes] = []
        for text, words, head in zip(texts, parts, heads, strict=True):
            try:
                if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                    raise TypeError
                ids = b"".join([head, *map(cache.__getitem__, words[1:]), last])
            except TypeError:  # a part that can't stand alone
                ids = self._encode([text])[0] + last
            out.append(ids)
        slots = np.fromiter(map(hash, new), dtype=np.int64, count=len(new)) % SLOTS
        for p, again in zip(new, self._met[slots].tolist(), strict=True):
            if not again or len(p) > LONGEST_CACHED:
                del cache[p]
        self._met[slots] = True
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, so that its cache lives across tasks, until a stage that has no use for it."""
    return ChunkTokenizer(path)


common.KEPT.append(tokenizer.cache_clear)
