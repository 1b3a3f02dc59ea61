"""Word-shingle sets of whole texts as sorted unsigned 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A set holds the hashes of all runs of ``width`` words; with fewer
words, of the whole sequence; without words it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import WHITE_SPACE, mix64, slices

WIDTH = 5
BATCH_BYTES = 250_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and hashes of the words in lower-cased bytes."""
    raw = np.frombuffer(data, dtype="u1")
    word = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view("i1")))
    starts, ends = edge[::2], edge[1::2]
    powers, inverses = _powers_to(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], dtype=np.uint64)])
        return starts, mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str], width: int = WIDTH) -> Iterator[np.ndarray]:
    encoded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    for a, b in slices(map(len, encoded), BATCH_BYTES):
        own = encoded[a:b]
        starts, words = word_hashes(b"\n".join(own))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(e) + 1 for e in own)]))
        rolled = words.copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                rolled = mix64(rolled)
                rolled[: len(words) - k] += words[k:]
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            n = hi - lo
            if n >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif n:
                h = np.array([n], dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for w in words[lo:hi]:
                        h = mix64(h + w)
                yield h
            else:
                yield np.zeros(0, dtype=np.uint64)
