"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that separate words under the rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same set.
WHITE_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind a URI or an absolute path."""
    return pafs.FileSystem.from_uri(uri)


def unique_name(suffix: str) -> str:
    """A file name that no other task attempt uses; only attempts that succeed report theirs."""
    return f"{uuid.uuid4().hex}{suffix}"


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


#: What clears the things that a stage keeps in its worker process across tasks, as a tokenizer with its cache.
KEPT: list[Callable[[], None]] = []


def give_back(kept: bool = False) -> None:
    """Return what this process has freed to the system: by itself, neither the C library nor Arrow does so soon.

    With ``kept``, what other stages keep here across their tasks is dropped first.
    """
    if kept:
        for clear in KEPT:
            clear()
    gc.collect()
    trim()


def trim() -> None:
    """The same without looking for cycles, which takes as long as all objects of the process, for what has none."""
    pa.default_memory_pool().release_unused()
    if (call := _trim()) is not None:
        call(0)


@lru_cache(maxsize=1)
def set_aside() -> None:
    """Leave out of all later searches for cycles what a worker holds before the rows of its first task.

    That is modules, for the most part: going through them took longer than most tasks of a small table.
    """
    gc.freeze()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that holds nothing of the worker's earlier tasks, and leaves nothing to later ones.

    Spark keeps workers from stage to stage, beside the JVM in the same memory, and drops a stage's broadcasts in them only
    as the next task begins. Only a stage that says ``keep`` finds what its earlier tasks have kept.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_aside()
        give_back(not keep)
        yield from run(batches)
        give_back()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def texts_in(column: pa.Array) -> list[str]:
    """The column's strings, with nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive parts (from, to, strings) of a column with at most ``most`` bytes each, or one larger text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, b, texts_in(column[a:b])


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``most`` at most, or that hold one larger item."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1
