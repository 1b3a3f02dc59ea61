"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Normalised text is the sequence of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, joined by single
spaces. A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The
automaton holds every window between two spaces, so a match starts and ends at word borders. Each text is read once;
matches map back to word numbers and to character offsets of the original text.

The automaton is broadcast, so its size is checked: items are dealt into groups of at most ``MAX_ITEM_BYTES`` of text,
and each group has an automaton of its own. All automata run over a text in the same pass and task.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no windows; repeated item
ids count once, null ids as the text ``null``; an empty document or item table gives no rows or no hits; further columns
of either table are ignored, those of documents are kept by ``clean_documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

WINDOW = 13
#: Bytes of item text behind one broadcast automaton.
MAX_ITEM_BYTES = 8 << 20
#: More item text than this in all is refused: the benchmark would no longer be small beside an executor.
MAX_TOTAL_BYTES = 128 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item_id", T.StringType())]))
HITS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]


def normalise(text: str) -> tuple[bytes, list[bytes]]:
    """The text's bytes with separators blanked, and its words."""
    blanked = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    return blanked, blanked.split()


@dataclass
class Windows:
    """An automaton's patterns: ``keys`` (latin-1 strings of UTF-8 bytes), their word counts and item numbers."""

    keys: list[str]
    lengths: list[int]
    items: list[list[int]]


def windows_of(items: list[tuple[str, str | None]], window: int) -> tuple[Windows, list[str]]:
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    found: dict[str, tuple[int, set[int]]] = {}
    for name, text in items:
        words = normalise(text or "")[1]
        size = min(window, len(words))
        for a in range(len(words) - size + 1 if size else 0):
            key = (b" " + b" ".join(words[a : a + size]) + b" ").decode("latin-1")
            found.setdefault(key, (size, set()))[1].add(number[name])
    keys = list(found)
    return Windows(keys, [found[k][0] for k in keys], [sorted(found[k][1]) for k in keys]), names


_automata: dict[str, list] = {}


def _automaton(groups: list[tuple[Windows, list[str]]], token: str) -> list:
    """Built once per worker process and broadcast."""
    import ahocorasick

    if token not in _automata:
        _automata.clear()
        built = []
        for windows, names in groups:
            a = ahocorasick.Automaton()
            for i, key in enumerate(windows.keys):
                a.add_word(key, i)
            if len(windows.keys):
                a.make_automaton()
            built.append((a if windows.keys else None, windows, names))
        _automata[token] = built
    return _automata[token]


def scan(text: str, automata: list, spans: bool) -> tuple[int, int, list[str], list[tuple[int, int, str]]]:
    """Words, hit words, items with occurring windows and, if asked for, (start, end, item) in characters of ``text``."""
    blanked, words = normalise(text)
    if not words:
        return 0, 0, [], []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    matches = [(k, end, i) for k, (a, _, _) in enumerate(automata) if a is not None for end, i in a.iter(line)]
    if not matches:
        return len(words), 0, [], []
    ends = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype="u1") == 32)[1:]  # of word i, the space after it
    last = np.searchsorted(ends, np.array([m[1] for m in matches]))
    size = np.array([automata[k][1].lengths[i] for k, _, i in matches])
    edge = np.bincount(last - size + 1, minlength=len(words) + 1) - np.bincount(last + 1, minlength=len(words) + 1)
    hit = int((np.cumsum(edge[: len(words)]) > 0).sum())
    items = sorted({automata[k][2][n] for k, _, i in matches for n in automata[k][1].items[i]})
    found = []
    if spans:
        raw = np.frombuffer(blanked, dtype="u1")
        filled = np.concatenate([[False], raw != 32, [False]])
        starts, stops = np.flatnonzero(~filled[:-1] & filled[1:]), np.flatnonzero(filled[:-1] & ~filled[1:])
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
        for (k, _, i), w, n in zip(matches, last.tolist(), size.tolist(), strict=True):
            at = int(chars[starts[w - n + 1]]), int(chars[stops[w]])
            found += [(*at, automata[k][2][m]) for m in automata[k][1].items[i]]
    return len(words), hit, items, sorted(set(found))


def hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, spans: bool = False, into: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, n_items, items and, with ``spans``, spans. No shuffle.

    A column of ``docs`` that has that name already is replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("text")).where("text is not null")
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > MAX_TOTAL_BYTES:
        raise ValueError(f"{total} bytes of benchmark text exceed {MAX_TOTAL_BYTES}; scan it in several calls")
    groups, group, size = [], [], 0
    for row in named.orderBy("name", "text").toLocalIterator():
        group.append((row["name"], row["text"]))
        size += len(row["text"].encode())
        if size >= MAX_ITEM_BYTES:
            groups, group, size = [*groups, windows_of(group, window)], [], 0
    shared, token = spark.sparkContext.broadcast([*groups, windows_of(group, window)]), uuid.uuid4().hex
    fields = [*HITS, T.StructField("spans", SPANS)] if spans else HITS
    kind = T.StructType(fields)

    @F.pandas_udf(kind)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = _automaton(shared.value, token)
        for batch in batches:
            rows = [scan(x or "", automata, spans) for x in batch]
            columns = {"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "n_items": [len(r[2]) for r in rows], "items": [r[2] for r in rows]}
            if spans:
                columns["spans"] = [[{"start": a, "end": b, "item_id": n} for a, b, n in r[3]] for r in rows]
            yield pd.DataFrame(columns)

    return docs.withColumn(into, scanned.asNondeterministic()(F.col(text)))  # else a filter on it would run it twice


def is_contaminated(hit: Column, words: Column) -> Column:
    """A twentieth or more of the words lie in windows."""
    return (hit > 0) & (20 * hit >= words)


def clean_documents(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with the same columns."""
    seen = hits(docs, items, into="_benchmark_hits", **how)
    kept = seen.where(~is_contaminated(F.col("_benchmark_hits.n_hit"), F.col("_benchmark_hits.n_words")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
