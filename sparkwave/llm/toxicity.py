"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are whole words: each run of letters and digits, lower-cased. Vectors are (1 + log tf) * idf over all terms of a text,
normalised; idf is 1 + log((1 + rows) / (1 + rows with the term)), so a term that no example has weighs most and shortens
all of a text's cosines.

The model is fitted on a bounded sample of the labelled rows: of the different texts of each label those with the smallest
digests, ``MAX_EXAMPLES`` as examples, and ``DRAWN`` times as many for the rows with a term, each text standing for all its
rows and for as many more as its label has for each that is drawn. Copies so take one place, and their number is the text's
weight in votes and in calibration. The inverted index keeps a term's
postings in order of example number, in blocks with the largest weight of each block. A query takes its terms by falling
upper bound, some at a time; once the bounds of the terms still to come leave few examples that can reach the k-th best
score, only blocks that hold such an example and whose maximum could still lift it are read, so the k nearest are exact
(ties to the smaller example number).

The share of label 1 in the neighbours' votes, weighted by similarity and rows, is calibrated together with a second number:
the sum, over a text's terms, of how many standard deviations beyond ``SURE`` a term's rows of label 1 are from what chance
would give (its signed chi). A logistic function of both, fitted on the examples, each without its own rows and both labels weighing alike, is
mapped to a probability by isotonic bins. Texts without a term of the vocabulary get the share of label 1 among such
examples.

Defined cases: null and empty texts have no terms; rows with null or other labels, null keys and labels without a document
aren't examples; repeated rows count as often as they are there; with no examples at all the score is 0; further columns are
ignored, those of documents are kept, but for one that is named as the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship_package
from .common import give_back

MAX_EXAMPLES, DRAWN = 2000, 4
NEIGHBOURS = 15
BLOCK = 64
#: Terms that a query takes at a time, and the share of the examples that must be shut out before blocks are looked at.
GROUP, SHUT = 256, 0.75
SURE = 3.0
#: Characters of a text whose words are listed at a time.
PART = 1 << 16
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def word_counts(text: str) -> Counter:
    """The words of a text with their numbers; part by part, as the words of a very long text take many times its memory."""
    text, at, counts = text.lower(), 0, Counter()
    while at < len(text):
        end = at + PART
        if (rest := _WORD.match(text, end)) is not None:  # a word isn't cut
            end = rest.end()
        counts.update(_WORD.findall(text, at, end))
        at = end
    return counts


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [low, high), one range after the other."""
    sizes = high - low
    return np.repeat(high - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Index:
    """Postings by term: ``at[t]:at[t+1]`` of ``postings`` (docs, weights); a block's largest weight in ``block_max``."""

    terms: dict[str, int]
    idf: np.ndarray
    at: np.ndarray
    postings: np.ndarray
    block_at: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    labels: np.ndarray
    rows: np.ndarray

    def vector(self, counts: dict[int, int], rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights; ``rest`` is the sum of squares of terms that no example has."""
        return self.weighted(np.fromiter(counts, dtype=np.int64, count=len(counts)), np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), rest)

    def weighted(self, ids: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[ids]
        return ids, w / np.sqrt((w * w).sum() + rest)

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples but ``skip`` with a common term, and their cosines: exact, ties to smaller numbers."""
        bounds = w * self.term_max[ids]
        order = np.argsort(-bounds, kind="stable")
        ids, w, bounds = ids[order], w[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
        n, floor, open_ = len(self.labels), 0.0, None
        scores = np.zeros(n)
        for a in range(0, len(ids), GROUP):
            t, v, b = ids[a : a + GROUP], w[a : a + GROUP], min(a + GROUP, len(ids))
            if open_ is None:  # whole lists, which lie together
                low, high = self.at[t], self.at[t + 1]
                picked = np.concatenate([self.postings[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)])
            else:  # blocks that hold an example that can still enter
                sizes = self.block_at[t + 1] - self.block_at[t]
                block = _spans(self.block_at[t], self.block_at[t + 1])
                low = np.repeat(self.at[t], sizes) + (block - np.repeat(self.block_at[t], sizes)) * BLOCK
                high = np.minimum(low + BLOCK, np.repeat(self.at[t + 1], sizes))
                v, others = np.repeat(v, sizes), rest[a] - np.repeat(bounds[a:b], sizes)
                first, last = np.searchsorted(open_, self.postings[low, 0]), np.searchsorted(open_, self.postings[high - 1, 0], side="right")
                held = np.append(scores[open_], -np.inf)
                most = np.maximum.reduceat(held, np.stack([first, last], axis=1).ravel())[::2]
                can = (first < last) & (most + v * self.block_max[block] + others >= floor)
                v, low, high = v[can], low[can], high[can]
                picked = self.postings[_spans(low, high)]
            scores += np.bincount(picked[:, 0].astype(np.int64), picked[:, 1] * np.repeat(v, high - low), n)
            if skip >= 0:
                scores[skip] = 0.0
            if b < len(ids) and n > k:
                floor = max(floor, np.partition(scores, -k)[-k] - 1e-12)  # sums of the same terms in another order
                if rest[b] < floor:  # so an example without a term yet can't enter
                    left = np.flatnonzero(scores + rest[b] >= floor)
                    if len(left) <= (1 - SHUT) * n:
                        open_ = left
        seen = scores > 0
        found = np.flatnonzero(seen)
        best = found[np.lexsort((found, -scores[found]))][:k]
        return best, scores[best]

    def vote(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The vote for a vector without one row of ``skip``: its other rows are neighbours like any."""
        if not len(ids):
            return None, np.zeros(0, dtype=np.int64), np.zeros(0)
        alone = skip >= 0 and self.rows[skip] <= 1
        best, cosines = self.nearest(ids, w, k, skip if alone else -1)
        if not len(best):
            return None, best, cosines
        weights = cosines * (self.rows[best] - (best == skip))
        return float((weights * self.labels[best]).sum() / weights.sum()), best, cosines


def build_index(vocabulary: list[tuple[str, float]], examples: list[tuple[int, dict[str, int]]], rows: list[int] | None = None) -> Index:
    terms = {t: i for i, (t, _) in enumerate(vocabulary)}
    return index_of(terms, np.array([v for _, v in vocabulary]), [(y, *numbered(terms, counts.items())) for y, counts in examples], rows)


def numbered(terms: dict[str, int], counts: Iterable[tuple[str, int | str]]) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms by their numbers, and how often each is there: a small part of what its words take as strings."""
    pairs = np.array([(terms[t], int(n)) for t, n in counts], dtype=np.int32).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def index_of(terms: dict[str, int], idf: np.ndarray, examples: list[tuple[int, np.ndarray, np.ndarray]], rows: list[int] | None = None) -> Index:
    """``build_index`` of examples (label, numbers of terms, counts)."""
    labels = np.array([y for y, _, _ in examples], dtype=np.float64)
    index = Index(terms, idf, *(np.zeros(0),) * 5, labels, np.array(rows if rows else [1] * len(examples), dtype=np.float64))
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    vectors = [index.weighted(ids, counts) if len(ids) else none for _, ids, counts in examples]
    of = np.concatenate([none[0], *(ids for ids, _ in vectors)])
    docs = np.repeat(np.arange(len(examples)), [len(ids) for ids, _ in vectors])
    order = np.argsort(of, kind="stable")
    index.postings = np.stack([docs, np.concatenate([none[1], *(w for _, w in vectors)])], axis=1)[order]  # side by side, to be taken at once
    sizes = np.bincount(of, minlength=len(terms))
    index.at = np.append(0, np.cumsum(sizes))
    blocks = -(-sizes // BLOCK)
    index.block_at = np.append(0, np.cumsum(blocks))
    starts = np.repeat(index.at[:-1], blocks) + (np.arange(index.block_at[-1]) - np.repeat(index.block_at[:-1], blocks)) * BLOCK
    index.block_max = np.maximum.reduceat(index.postings[:, 1], starts) if len(starts) else none[1]
    index.term_max = np.zeros(len(terms))
    np.maximum.at(index.term_max, np.repeat(np.arange(len(terms)), blocks), index.block_max)
    return index


@dataclass
class Model:
    index: Index
    #: Rows of label 1, and all rows, with each term; of all terms together.
    with_term: np.ndarray
    rows: np.ndarray
    unseen: float
    #: Mean and deviation of the vote and the signs, and what the logistic function makes of them.
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    blank: float
    names: list

    def signs(self, ids: np.ndarray, label: int = 0, own: float = 0.0) -> float:
        """The sum of signed chi beyond ``SURE``, without ``own`` rows of ``label``."""
        return float(signed(self.with_term[ids] - own * np.array([label, 1]), self.rows - own * np.array([label, 1])).sum())

    def linear(self, vote: float | np.ndarray, signs: float | np.ndarray) -> float | np.ndarray:
        (m0, m1), (d0, d1) = self.scale
        return self.weights[0] * ((vote - m0) / d0) + self.weights[1] * ((signs - m1) / d1) + self.weights[2]

    def score(self, text: str, evidence: int = 0) -> tuple[float, list[tuple[str, float, int]]]:
        counts = word_counts(text)
        ids = np.fromiter(map(self.index.terms.get, counts, repeat(-1)), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        known = ids >= 0
        rest = float((((1 + np.log(times[~known])) * self.unseen) ** 2).sum())
        ids, w = self.index.weighted(ids[known], times[known], rest)
        vote, best, cosines = self.index.vote(ids, w, NEIGHBOURS)
        if vote is None:
            return self.blank, []
        raw = self.linear(vote, self.signs(ids))
        level = float(self.levels[np.searchsorted(self.edges, raw, side="right") - 1])
        return level, [(str(self.names[b]), float(c), int(self.index.labels[b])) for b, c in zip(best[:evidence], cosines[:evidence], strict=True)]


def signed(rows: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Of terms with (rows of label 1, rows): the standard deviations beyond ``SURE`` by which the label follows the term."""
    (n1, n), d1, d = every, rows[:, 0], rows[:, 1]
    apart = d1 * n - d * n1
    spread = d * (n - d) * n1 * (n - n1)
    chi = np.sqrt(n) * np.abs(apart) / np.sqrt(np.where(spread > 0, spread, np.inf))
    return np.sign(apart) * np.maximum(0.0, chi - SURE)


def logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``x`` and a constant, by Newton steps; the former are held down by one unit each."""
    x = np.column_stack([x, np.ones(len(x))])
    b, hold = np.zeros(3), np.diag([1.0, 1.0, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + hold, x.T @ (rows * (y - p)) - hold @ b)
    return b


def calibrate(raw: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps (lower edges and levels) by pooling adjacent violators, smoothed by half a row of each label.

    An edge lies midway between the values of the two steps that it parts: texts in a gap go to the nearer one.
    """
    edges, tops, sums, sizes = [], [], [], []
    for value in np.unique(raw):
        same = raw == value
        edges.append(float(value))
        tops.append(float(value))
        sums.append(float((labels[same] * rows[same]).sum()))
        sizes.append(float(rows[same].sum()))
        while len(sums) > 1 and sums[-2] / sizes[-2] >= sums[-1] / sizes[-1]:
            s, n = sums.pop(), sizes.pop()
            sums[-1] += s
            sizes[-1] += n
            edges.pop()
            del tops[-2]
    levels = (np.array(sums) + 0.5) / (np.array(sizes) + 1)
    between = [max((low + high) / 2, np.nextafter(low, high)) for low, high in zip(tops, edges[1:], strict=False)]
    return np.array([-np.inf, *between]), np.maximum.accumulate(levels)


def draw(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, digest, key, rows) of ``most`` different texts of each label at most, those with the smallest digests; and the
    number of all labelled rows by label. Documents go to Spark's join as keys and digests, no text is shuffled."""
    marked = labels.where(F.col(f"`{label}`").isin(0, 1)).where(F.col(f"`{key}`").isNotNull())
    marked = marked.groupBy(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).agg(F.count("*").alias("times"))
    light = docs.select(F.col(f"`{key}`").alias("key"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"))
    texts = materialise(light.join(marked, "key").groupBy("label", "digest").agg(F.sum("times").alias("rows"), F.min("key").alias("key")), "toxicity-texts")
    drawn = [texts.where(F.col("label") == y).orderBy("digest").limit(most) for y in (1, 0)]
    return materialise(drawn[0].unionByName(drawn[1]), "toxicity-drawn"), {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.sum("rows").alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES) -> Model:
    """A model of a bounded sample of the labelled documents. ``max_examples`` bounds the different texts by label; the rows
    with a term are those of ``DRAWN`` times as many texts. Documents are read twice and not shuffled."""
    ship_package(docs.sparkSession)
    drawn, every = draw(docs, labels, key, text, label, DRAWN * max_examples)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(drawn), "key")
    texts = rows.where(F.md5("text") == F.col("digest")).groupBy("label", "digest").agg(F.first("rows").alias("rows"), F.first("key").alias("key"), F.first("text").alias("text"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: [f"{t}\t{n}" for t, n in word_counts(x).items()])

    counted = materialise(texts.select("label", "digest", "rows", "key", split.asNondeterministic()("text").alias("terms")), "toxicity-terms")
    found = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("rows").alias("n")).collect()}
    # the labels are drawn apart, so a row found stands for as many as its label has for each that is drawn
    each = {y: every[y] / found[y] if found.get(y) else 0.0 for y in (0, 1)}
    totals = {y: every.get(y, 0) for y in (0, 1)}
    term = counted.select("label", "rows", F.explode("terms").alias("term"))
    term = term.select("label", "rows", F.substring_index("term", "\t", 1).alias("term"))
    df = term.groupBy("term").agg(F.sum(F.col("label") * F.col("rows")).alias("d1"), F.sum("rows").alias("d"))
    taken = [counted.where(F.col("label") == y).orderBy("digest").limit(max_examples) for y in (1, 0)]
    drawn = materialise(taken[0].unionByName(taken[1]), "toxicity-examples")
    used = drawn.select(F.explode("terms").alias("term")).select(F.substring_index("term", "\t", 1).alias("term")).distinct()
    met = df.join(used, "term", "left_semi").toArrow().sort_by("term")
    with_term = np.stack([met["d1"].to_numpy(), met["d"].to_numpy()], axis=1).astype(np.float64)
    n = totals[0] + totals[1]
    idf = 1 + np.log((1 + n) / (1 + with_term[:, 0] * each[1] + (with_term[:, 1] - with_term[:, 0]) * each[0]))
    terms = {t: i for i, t in enumerate(met["term"].to_pylist())}
    examples, names, rows_of = [], [], []
    for r in drawn.orderBy(F.desc("label"), "digest").select("key", "label", "rows", "terms").toLocalIterator():
        examples.append((r["label"], *numbered(terms, (pair.split("\t") for pair in r["terms"]))))
        names.append(r["key"])
        rows_of.append(r["rows"])
    index = index_of(terms, idf, examples, rows_of)
    model = Model(index, with_term, np.array([found.get(1, 0), found.get(0, 0) + found.get(1, 0)], dtype=float), 1 + math.log(1 + n), np.array([[0.0, 0.0], [1.0, 1.0]]), np.zeros(3), np.array([-np.inf]), np.array([0.0]), 0.0, names)
    raw, marks, sizes, blank = [], [], [], [0, 0]
    for i, (y, own, counts) in enumerate(examples):
        vote, _, _ = index.vote(*index.weighted(own, counts), NEIGHBOURS, skip=i)
        if vote is None:
            blank[y] += rows_of[i]
        else:
            raw.append((vote, model.signs(own, y, rows_of[i])))
            marks.append(y)
            sizes.append(rows_of[i])
    prior = totals[1] / n if n else 0.0
    model.levels = np.array([prior])
    if raw:
        x, y, held = np.array(raw), np.array(marks, dtype=float), np.array(sizes, dtype=float)
        if 0 < y @ held < held.sum():  # both labels weigh alike, as examples are drawn by label
            held = held * np.where(y == 1, (1 - y) @ held / (y @ held), 1.0)
        model.scale = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-9])
        model.weights = logistic((x - model.scale[0]) / model.scale[1], y, held)
        model.edges, model.levels = calibrate(model.linear(x[:, 0], x[:, 1]), y, held)
    # examples are drawn by label, so a count stands for its label's share in the training rows
    share = [totals[y] / max(1, sum(c for e, c in zip(examples, rows_of, strict=True) if e[0] == y)) for y in (0, 1)]
    model.blank = blank[1] * share[1] / (blank[0] * share[0] + blank[1] * share[1]) if any(blank) else prior
    return model


def scored(docs: DataFrame, model: Model, *, text: str = "text", evidence: int = 3, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into``: score and evidence (nearest examples' key, cosine and label). No shuffle.

    A column of ``docs`` that has that name already is replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    near = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", near)]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back(kept=True)
        own = shared.value  # a worker holds it only as long as its stage runs
        for batch in batches:
            rows = [own.score(x or "", evidence) for x in batch]
            yield pd.DataFrame({"score": [r[0] for r in rows], "evidence": [[{"key": k, "cosine": c, "label": y} for k, c, y in r[1]] for r in rows]})
        give_back()

    return docs.withColumn(into, run.asNondeterministic()(F.col(text)))


def is_toxic(score: Column) -> Column:
    return score >= THRESHOLD


def clean_documents(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with the same columns."""
    kept = scored(docs, model, text=text, evidence=0, into="_toxicity").where(~is_toxic(F.col("_toxicity.score")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
