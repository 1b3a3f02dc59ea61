"""Transcript parsing by a hidden Markov model, and canonical rendering of chat turns.

A transcript is a text of lines, some with a speaker marker (``User: ...``, ``[ASSISTANT]``, ``### System``, ``<|user|>``),
some without. The hidden state of a line is a role and whether the line begins a turn or goes on with it. A line emits its
marker word, whether a blank line stands before it, whether it ends in a question mark and the size of its text. The
model's start, transition and emission probabilities are counts over labelled transcripts (add-one smoothing); markers
are learnt by word, so no list of names is built in. Viterbi gives the likeliest states, and lines from one beginning to
the next make a turn.

Rendering writes ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed per turn. Control strings inside
a text are broken by a backslash (``<|`` becomes ``<\\|``), so that a rendering has exactly the markers that it was given.

Defined cases: a null or empty transcript has no turns; lines of white space only mark a blank line; a line with only a
marker begins a turn whose text follows; repeated rows are parsed as any row; an empty table gives no rows; further
columns are kept.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Labelled transcripts that a model is fitted on, at most.
MAX_TRAINING = 2000
SIZES = (0, 20, 80, 200, 500)
_MARKER = re.compile(r"\s*(?:<\|([^|<>\n]{1,24})\|>|\[([^\]\n]{1,24})\]|#{1,4}\s*([^:#\n]{1,24}?)\s*(?::|$)|\*\*([^*\n]{1,24}?):?\*\*:?|([^\W\d_][\w ]{0,23}?)\s*:)\s*")

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def observe(transcript: str) -> list[tuple[str, str, str, int, bool, int]]:
    """(line, text after a marker, marker or "", number of blank lines before, question, size class) of each line that isn't
    blank. Before the first line one counts at least, as before most turns."""
    found, blank = [], 0
    for line in transcript.split("\n"):
        if not line.strip():
            blank += 1
            continue
        match = _MARKER.match(line)
        marker = next((g for g in match.groups() if g), "").strip().lower() if match else ""
        text = line[match.end() :] if match else line
        found.append((line, text, marker, blank if found else max(1, blank), text.rstrip().endswith("?"), sum(len(text) > s for s in SIZES)))
        blank = 0
    return found


@dataclass
class Model:
    markers: dict[str, int]
    start: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    blank: np.ndarray
    question: np.ndarray
    size: np.ndarray

    def emissions(self, lines: list) -> np.ndarray:
        known = len(self.markers)
        at = [self.markers.get(m, known + 1) if m else known for _, _, m, _, _, _ in lines]
        cues = [[int(line[i]) for line in lines] for i in (3, 4, 5)]
        cues[0] = [min(1, b) for b in cues[0]]
        return (self.marker[:, at] + self.blank[:, cues[0]] + self.question[:, cues[1]] + self.size[:, cues[2]]).T

    def viterbi(self, lines: list) -> list[int]:
        emit = self.emissions(lines)
        best, back = self.start + emit[0], []
        for row in emit[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        path = [int(best.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return path[::-1]

    def parse(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        lines = observe(transcript)
        turns: list[tuple[str, list[str]]] = []
        for (line, text, marker, blank, _, _), state in zip(lines, self.viterbi(lines) if lines else [], strict=True):
            role, begins = STATES[state]
            if begins or not turns:
                turns.append((role, [text if marker in self.markers else line]))
            else:
                turns[-1][1].extend([""] * blank + [line])
        return [(role, "\n".join(parts).strip("\n")) for role, parts in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n" + text.replace("<|", "<\\|") + "<|im_end|>\n" for role, text in turns)


def fit(labelled: list[tuple[str, list[tuple[str, bool]]]]) -> Model:
    """From transcripts with the state (role, begins) of each line that isn't blank."""
    number = {s: i for i, s in enumerate(STATES)}
    n, seen = len(STATES), {}
    rows = []
    for transcript, states in labelled:
        lines = observe(transcript)
        if len(lines) == len(states) and lines:
            rows.append((lines, [number[s] for s in states]))
    for lines, states in rows:  # a marker is a word that mostly begins turns
        for line, s in zip(lines, states, strict=True):
            if line[2]:
                good, every = seen.get(line[2], (0, 0))
                seen[line[2]] = good + STATES[s][1], every + 1
    markers = {m: i for i, m in enumerate(sorted(m for m, (good, every) in seen.items() if good >= 3 and 2 * good > every))}
    start, step, marker = np.ones(n), np.ones((n, n)), np.full((n, len(markers) + 2), 0.1)
    blank, question, size = np.ones((n, 2)), np.ones((n, 2)), np.ones((n, len(SIZES) + 1))
    for lines, states in rows:
        start[states[0]] += 1
        for a, b in zip(states, states[1:], strict=False):
            step[a, b] += 1
        for (_, _, m, before, asks, length), s in zip(lines, states, strict=True):
            marker[s, markers.get(m, len(markers) + 1) if m else len(markers)] += 1
            blank[s, min(1, before)] += 1
            question[s, int(asks)] += 1
            size[s, length] += 1
    for i, (role, begins) in enumerate(STATES):  # a role's going on follows only its own lines; nothing starts by going on
        if not begins:
            start[i] = 1e-12
            for j, (other, _) in enumerate(STATES):
                if other != role:
                    step[j, i] = 1e-12
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(markers, norm(start), norm(step), norm(marker), norm(blank), norm(question), norm(size))


_models: dict[str, Model] = {}


def parsed(df: DataFrame, model: Model, *, text: str, into: str = "chat") -> DataFrame:
    """``df`` with a struct column ``into``: turns and their canonical rendering. No shuffle."""
    spark = df.sparkSession
    ship_package(spark)
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf(T.StructType([T.StructField("turns", TURNS), T.StructField("rendered", T.StringType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if token not in _models:
            _models.clear()
            _models[token] = shared.value
        for batch in batches:
            turns = [_models[token].parse(x or "") for x in batch]
            yield pd.DataFrame({"turns": [[{"role": r, "text": t} for r, t in ts] for ts in turns], "rendered": [render(ts) for ts in turns]})

    return df.withColumn(into, run.asNondeterministic()(F.col(text)))
