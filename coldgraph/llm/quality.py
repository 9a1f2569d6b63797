"""Quality scores by naive Bayes support vectors.

A text's features are the set of its hashed n-grams: words without their marks, the marks around words, and pairs of neighbours of
either kind. Each feature is scaled by the log of the ratio of its smoothed class frequencies; on these
a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve, fitted on rows kept aside, makes
scores of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.linear import dual_coordinate_descent, logistic_curve, sigmoid
from coldgraph.llm.rows import column, labelled_sample, remainder, text_of
from coldgraph.llm.words import Words, hashes, words_of

SAMPLE_ROWS = 6_000
BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def _split(word: bytes) -> tuple[bytes, bytes]:
    """The word without marks at its ends, in lower case, and what was around it, with its case."""
    text = word.decode("utf-8", "replace")
    core = text.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    i = text.find(core) if core else len(text)
    case = "A" if core.isupper() and len(core) > 1 else "a" if core else ""
    return core.lower().encode(), (text[:i] + case + text[i + len(core) :]).encode()


def feature_rows(part: Words) -> Iterator[np.ndarray]:
    """For each text of a slice, its distinct features, ascending."""
    both = [_split(w) for w in part.distinct]
    core, mark = hashes([c for c, _ in both], 1)[part.ids], hashes([m for _, m in both], 2)[part.ids]

    def place(h: np.ndarray) -> np.ndarray:
        return (h * MIX >> np.uint64(64 - BITS)).astype(np.int64)

    with np.errstate(over="ignore"):
        kinds = [place(core), place(mark), place(core[:-1] * np.uint64(31) + core[1:]), place(mark[:-1] * np.uint64(37) + mark[1:])]
    for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True):
        last = max(a, b - 1)
        yield np.unique(np.concatenate([kinds[0][a:b], kinds[1][a:b], kinds[2][a:last], kinds[3][a:last]]))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts))
        for part in words_of(texts, False, 4_000_000):
            for i, row in enumerate(feature_rows(part)):
                found[part.first + i] = self.weights[row].sum()
        return sigmoid(self.slope * (found + self.bias) + self.offset)


def fit(rows: list[np.ndarray], good: np.ndarray, alpha: float = 1.0, cost: float = 1.0) -> QualityModel:
    """Model of distinct features and labels. With labels of one kind only (or none) the score is constant."""
    size = 1 << BITS
    if not len(rows) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return QualityModel(np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = np.zeros(len(rows), dtype=bool)
    for kind in (good, ~good):  # every fifth row of each class is kept aside for the curve
        if kind.sum() >= 10:
            aside[np.flatnonzero(kind)[::5]] = True
    if not aside.any() or good[aside].all() or not good[aside].any():
        aside[:] = False
    learn = np.flatnonzero(~aside)
    count = {}
    for kind in (True, False):
        own = [rows[i] for i in learn if good[i] == kind]
        count[kind] = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *own]), minlength=size) + alpha
    ratio = np.log(count[True] / count[True].sum()) - np.log(count[False] / count[False].sum())
    w, bias = dual_coordinate_descent([rows[i] for i in learn], ratio, np.where(good[learn], 1.0, -1.0), cost)
    w *= ratio
    judged = np.flatnonzero(aside) if aside.any() else learn
    margin = np.array([w[rows[i]].sum() + bias for i in judged])
    slope, offset = logistic_curve(margin, good[judged])
    return QualityModel(w.astype(np.float32), float(bias), slope, offset)


def learn_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, modulus: int = 5
) -> QualityModel:
    """Learn from at most ``rows`` labelled rows outside fold 0 of crc32(key) mod ``modulus``.

    Only the hashed features of these rows reach the driver.
    """
    sample = labelled_sample(docs, labels.where(remainder(key, modulus) != 0), label, rows, key, text)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [r.astype(np.int32).tobytes() for part in words_of(batch.column(1), False) for r in feature_rows(part)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(2)], ["features", "label"])

    got = sample.mapInArrow(run, "features binary, label int").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    return fit([np.frombuffer(f, dtype=np.int32).astype(np.int64) for f, _ in pairs], np.array([y == 1 for _, y in pairs], dtype=bool))


def score_with(docs: DataFrame, model, key: str, text: str, modulus: int, threshold: float) -> DataFrame:
    """(key, held_out, score, predicted) for each row; ``model.scores`` gets whole texts (null: empty)."""
    source = docs.select(column(key), text_of(text).alias("__text"))
    schema = source.drop("__text").schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], schema.names)

    return source.mapInArrow(run, schema).select(
        column(key),
        (remainder(key, modulus) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) of each row of ``docs``.

    Null and empty texts get the score of a text without features. Repeated rows are scored alike; a null key is held out.
    Without labels the score is constant; an empty table gives an empty result.
    """
    return score_with(docs, learn_quality(docs, labels, key, text), key, text, 5, threshold)
