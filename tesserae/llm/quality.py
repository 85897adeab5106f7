"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered
thresholds cut its score, P(grade >= k) = sigmoid(score - threshold_k). The
expected grade and the tail probability of the top grade come from the same
score. The model is fitted on a bounded sample of rated documents and applied
to every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, words

#: Hashed features; the weight vector (1 MB) is what scoring broadcasts.
FEATURE_BITS = 18
#: Rated documents that the fit uses at most, those with the smallest id hashes.
SAMPLE_ROWS = 8000
#: Bytes of a word's beginning that are a feature of their own.
STEM = 4
#: A feature of fewer rated documents than this has no weight.
LEAST_DOCUMENTS = 4
#: Steps of the fit, their rate, and the L1 penalty that keeps weights of chance features at zero.
STEPS, RATE, PENALTY = 150, 0.3, 1.5e-3
#: A document is selected if the probability of the top grade reaches this.
SELECT_AT = 0.35


def grade(quality: Column, toxic: Column) -> Column:
    """Rating of a labelled document: 0 toxic, 1 of low quality, 2 good; null if a label is missing."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def _slot(name: bytes) -> int:
    return zlib.crc32(name) & ((1 << FEATURE_BITS) - 1)


def _shape(text: str, tokens: list[bytes], distinct: set[bytes]) -> list[int]:
    """Slots that say how a text is written, per word: distinct words, capitals, marks, the same word again, the commonest mark, length.

    Marks are the ASCII signs that prose has few of. The commonest one by itself
    tells tables and markup, which repeat one, from texts that mix them.
    """
    n = max(len(tokens), 1)
    upper = sum(map(len, re.findall(r"[A-Z]+", text)))
    marks = Counter(re.findall(r"[!#$%&*|=<>{}\\^~@_]", text))
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    shares = (len(distinct) / n, upper / max(len(text), 1), marks.total() / n, again / n, max(marks.values(), default=0) / n, len(text) / n / 10)
    return [_slot(b"\x00%d:%d" % (k, min(int(s * 20), 40))) for k, s in enumerate(shares)]


class Slots:
    """Feature slots of a text; those of a word are remembered."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.limit = limit

    def of(self, text: str | None) -> np.ndarray:
        """Distinct slots: words, word beginnings, shape. Null and empty texts have only shape."""
        text = text or ""
        tokens = words(text)
        distinct = set(tokens)
        known, found = self.known, _shape(text, tokens, distinct)
        if len(known) > self.limit:
            known.clear()
        for w in distinct:
            pair = known.get(w)
            if pair is None:
                pair = known[w] = (_slot(w.strip(b".,;:!?\"'()")), _slot(b"\x01" + w[:STEM]))
            found += pair
        return np.unique(np.array(found, np.int32))


@dataclass(frozen=True)
class OrdinalModel:
    """``thresholds`` rise with the grade; grade k is reached with probability sigmoid(score - thresholds[k - 1])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum(dtype=np.float64))

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(texts: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """L1-penalised likelihood of the cumulative-link model, by proximal AdaGrad over the whole sample.

    Grades weigh alike. Thresholds are a first one and positive steps, so they
    keep their order. With one grade or none every document gets tails of 1.
    """
    size = 1 << FEATURE_BITS
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(size, np.float32), np.full(n_grades - 1, -40.0))
    count = np.fromiter(map(len, texts), np.int64, len(texts))
    row, slot = np.repeat(np.arange(len(texts)), count), np.concatenate(texts)
    known = np.flatnonzero(np.bincount(slot, minlength=size) >= LEAST_DOCUMENTS)
    column = np.full(size, -1)
    column[known] = np.arange(len(known))
    row, slot = row[column[slot] >= 0], column[slot][column[slot] >= 0]
    share = np.bincount(grades, minlength=n_grades)
    each = (len(grades) / (np.count_nonzero(share) * np.maximum(share, 1)))[grades] / len(grades)
    w, cuts = np.zeros(len(known)), np.r_[-1.0, np.zeros(n_grades - 2)]
    w2, c2 = np.full(len(known), 1e-10), np.full(n_grades - 1, 1e-8)
    lowest, highest = grades == 0, grades == n_grades - 1
    for _ in range(STEPS):
        score = np.bincount(row, w[slot], len(texts))
        steps = np.exp(cuts[1:])
        edges = np.r_[cuts[0], cuts[0] + np.cumsum(steps)]
        reach = 1 / (1 + np.exp(-np.clip(score[:, None] - edges[None, :], -40, 40)))
        low = np.where(lowest, 1.0, reach[np.arange(len(grades)), np.maximum(grades - 1, 0)])
        high = np.where(highest, 0.0, reach[np.arange(len(grades)), np.minimum(grades, n_grades - 2)])
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = np.where(lowest, 0.0, low * (1 - low)), np.where(highest, 0.0, high * (1 - high))
        d_score = each * (d_low - d_high) / p
        gw = np.bincount(slot, d_score[row], len(known))
        by_edge = np.zeros(n_grades - 1)
        np.add.at(by_edge, np.maximum(grades - 1, 0), np.where(lowest, 0.0, -each * d_low / p))
        np.add.at(by_edge, np.minimum(grades, n_grades - 2), np.where(highest, 0.0, each * d_high / p))
        gc = np.r_[by_edge.sum(), [by_edge[k:].sum() * steps[k - 1] for k in range(1, n_grades - 1)]]
        w2 += gw * gw
        c2 += gc * gc
        pace = RATE / np.sqrt(w2)
        w += pace * gw
        w = np.sign(w) * np.maximum(np.abs(w) - pace * PENALTY, 0)
        cuts += RATE * gc / np.sqrt(c2)
    edges = np.r_[cuts[0], cuts[0] + np.cumsum(np.exp(cuts[1:]))]
    weights = np.zeros(size, np.float32)
    weights[known] = w
    return OrdinalModel(weights, edges)


def rated_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(slots, grade) of at most ``limit`` rated documents, the ones with the smallest hashes of their ids.

    The smallest labels are chosen before their texts are read, so the texts of
    the sample alone are joined. A document of several labels has its lowest
    grade; of several rows of one id the text with the smallest hash is read.
    ``slots`` are 32-bit numbers, little-endian.
    """
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            found = [slots.of(t.as_py()).astype("<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("grade")], names=["slots", "grade"])

    # at most ``limit`` rows of two numbers: a proven bound for the broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", "grade").mapInArrow(frugal(run), "slots binary, grade int")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, n_grades: int = 3) -> OrdinalModel:
    """The model of a bounded sample of rated documents (``rated_sample``); repeated rows and labels count once.

    Without rated documents, or with one grade alone, every document reaches the top grade.
    """
    rows = sorted((r["grade"], len(r["slots"]), bytes(r["slots"])) for r in rated_sample(docs, labels, limit).collect())
    return fit([np.frombuffer(s, "<i4").astype(np.int64) for _, _, s in rows], np.array([g for g, _, _ in rows], np.int64), n_grades)


def rate(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the top grade) and selected.

    Every whole text is rated; null is empty text. Rows, repeated ones too, keep
    all their columns; columns of the three names would be replaced. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))
    keep = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "selected")]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        slots, ordinal = Slots(), OrdinalModel(*shared.value)
        for batch in texts:
            score = np.fromiter((ordinal.score(slots.of(t)) for t in batch), np.float64, len(batch))
            tails = ordinal.tails(score)
            yield pd.DataFrame({"expected": tails.sum(1), "tail": tails[:, -1]})

    rated = F.pandas_udf(frugal(run), "expected double, tail double")
    out = docs.select(F.struct("*").alias("row"), rated(F.col("text")).alias("rated"))
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("rated.expected").alias("expected_grade"), F.col("rated.tail").alias("tail_probability"),
        (F.col("rated.tail") >= SELECT_AT).alias("selected"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return rate(docs.select("doc_id", "text"), model).drop("text")
