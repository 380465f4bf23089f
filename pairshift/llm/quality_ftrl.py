"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features of a text are its word uni- and bigrams in two spellings, as written and as shape (runs of capitals, small
letters and digits collapsed to one sign each; a shape bigram also says whether the word bigram stood earlier in
the text), hashed into ``1 << BITS`` places; the value of a place is its share of the text's words. A score is the
logistic function of a sparse dot product. Ids, languages, sources and labels are never features.

Training uses at most ``train_rows`` labelled rows, those with the smallest hashes of the id, which is the one
documented bound; the rows go through one task in that order, ``epochs`` times, with per-coordinate FTRL-proximal
steps. The weights (at most ``1 << BITS`` doubles) are the only thing that is collected and broadcast. All rows are
scored over their whole texts.

Edge cases: null and empty texts have no words and score by the bias alone; a null id is in no fold (``held_out``
false) and is scored; repeated labels of one id count once, with the largest value; repeated documents are scored
one by one and train once; without any labelled row all weights are zero and every score is 0.5; an empty table gives an empty table;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import whole_text

BITS = 18
BIAS = 0
TRAIN_ROWS = 8000
EPOCHS = 3
ROWS = 512
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
SCALE = 20.0
THRESHOLD = 0.7
_SHAPE = bytes(
    88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _place(h: np.ndarray, space: int) -> np.ndarray:
    """Hash values to places 1 .. (1 << BITS) - 1; place 0 is the bias."""
    x = (h + np.uint64(space)) * _M[0]
    x ^= x >> np.uint64(29)
    return np.maximum(((x * _M[1]) >> np.uint64(64 - BITS)).astype(np.int64), 1)


def features(text: str) -> tuple[np.ndarray, float]:
    """Places of all n-grams of the text, with repeats, and the value that each occurrence adds."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64), 0.0
    word = np.fromiter(map(crc32, words), dtype=np.uint64, count=n)
    signs = np.frombuffer(raw.translate(_SHAPE), dtype=np.uint8)
    first = np.ones(len(signs), dtype=bool)
    np.not_equal(signs[1:], signs[:-1], out=first[1:])
    shape = np.fromiter(map(crc32, signs[first].tobytes().split()), dtype=np.uint64, count=n)
    pair = word[:-1] * _M[1] + word[1:] * _M[2]
    seen = np.ones(n - 1, dtype=np.uint64)
    seen[np.unique(pair, return_index=True)[1]] = 0
    shapes = shape[:-1] * _M[2] + shape[1:] * _M[0] + seen
    return np.concatenate([_place(word, 1), _place(pair, 2), _place(shape, 3), _place(shapes, 4)]), SCALE / n


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        """``at`` without repeats."""
        w = self.weights(at)
        g = (sigmoid(float(w @ values)) - label) * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all places."""
    rows = []
    for text in texts:
        at, value = features(text)
        at, times = np.unique(at, return_counts=True)
        rows.append((np.concatenate([[BIAS], at]), np.concatenate([[1.0], value * times])))
    model = Ftrl(1 << BITS)
    for _ in range(epochs):
        for (at, values), label in zip(rows, labels, strict=True):
            model.learn(at, values, float(label))
    return model.weights(np.arange(1 << BITS))


def score(weights: np.ndarray, text: str) -> float:
    at, value = features(text)
    return sigmoid(float(weights[BIAS] + value * weights[at].sum()))


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> np.ndarray:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    sample = known.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("order", "id", "label").agg(F.min("body").alias("body"))  # an id that many rows repeat trains once

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(zip(*[[v for b in parts for v in b.column(c).to_pylist()] for c in ("order", "id", "body", "label")], strict=True)) if (parts := list(batches)) else []
        weights = train([r[2] for r in held], [r[3] for r in held])
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["at", "weight"])

    found = rows.repartition(1).mapInArrow(learn, "at long, weight double").collect()
    weights = np.zeros(1 << BITS)
    weights[[r["at"] for r in found]] = [r["weight"] for r in found]
    return weights


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id column, ``held_out``, ``score`` and ``predicted``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, train_rows))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                scores = [score(weights, t) for t in b.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).mapInArrow(run, out)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
