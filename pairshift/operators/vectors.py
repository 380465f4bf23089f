"""Vector drift between paired representations.

Vectors arrive as a table (one row per pair, variant, layer [, position]);
the model that produced them is outside Spark. Pairing is an aggregation, the
cosine is array arithmetic inside the row, and the per-layer summary is a tiny
``groupBy``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairshift.operators.pairing import last_perturbed

COS_EPS = 1e-8
POOLS = ("cls", "mean")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b, eps: float = COS_EPS) -> Column:
    """M3: cosine similarity; each norm is floored at ``eps`` so a zero vector gives 0.

    Vectors of different lengths raise instead of being padded with nulls.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    cos = _dot(a, b) / (F.greatest(_norm(a), F.lit(eps)) * F.greatest(_norm(b), F.lit(eps)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimensions differ"))).otherwise(cos)


def paired_vectors(vectors: DataFrame, keys=("dataset", "task", "split", "pair_id", "layer"), order_col: str | None = None) -> DataFrame:
    """Clean and perturbed vector of each (pair, layer) by the pairing rules; incomplete pairs dropped.

    Per variant the last row by ``order_col`` wins, ties (and tables without an order) by the vector's hash, and
    ``perturbed`` comes before ``switchmix``, so the order of the rows in memory never decides.
    """
    k = list(keys)
    order = F.struct(F.col(order_col) if order_col else F.lit(0), F.xxhash64("vector"))
    g = vectors.groupBy(*k).agg(
        F.max_by("vector", F.when(F.col("variant") == "clean", order)).alias("clean"),
        last_perturbed(F.col("vector"), F.col("variant"), order).alias("perturbed"),
    )
    return g.where(F.col("clean").isNotNull() & F.col("perturbed").isNotNull())


def vector_drift(vectors: DataFrame) -> DataFrame:
    """M3 per (pair, layer): cosine and drift = 1 - cosine."""
    p = paired_vectors(vectors).withColumn("cosine", cosine("clean", "perturbed"))
    return p.select("dataset", "task", "split", "pair_id", "layer", "cosine", (1.0 - F.col("cosine")).alias("drift"))


def representation_shift(vectors: DataFrame, model: str = "external", pool: str = "cls") -> DataFrame:
    """A10 + O1: per (dataset, task, split, layer): count, mean cosine, population std, mean drift."""
    d = vector_drift(vectors)
    g = d.groupBy("dataset", "task", "split", "layer").agg(
        F.count(F.lit(1)).cast("long").alias("n_pairs"),
        F.avg("cosine").alias("mean_cosine"),
        F.stddev_pop("cosine").alias("std_cosine"),
        F.avg("drift").alias("mean_drift"),
    )
    return g.select(
        F.col("dataset").alias("data_path"), F.lit(model).alias("model"), F.lit(pool).alias("pool"),
        "task", "split", "layer", "n_pairs", "mean_cosine", "std_cosine", "mean_drift",
    ).orderBy("task", "split", "layer")


def pool(token_vectors: DataFrame, method: str, keys=("dataset", "task", "split", "pair_id", "variant")) -> DataFrame:
    """X3 with M4 (``cls``: vector at position 0) or M5 (``mean``: mask-weighted mean).

    Mean pooling is one weighted-mean aggregate of whole vectors (no row per dimension), with partial sums before
    the shuffle; a sequence whose mask is empty is a zero vector of its own length.
    """
    k = list(keys)
    if method == "cls":
        return token_vectors.where(F.col("pos") == 0).select(*k, F.col("vector"))
    if method != "mean":
        raise ValueError(f"Unknown pool method: {method}")
    mask = F.coalesce(F.col("mask").cast("double"), F.lit(0.0))
    # a masked position counts as a zero vector of weight 1: the summarizer needs some weight, the sum does not change
    value = F.when(mask > 0, F.col("vector")).otherwise(F.transform("vector", lambda x: x * 0.0))
    weight = F.when(mask > 0, mask).otherwise(F.lit(1.0))
    g = token_vectors.groupBy(*k).agg(
        Summarizer.mean(array_to_vector(value), weight).alias("_mean"), F.sum(weight).alias("_w"), F.sum(mask).alias("_m"))
    return g.select(*k, F.transform(vector_to_array("_mean"), lambda x: x * F.col("_w") / F.greatest(F.col("_m"), F.lit(1.0))).alias("vector"))


def pooled_drift(token_vectors: DataFrame, method: str) -> DataFrame:
    """Cosine between the pooled clean and perturbed vectors of each pair."""
    pooled = pool(token_vectors, method).withColumn("layer", F.lit(0))
    d = vector_drift(pooled)
    return d.select("pair_id", F.lit(method).alias("pool"), "cosine", "drift")
