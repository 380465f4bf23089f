"""Connected components of an edge table by alternating large and small stars, a round per written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairshift.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's far (large) or near (small) neighbours are hung on the smallest node it knows."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low"))
    hung = near.join(least, F.col("u") == F.col("node"))
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``edges`` (``u``, ``v``); loops are ignored.

    The edges shrink to stars in a logarithmic number of rounds; each round is a pre-aggregated minimum and a join
    that may be split on hot nodes, and is written, so a lost executor repeats one round at most.
    """
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        return tuple(r)

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = written(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
