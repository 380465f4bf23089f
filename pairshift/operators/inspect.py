"""Dataset inspection.

Percentiles are exact nearest-rank values computed without sorting rows: a
histogram of lengths (one row per distinct length) and a running count over
it. The window runs over distinct lengths per variant, a table bounded by the
longest text, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.functions.draws import u01
from pairshift.operators.pairing import inspector_pairs


def counts_by_dim(examples: DataFrame, dims=("variant", "task", "split")) -> DataFrame:
    """Row counts by each dimension separately, one grouping-sets aggregate."""
    sets = [[d] for d in dims]
    examples = examples.select(*[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims])  # null and empty are one value
    g = examples.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    dim = None
    val = None
    for d in dims:
        cond = F.col(f"_g_{d}") == 0
        dim = F.when(cond, F.lit(d)) if dim is None else dim.when(cond, F.lit(d))
        val = F.when(cond, F.col(d).cast("string")) if val is None else val.when(cond, F.col(d).cast("string"))
    return g.select(dim.alias("dimension"), F.coalesce(val, F.lit("")).alias("value"), "n_rows")


def pair_size_histogram(examples: DataFrame) -> DataFrame:
    """How many pair keys have 1, 2, 3 ... rows (inspector pairing, J3)."""
    p = inspector_pairs(examples)
    return p.groupBy(F.col("n_rows").cast("long").alias("pair_size")).agg(F.count(F.lit(1)).cast("long").alias("n_pairs"))


def nearest_rank_stats(lengths: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, p50, p90, max per group; rank ``round((n-1)p)`` half-to-even.

    ``lengths``: one row per item with columns ``by`` and ``value``.
    """
    hist = lengths.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy(by)
    h = hist.withColumns({"_cum": F.sum("_c").over(w), "_n": F.sum("_c").over(tot)})

    def pct(p: float):
        r = F.bround((F.col("_n") - 1) * F.lit(p), 0)
        return F.min(F.when(F.col("_cum") > r, F.col(value))).cast("double")

    return h.groupBy(by).agg(
        F.first("_n").cast("long").alias("n"),
        (F.sum(F.col(value) * F.col("_c")) / F.first("_n")).alias("mean"),
        pct(0.5).alias("p50"),
        pct(0.9).alias("p90"),
        F.max(value).cast("double").alias("max"),
    )


def length_stats(examples: DataFrame) -> DataFrame:
    """Character length stats of clean and perturbed inputs (inspector pairing); a side without rows has zeros."""
    p = inspector_pairs(examples)
    lens = p.select(
        F.explode(F.array(
            F.struct(F.lit("clean").alias("side"), F.length(F.col("clean.text")).alias("len")),
            F.struct(F.lit("perturbed").alias("side"), F.length(F.col("perturbed.text")).alias("len")),
        )).alias("x")
    ).select("x.side", "x.len").where(F.col("len").isNotNull())
    found = nearest_rank_stats(lens, "side", "len")
    sides = examples.sparkSession.range(2).select(F.when(F.col("id") == 0, "clean").otherwise("perturbed").alias("side"))
    zero = {c: (F.lit(0).cast("long") if c == "n" else F.lit(0.0)) for c in ("n", "mean", "p50", "p90", "max")}
    return sides.join(found, on="side", how="left").select("side", *[F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()])


def perturbation_rates(examples: DataFrame) -> DataFrame:
    """Provenance of the perturbed rows per (task, split, label)."""
    pert = examples.where(F.col("variant").isin("perturbed", "switchmix"))
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows")]
    for f in ("a", "b"):
        m = f"metadata.perturbation.{f}"
        applied = F.col(f"{m}.code_switch.applied")
        aggs += [
            F.avg(applied.cast("double")).alias(f"{f}_applied_rate"),
            F.avg(F.when(applied, F.col(f"{m}.code_switch.span_len"))).alias(f"{f}_avg_span_len"),
            F.sum(F.col(f"{m}.noise.dropped_tokens")).cast("long").alias(f"{f}_dropped_tokens"),
            F.sum(F.col(f"{m}.noise.abbreviations")).cast("long").alias(f"{f}_abbreviations"),
            F.avg((F.col(f"{m}.noise.punct_added") != "").cast("double")).alias(f"{f}_punct_rate"),
        ]
    return pert.groupBy("task", "split", "label").agg(*aggs)


def show_pairs(examples: DataFrame, n: int = 3, seed=42, width: int = 400) -> DataFrame:
    """``n`` random pairs side by side, texts cut to ``width`` characters.

    A top-n by keyed draw (TakeOrderedAndProject): each task keeps ``n`` rows.
    """
    p = inspector_pairs(examples)
    return p.select(
        "pair_id",
        u01(seed, "show", F.col("pair_id")).alias("_d"),
        F.col("clean.label").alias("clean_label"), tx.display_text(F.col("clean.text"), width).alias("clean_text"),
        F.col("perturbed.label").alias("perturbed_label"), tx.display_text(F.col("perturbed.text"), width).alias("perturbed_text"),
    ).orderBy("_d", "pair_id").limit(n).drop("_d")
