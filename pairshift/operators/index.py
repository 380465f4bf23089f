"""Dense positions without a single-partition window and without a job of their own.

``row_number() over (order by k)`` with no ``partitionBy`` moves every row into one task. ``with_dense_index``
computes the same 0-based position as a radix prefix sum over integer keys, one method for any number and any
spread of keys:

1. a key's block is the key without its lowest 16 bits, a block's ancestor is the block without its lowest 24 bits;
   rows are counted per block and per ancestor (pre-aggregated);
2. running sums go from the top: over the at most 2^24 ancestors, then over the at most 2^24 blocks of each ancestor.
   Only (block, count) pairs are in these windows, and dense keys have few of them;
3. a row's position is its block's first position plus its ``row_number`` among the at most 65,536 keys there.

A composite order does this column by column: the first position of the first column's value, plus the position by
the other columns inside that value. The plan is lazy: nothing is measured and nothing is written.

Other orders (strings, doubles) are sorted by range, written once under the checkpoint folder, and counted per
physical partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.session import materialize

_LOCAL_BITS = 33
BLOCK_BITS = 16
RADIX_BITS = 24
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _first_positions(counts: DataFrame, part: list[str], key: str, n: str, out: str, bits: int) -> DataFrame:
    """``counts`` (``part``, ``key`` of so many ``bits``, unique within it, ``n`` rows each) with ``out``: rows before the key."""
    levels = [counts.select(*part, F.col(key).cast("long").alias("_k0"), F.col(n).alias("_n"))]
    for i in range(1, -(-bits // RADIX_BITS)):
        up = F.shiftright(f"_k{i - 1}", RADIX_BITS).alias(f"_k{i}")
        levels.append(levels[-1].groupBy(*part, up).agg(F.sum("_n").alias("_n")))
    starts = None
    for i in range(len(levels) - 1, -1, -1):
        here = levels[i]
        inside = list(part)
        if starts is not None:
            inside.append(f"_k{i + 1}")
            here = here.withColumn(f"_k{i + 1}", F.shiftright(f"_k{i}", RADIX_BITS))
        # the top level is one group on purpose: it has at most 2^24 rows of two numbers, and few for dense keys
        w = Window.partitionBy(*(inside or [F.pmod(F.col(f"_k{i}"), F.lit(1))])).orderBy(f"_k{i}").rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        if starts is not None:
            here = here.join(starts, on=inside).withColumn("_before", F.col("_before") + F.col("_start"))
        starts = here.select(*part, f"_k{i}", F.col("_before").alias("_start"))
    return starts.select(*part, F.col("_k0").alias(key), F.col("_start").alias(out))


def _radix_index(df: DataFrame, part: list[str], order: list[str], out: str) -> DataFrame:
    if len(order) == 1:
        block, base = f"_ps_block_{out}", f"_ps_base_{out}"
        keyed = df.withColumn(block, F.shiftright(F.col(order[0]).cast("long"), BLOCK_BITS))
        counts = keyed.groupBy(*part, block).agg(F.count(F.lit(1)).alias("_ps_n"))
        starts = _first_positions(counts, part, block, "_ps_n", base, 64 - BLOCK_BITS)
        w = Window.partitionBy(*part, block).orderBy(order[0])
        joined = keyed.join(starts, on=[*part, block])
        return joined.withColumn(out, (F.col(base) + F.row_number().over(w) - 1).cast("long")).drop(block, base)
    first, start, inner = order[0], f"_ps_start_{out}", f"_ps_in_{out}"
    counts = df.groupBy(*part, first).agg(F.count(F.lit(1)).alias("_ps_n"))
    starts = _first_positions(counts, part, first, "_ps_n", start, 64)
    within = _radix_index(df, [*part, first], order[1:], inner)
    joined = within.join(starts.withColumn(first, F.col(first).cast(df.schema[first].dataType)), on=[*part, first])
    return joined.withColumn(out, (F.col(start) + F.col(inner)).cast("long")).drop(start, inner)


def _layout_index(df: DataFrame, order_cols: list[str], part: list[str], out: str) -> DataFrame:
    sort_cols = part + order_cols
    staged = materialize(df.orderBy(*sort_cols).withColumn("_ps_mid", F.monotonically_increasing_id()))
    staged = staged.withColumns({
        "_ps_pid": F.shiftright(F.col("_ps_mid"), _LOCAL_BITS),
        "_ps_local": F.col("_ps_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    })
    blocks = staged.groupBy("_ps_pid", *part).agg(
        F.count(F.lit(1)).alias("_ps_n"), F.min("_ps_local").alias("_ps_first")
    )
    w = Window.partitionBy(*part).orderBy("_ps_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ps_base", F.coalesce(F.sum("_ps_n").over(w), F.lit(0)))
    blocks = blocks.select("_ps_pid", *part, "_ps_base", "_ps_first")
    joined = staged.join(blocks, on=["_ps_pid", *part], how="inner")
    return joined.withColumn(
        out, (F.col("_ps_base") + F.col("_ps_local") - F.col("_ps_first")).cast("long")
    ).drop("_ps_mid", "_ps_pid", "_ps_local", "_ps_base", "_ps_first")


def with_dense_index(
    df: DataFrame,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    out: str = "idx",
) -> DataFrame:
    """Add ``out`` = ``row_number() over (partition by partition_cols order by order_cols) - 1``.

    ``order_cols`` must define a total order inside each partition (unique keys),
    exactly as for a deterministic window. Order and partition columns must be non-null.
    """
    part, order = list(partition_cols), list(order_cols)
    columns = [*df.columns, out]
    if all(isinstance(df.schema[c].dataType, _INTEGRAL) for c in order):
        return _radix_index(df, part, order, out).select(*columns)
    return _layout_index(df, order, part, out).select(*columns)
