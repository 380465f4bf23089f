"""Selection without a gathering task: the n-th smallest of keyed draws, and a key set as a bitmap of fixed size.

Both give a ``Column`` that holds a scalar subquery, so a plan that uses them stays lazy and filters its rows where
they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = 12
LEVELS = 2
MIN_BITS, MAX_BITS = 10, 23


def _cut(rows: DataFrame, place: Column, n: Column) -> Column:
    """(``place``, ``rest``) of the place that holds the n-th row; null where there are fewer rows.

    Rows are counted per place (pre-aggregated); the running sum is over the places of one level.
    """
    counts = rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # 1 << LEVEL_BITS rows at most
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return counts.where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n)).select(
        F.struct("place", (n - F.col("before")).alias("rest")).alias("cut")).scalar()


def nth_smallest(df: DataFrame, draw: Column, key_col: str, n: int) -> Column:
    """The n-th smallest ``(draw, key)`` of ``df``, null with fewer rows; ``draw`` is uniform in [0, 1), ``key_col`` unique.

    Radix selection: each level counts the rows of the place that the level before chose by the next ``LEVEL_BITS``
    bits of the draw, and only the rows of the last place (one in ``2 ** (LEVELS * LEVEL_BITS)``) are ranked. A level
    reads the key column again and moves one count per place and task, whatever ``n`` is.
    """
    rows = df.select(draw.alias("draw"), F.col(key_col).alias("key"))
    rest = F.lit(n)
    for level in range(1, LEVELS + 1):
        place = F.floor(F.col("draw") * (1 << level * LEVEL_BITS)).cast("long")
        cut = _cut(rows, place, rest)
        rows, rest = rows.where(place == cut.getField("place")), cut.getField("rest")
    order = Window.partitionBy(F.lit(0)).orderBy("draw", "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == rest).select(F.struct("draw", "key").alias("last")).scalar()


def may_contain(keys: DataFrame, columns: Sequence[str], expected: int) -> Column:
    """Whether a row's ``columns`` may be in ``keys`` (never false for one that is): one bit per hashed key.

    The bitmap has 16 bits per expected key, from ``2 ** MIN_BITS`` to ``2 ** MAX_BITS`` (1 MB) whatever ``keys`` holds;
    more keys than expected only let more rows through.
    """
    bits = min(max((16 * max(expected, 1) - 1).bit_length(), MIN_BITS), MAX_BITS)
    at = F.xxhash64(*columns).bitwiseAND((1 << bits) - 1)
    marks = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("word"))
    words = keys.sparkSession.range(1 << (bits - 6)).join(marks, "id", "left")
    bitmap = words.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))).getField("word")).scalar()
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1
