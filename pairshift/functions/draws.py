"""Stateless, partition-independent random draws.

A draw is a pure function of a key: the first 52 bits of ``md5`` of the parts
joined by ``|``, scaled into ``[0, 1)``. The same row therefore gets the same
draw whatever the partitioning, retry or executor, and the same expression can
be written in any SQL engine that has ``md5``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def draw_key(*parts) -> Column:
    """The string that is hashed: all parts as strings joined by ``|``."""
    return F.concat_ws("|", *[_part(p) for p in parts])


def u01(*parts) -> Column:
    """Uniform double in [0, 1) keyed by ``parts`` (exact: 52 bits)."""
    hex13 = F.substring(F.md5(draw_key(*parts)), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / F.lit(TWO_POW_52)


def uint(lo, hi, *parts) -> Column:
    """Uniform integer on ``lo..hi`` inclusive (bounds may be columns)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(u01(*parts) * (hi_c - lo_c + 1))).cast("int")


def pick(values: Sequence[str], *parts) -> Column:
    """One element of a fixed list, uniformly."""
    arr = F.array(*[F.lit(v) for v in values])
    idx = (F.floor(u01(*parts) * len(values)) + 1).cast("int")
    return F.element_at(arr, idx)


def sql_u01(parts_sql: str) -> str:
    """The same draw in DuckDB SQL, for the oracle; ``parts_sql`` is a comma list."""
    return (
        f"(('0x' || substr(md5(concat_ws('|', {parts_sql})), 1, 13))::BIGINT"
        f" / {TWO_POW_52})"
    )
