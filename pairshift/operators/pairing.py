"""Re-grouping example rows into clean/perturbed pairs.

Pairing is one aggregation keyed by ``(dataset, pair key)``, never a self-join.
``max_by``/``min_by`` are declarative aggregates, so Spark runs them partially
on the map side: a hot pair key (e.g. the ``""`` key every keyless row falls
into) is reduced to one candidate per variant per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.operators.select import may_contain

PERTURBED_VARIANTS = ("perturbed", "switchmix")


LEGACY_SUFFIX = r"_(clean|switchmix|perturbed)$"


def pair_key(pair_id: str = "pair_id", id_col: str = "id", legacy_suffix: bool = False) -> Column:
    """``pair_id``; else the part of ``id`` before the first ``__``; else ``""``.

    ``legacy_suffix=True`` (off by default) also strips a single-underscore
    ``_clean``/``_switchmix``/``_perturbed`` ending, so legacy ids pair up.
    """
    rid = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.substring_index(rid, "__", 1)
    if legacy_suffix:
        key = F.when(F.instr(rid, "__") > 0, key).otherwise(F.regexp_replace(rid, LEGACY_SUFFIX, ""))
    return F.coalesce(F.col(pair_id).cast("string"), key)


def inspector_pair_key(pair_id: str = "pair_id", id_col: str = "id") -> Column:
    """J3 key: empty ``pair_id`` also falls back; rows with neither get null (dropped)."""
    rid = F.nullif(F.col(id_col).cast("string"), F.lit(""))
    return F.coalesce(F.nullif(F.col(pair_id).cast("string"), F.lit("")), F.substring_index(rid, "__", 1))


def _ensure(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def row_order(df: DataFrame, order_col: str | None, payload: Column, nulls_first: bool = True) -> Column:
    """A total order of rows: ``order_col`` (a null is before any value, or after all), id, then the payload's hash.

    The hash makes rows that agree in order and id come out the same way under every layout; rows that agree in
    the payload too are interchangeable. Without ``order_col``: the readers' ``row_order`` if there, else ``id``.
    """
    name = order_col or ("row_order" if "row_order" in df.columns else "id")
    given = F.col(name).isNotNull()
    return F.struct((given if nulls_first else ~given).alias("given"), F.col(name).alias("order"), F.col("id"), F.xxhash64(payload).alias("hash"))


def last_perturbed(row: Column, variant: Column, order: Column) -> Column:
    """The last ``perturbed`` row, else the last ``switchmix`` one."""
    return F.coalesce(*[F.max_by(row, F.when(variant == F.lit(v), order)) for v in PERTURBED_VARIANTS])


def pair_rows(
    df: DataFrame,
    keep: Sequence[str] = ("id", "task", "split", "input", "prompt"),
    order_col: str | None = None,
    dataset_col: str | None = None,
    max_pairs: int | None = None,
    drop_incomplete: bool = True,
    legacy_suffix: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """One row per ``(dataset, pair_id)`` with ``clean`` and ``perturbed`` structs.

    * the last row per (pair, variant) wins, "last" by ``row_order`` above (file order
      for rows from the readers); no row is left out for want of an id or an order;
    * ``perturbed`` is the ``perturbed`` row, else the ``switchmix`` row;
    * ``max_pairs`` keeps the first N pair keys per dataset in first-seen order
      (smallest ``order_col``), *before* incomplete pairs are dropped;
    * ``task``/``split`` come from the clean row, then the perturbed row, then ``""``;
    * ``keyed``: ``pair_id`` holds the pair key already (a stored pair table, ``io.write_pair_table``), so rows that are
      bucketed by it are grouped where they are;
    * ``text`` of each side is ``input``, else ``prompt``, else ``""`` (T13).
    """
    df = _ensure(df, ["pair_id", "id", "variant", *keep])
    ds = F.col(dataset_col) if dataset_col else F.lit("")
    cols = list(dict.fromkeys(keep))
    with_text = "input" in cols and "prompt" in cols
    # T13 is applied before the shuffle: only the analysed text travels, not both fields
    payload = [F.col(c) for c in cols if not (with_text and c in ("input", "prompt"))]
    if with_text:
        payload.append(tx.text_of("input", "prompt").alias("text"))
    row = F.struct(*payload)
    base = df.select(
        ds.alias("dataset"),
        F.col("pair_id") if keyed else pair_key(legacy_suffix=legacy_suffix).alias("pair_id"),
        F.col("variant").cast("string").alias("_variant"),
        row_order(df, order_col, row).alias("_ord"),
        row_order(df, order_col, row, nulls_first=False).alias("_first"),
        row.alias("_row"),
    )
    variant = F.col("_variant")

    limited = max_pairs is not None and max_pairs >= 0
    aggs = [
        F.max_by("_row", F.when(variant == F.lit("clean"), F.col("_ord"))).alias("clean"),
        last_perturbed(F.col("_row"), variant, F.col("_ord")).alias("perturbed"),
    ]
    if limited:
        # First N keys per dataset in first-seen order, from narrow rows (literal bound -> WindowGroupLimit before the
        # exchange). Their bitmap drops the other pairs' rows before the texts are shuffled; the semi-join makes it exact.
        w = Window.partitionBy("dataset").orderBy(F.col("_first_seen"), F.col("pair_id"))
        seen = base.groupBy("dataset", "pair_id").agg(F.min("_first").alias("_first_seen"))
        chosen = seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(max_pairs)).select("dataset", "pair_id")
        base = base.where(may_contain(chosen, ["dataset", "pair_id"], max_pairs))
    pairs = base.groupBy("dataset", "pair_id").agg(*aggs)
    if limited:
        pairs = pairs.join(chosen, on=["dataset", "pair_id"], how="left_semi")
    if drop_incomplete:
        pairs = pairs.where(F.col("clean").isNotNull() & F.col("perturbed").isNotNull())
    out = pairs.withColumns({
        "task": F.coalesce(F.col("clean.task"), F.col("perturbed.task"), F.lit("")) if "task" in cols else F.lit(""),
        "split": F.coalesce(F.col("clean.split"), F.col("perturbed.split"), F.lit("")) if "split" in cols else F.lit(""),
    })
    if with_text:
        out = out.withColumns({"clean_text": F.col("clean.text"), "perturbed_text": F.col("perturbed.text")})
    return out


def inspector_pairs(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Pairs as the dataset inspector sees them.

    Falsy ``pair_id`` falls back to the id prefix, rows with neither are dropped,
    and the *first* row (by ``row_order``) per variant wins. Keeps the
    pair size (number of rows with that key) for the A13 histogram.
    """
    df = _ensure(df, ["pair_id", "id", "variant", "input", "prompt", "label"])
    row = F.struct(F.col("label"), tx.text_of("input", "prompt").alias("text"))
    base = df.select(
        inspector_pair_key().alias("pair_id"),
        F.col("variant").cast("string").alias("_variant"),
        row_order(df, order_col, row, nulls_first=False).alias("_ord"),
        row.alias("_row"),
    ).where(F.col("pair_id").isNotNull())

    def first_of(cond: Column) -> Column:
        return F.min_by(F.col("_row"), F.when(cond, F.col("_ord")))

    return base.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        first_of(F.col("_variant") == F.lit("clean")).alias("clean"),
        first_of(F.col("_variant").isin(*PERTURBED_VARIANTS)).alias("perturbed"),
    )
