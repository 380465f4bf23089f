"""Result tables: model sizes, efficiency summary, cross-language views, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.operators.pairing import pair_rows
from pairshift.operators.tokens import GROUP, get_tokenizer

# FIXED VALUES: approximate parameter counts (millions) of known models.
MODEL_SIZE_MILLIONS = {
    "distilbert-base-multilingual-cased": 134,
    "bert-base-multilingual-cased": 179,
    "xlm-roberta-base": 270,
    "xlm-roberta-large": 550,
    "google/flan-t5-small": 80,
    "google/flan-t5-base": 250,
}
DEFAULT_HIDDEN_SIZE = 768
PAPER_COLUMNS = ["model", "language_pair", "clean_accuracy", "switchmix_accuracy", "robustness_drop"]


def model_sizes(spark: SparkSession, sizes: Mapping[str, int] = MODEL_SIZE_MILLIONS) -> DataFrame:
    """The size table as a DataFrame (fixed, six rows: safe to broadcast)."""
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("estimated_model_size", T.LongType())])
    return spark.createDataFrame([(k, int(v)) for k, v in sizes.items()], schema)


def model_size_lookup(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Distinct models with their size; unknown models get null."""
    sizes = model_sizes(df.sparkSession).withColumnRenamed("model", model_col)
    return df.select(model_col).distinct().join(F.broadcast(sizes), on=model_col, how="left")


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "table") -> DataFrame:
    """raise with the list of missing columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def hidden_size_from_config(config: Mapping[str, object]) -> int:
    """``hidden_size``, else ``d_model``, else ``dim`` (integers only), else 768."""
    for key in ("hidden_size", "d_model", "dim"):
        v = config.get(key)
        if isinstance(v, int) and not isinstance(v, bool):
            return v
    return DEFAULT_HIDDEN_SIZE


def efficiency_summary(
    examples: DataFrame,
    model: str,
    hidden_size: int,
    tokenizer="simple",
    max_length: int = 256,
    device: str = "cpu",
    dataset_col: str | None = None,
    latency_col: str | None = None,
    include_tokenization_time: bool = False,
    dtype_bytes: int = 4,
    max_pairs: int | None = None,
) -> DataFrame:
    """A11 with M6/M7: mean truncated lengths, latencies and activation-memory estimates.

    Grouped by (dataset, task, split). Sequence length is ``min(tokens,
    max_length)``; activation bytes use the mean length rounded half-to-even.
    Latency is averaged from ``latency_col`` (a per-row milliseconds column,
    read from the clean and the perturbed row of each pair) when given, else 0.
    ``max_pairs`` keeps the first N pairs per dataset (the original default was 200).
    """
    tok = get_tokenizer(tokenizer)
    keep = ["id", "task", "split", "input", "prompt"] + ([latency_col] if latency_col else [])
    pairs = pair_rows(examples, keep=keep, dataset_col=dataset_col, max_pairs=max_pairs)
    ml = F.lit(max_length)
    df = pairs.select(
        *GROUP,
        F.least(F.size(tok(F.col("clean_text"))), ml).alias("c"),
        F.least(F.size(tok(F.col("perturbed_text"))), ml).alias("p"),
        (F.col(f"clean.{latency_col}") if latency_col else F.lit(None).cast("double")).alias("lc"),
        (F.col(f"perturbed.{latency_col}") if latency_col else F.lit(None).cast("double")).alias("lp"),
    )
    g = df.groupBy(*GROUP).agg(
        F.count(F.lit(1)).cast("long").alias("n_pairs"),
        F.avg("c").alias("avg_seq_len_clean"), F.avg("p").alias("avg_seq_len_perturbed"),
        F.coalesce(F.avg("lc"), F.lit(0.0)).alias("avg_latency_ms_clean"),
        F.coalesce(F.avg("lp"), F.lit(0.0)).alias("avg_latency_ms_perturbed"),
    )
    hs = F.lit(int(hidden_size)).cast("long")
    act_c = F.bround(F.col("avg_seq_len_clean"), 0).cast("long") * hs * dtype_bytes
    act_p = F.bround(F.col("avg_seq_len_perturbed"), 0).cast("long") * hs * dtype_bytes
    return g.select(
        F.col("dataset").alias("data_path"), "task", "split", F.lit(model).alias("model"), F.lit(device).alias("device"),
        F.lit(max_length).alias("max_length"), "n_pairs", "avg_seq_len_clean", "avg_seq_len_perturbed",
        (F.col("avg_seq_len_perturbed") - F.col("avg_seq_len_clean")).alias("avg_seq_len_delta"),
        "avg_latency_ms_clean", "avg_latency_ms_perturbed",
        (F.col("avg_latency_ms_perturbed") - F.col("avg_latency_ms_clean")).alias("avg_latency_ms_delta"),
        hs.alias("hidden_size"),
        act_c.alias("activation_bytes_clean_est"), act_p.alias("activation_bytes_perturbed_est"),
        (act_p - act_c).alias("activation_bytes_delta_est"),
        F.lit(include_tokenization_time).alias("include_tokenization_time"),
    )


def cross_language(summaries: DataFrame) -> DataFrame:
    """Robustness summaries of several language pairs as one table.

    ``summaries`` carries ``language_pair`` (from the file name, IO11, or the
    group key); score columns are renamed to accuracies; missing ones are null.
    """
    cols = {c: (F.col(c) if c in summaries.columns else F.lit(None).cast("double")) for c in
            ("clean_score", "switchmix_score", "robustness_drop")}
    return summaries.select(
        "language_pair", "model",
        cols["clean_score"].alias("clean_accuracy"),
        cols["switchmix_score"].alias("switchmix_accuracy"),
        cols["robustness_drop"].alias("robustness_drop"),
    )


def cross_language_pivot(table: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Mean drop per (language pair, model) as a pivot; absent combinations 0.0.

    Passing ``models`` avoids the extra job Spark runs to find pivot values.
    """
    g = table.groupBy("language_pair")
    p = g.pivot("model", list(models)) if models is not None else g.pivot("model")
    out = p.agg(F.avg("robustness_drop"))
    value_cols = [c for c in out.columns if c != "language_pair"]
    return out.fillna(0.0, subset=value_cols).orderBy("language_pair")


def distinct_values(table: DataFrame, columns: Sequence[str] = ("model", "language_pair")) -> DataFrame:
    """O3: the distinct values of each column, in order."""
    each = [table.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
    return reduce(lambda a, b: a.unionByName(b), each).orderBy("column", "value")


def paper_table(table: DataFrame) -> DataFrame:
    """U4 (+F9): the five paper columns in order."""
    return require_columns(table, PAPER_COLUMNS, "cross-language table").select(*PAPER_COLUMNS)


def all_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Outer union of result tables by column name (missing columns null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
