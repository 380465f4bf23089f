"""Scoring: token F1, accuracy, exact match, robustness drop and report.

Reports are one ``groupBy`` with conditional aggregates: a single shuffle of
already partially-aggregated rows, whatever the number of models or variants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.functions.draws import pick
from pairshift.functions.labels import BASELINE_LABELS, label_id, parse_nli_label
from pairshift.operators.pairing import PERTURBED_VARIANTS


def f1_inline(pred, gold) -> Column:
    """M1 per row, for short answers: multiset overlap by counting per distinct token.

    Quadratic in the answer length; use ``f1_per_example`` for long texts.
    """
    p, g = tx.answer_tokens(pred), tx.answer_tokens(gold)
    common = F.aggregate(
        F.array_distinct(p), F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))),
    )
    return _f1_from_counts(F.size(p), F.size(g), common)


def _f1_from_counts(np_: Column, ng: Column, common: Column) -> Column:
    prec = common / np_
    rec = common / ng
    return (
        F.when((np_ == 0) & (ng == 0), F.lit(1.0))
        .when((np_ == 0) | (ng == 0), F.lit(0.0))
        .when(common == 0, F.lit(0.0))
        .otherwise(2 * prec * rec / (prec + rec))
    )


def _common_tokens(p: Column, g: Column) -> Column:
    """Multiset overlap of two token arrays: one pass over both, sorted by token, gold before prediction.

    ``left`` counts the gold copies of the current token that no prediction token has met yet.
    """
    golds = F.transform(g, lambda t: F.struct(t.alias("tok"), F.lit(0).alias("p")))
    preds = F.transform(p, lambda t: F.struct(t.alias("tok"), F.lit(1).alias("p")))
    zero = F.struct(F.lit("").alias("tok"), F.lit(0).alias("left"), F.lit(0).alias("common"))

    def step(acc: Column, e: Column) -> Column:
        left = F.when(acc["tok"] == e["tok"], acc["left"]).otherwise(F.lit(0))
        met = F.when((e["p"] == 1) & (left > 0), F.lit(1)).otherwise(F.lit(0))
        return F.struct(e["tok"].alias("tok"), F.when(e["p"] == 0, left + 1).otherwise(left - met).alias("left"), (acc["common"] + met).alias("common"))

    return F.aggregate(F.sort_array(F.concat(golds, preds)), zero, step, lambda acc: acc["common"])


def _f1_terms(df: DataFrame, keys: Sequence[str], pred: str, gold: str) -> DataFrame:
    """``keys, tok, p, g, common``: one line per row whose keys no other row has, else one line per token and a marker."""
    k = list(keys)
    element = lambda tok, p, g, common: F.struct(
        tok.alias("tok"), F.lit(p).cast("long").alias("p"), F.lit(g).cast("long").alias("g"), common.cast("long").alias("common"))
    marker = element(F.lit(None).cast("string"), 0, 0, F.lit(0))
    whole = F.array(element(F.lit(None).cast("string"), F.size("_p"), F.size("_g"), _common_tokens(F.col("_p"), F.col("_g"))))
    tokens = F.concat(
        F.transform("_p", lambda t: element(t, 1, 0, F.lit(0))), F.transform("_g", lambda t: element(t, 0, 1, F.lit(0))), F.array(marker))
    rows = df.select(*k, F.col(pred).alias("_pred"), F.col(gold).alias("_gold")).repartition(*k)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*k)))
    rows = rows.select(*k, "_n", tx.answer_tokens("_pred").alias("_p"), tx.answer_tokens("_gold").alias("_g"))
    return rows.select(*k, F.explode(F.when(F.col("_n") == 1, whole).otherwise(tokens)).alias("_e")).select(*k, "_e.*")


def f1_per_example(df: DataFrame, keys: Sequence[str], pred: str = "prediction", gold: str = "label") -> DataFrame:
    """M1 at scale: token F1 per row keyed by ``keys`` (should be unique per row; rows of equal keys count as one text).

    The compact rows are dealt by their keys once. A row alone with its keys is counted where it stands, in one
    pass over its sorted tokens, so the aggregations hold one short line of it and not its tokens. Rows of
    repeated keys are exploded and counted per ``(keys, token)`` inside that partitioning. The second aggregation
    sums the sizes and the overlap ``least(n_pred, n_gold)``.
    """
    k = list(keys)
    counts = _f1_terms(df, k, pred, gold).groupBy(*k, "tok").agg(
        F.sum("p").alias("np"), F.sum("g").alias("ng"), F.sum("common").alias("whole"))
    out = counts.groupBy(*k).agg(
        F.sum("np").cast("int").alias("n_pred"),
        F.sum("ng").cast("int").alias("n_gold"),
        F.sum(F.when(F.col("tok").isNull(), F.col("whole")).otherwise(F.least("np", "ng"))).alias("common"),
    )
    return out.withColumn("f1", _f1_from_counts(F.col("n_pred"), F.col("n_gold"), F.col("common")))


def correct_normalized(pred, gold) -> Column:
    """A1/A2 per row: both sides normalised (T3) and compared."""
    return (tx.normalize_answer(pred) == tx.normalize_answer(gold)).cast("double")


def accuracy(df: DataFrame, by: Sequence[str], pred: str = "prediction", gold: str = "label") -> DataFrame:
    """A1: normalised accuracy per group (0 on an empty group cannot occur: groups have rows)."""
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(correct_normalized(pred, gold)), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).cast("long").alias("n"),
    )


def exact_match(df: DataFrame, by: Sequence[str], pred: str = "prediction", gold: str = "label") -> DataFrame:
    """A2: exact match is normalised accuracy under its QA name."""
    return accuracy(df, by, pred, gold).withColumnRenamed("accuracy", "exact_match")


def mean_f1(f1_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """A3: mean of per-example F1 per group."""
    return f1_rows.groupBy(*by).agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).cast("long").alias("n"))


def robustness_drop(df: DataFrame, by: Sequence[str], pred: str = "prediction", gold: str = "label") -> DataFrame:
    """A5: clean minus perturbed accuracy with lower+strip comparison (no parsing).

    An empty side gives a null accuracy and so a null drop (NaN in the original).
    """
    ok = (F.lower(tx.strip_ws(F.col(pred).cast("string"))) == F.lower(tx.strip_ws(F.col(gold).cast("string")))).cast("double")
    is_clean = F.col("variant") == F.lit("clean")
    is_mix = F.col("variant").isin(*PERTURBED_VARIANTS)
    g = df.groupBy(*by).agg(
        F.avg(F.when(is_clean, ok)).alias("clean_accuracy"),
        F.avg(F.when(is_mix, ok)).alias("perturbed_accuracy"),
    )
    return g.withColumn("robustness_drop", F.col("clean_accuracy") - F.col("perturbed_accuracy"))


def qa_f1_report(predictions: DataFrame, by: Sequence[str] = ("language_pair", "model"), id_col: str = "id") -> DataFrame:
    """QA by mean token F1: clean and perturbed means, their difference and counts (the evaluator's QA metric)."""
    qa = predictions.where(F.col("task") == F.lit("qa"))
    f = f1_per_example(qa, [*by, id_col, "variant"])
    clean, mix = F.col("variant") == F.lit("clean"), F.col("variant").isin(*PERTURBED_VARIANTS)
    g = f.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(clean, F.col("f1"))), F.lit(0.0)).alias("clean_f1"),
        F.coalesce(F.avg(F.when(mix, F.col("f1"))), F.lit(0.0)).alias("switchmix_f1"),
        F.count(F.when(clean, 1)).cast("long").alias("n_clean"), F.count(F.when(mix, 1)).cast("long").alias("n_switchmix"))
    return g.select(*by, "clean_f1", "switchmix_f1", (F.col("clean_f1") - F.col("switchmix_f1")).alias("robustness_drop"), "n_clean", "n_switchmix")


def robustness_report(
    predictions: DataFrame,
    by: Sequence[str] = ("language_pair", "task", "model"),
) -> DataFrame:
    """Robustness summary per (language pair, task, model).

    NLI: the prediction is parsed (T6, no verb forms) and compared with the raw
    label (A4). QA: normalised exact match (A2). Scores are
    ``correct / max(1, n)``; ``switchmix`` and ``perturbed`` both count as the
    perturbed side.
    """
    nli = F.col("task") == F.lit("nli")
    ok = F.when(nli, (parse_nli_label(F.col("prediction"), variants=False) == F.col("label").cast("string")).cast("double")) \
        .otherwise(correct_normalized("prediction", "label"))
    is_clean = F.col("variant") == F.lit("clean")
    is_mix = F.col("variant").isin(*PERTURBED_VARIANTS)
    g = predictions.withColumn("_ok", ok).groupBy(*by).agg(
        F.sum(F.when(is_clean, F.col("_ok")).otherwise(0.0)).alias("_cs"),
        F.sum(F.when(is_mix, F.col("_ok")).otherwise(0.0)).alias("_ms"),
        F.count(F.when(is_clean, 1)).cast("long").alias("n_clean"),
        F.count(F.when(is_mix, 1)).cast("long").alias("n_switchmix"),
    )
    clean = F.col("_cs") / F.greatest(F.lit(1), F.col("n_clean"))
    mix = F.col("_ms") / F.greatest(F.lit(1), F.col("n_switchmix"))
    return g.select(
        *by,
        F.when(F.col("task") == F.lit("nli"), F.lit("accuracy")).otherwise(F.lit("exact_match")).alias("metric"),
        clean.alias("clean_score"), mix.alias("switchmix_score"), (clean - mix).alias("robustness_drop"),
        "n_clean", "n_switchmix",
    )


def baseline_random(examples: DataFrame, seed=42, model: str = "baseline_random") -> DataFrame:
    """Random-label predictions (NLI: one of three labels; QA: empty string).

    Seeded per example id, so the baseline is reproducible (the original is not).
    """
    pred = F.when(F.col("task") == F.lit("nli"), pick(BASELINE_LABELS, seed, "baseline", F.col("id"))).otherwise(F.lit(""))
    return examples.withColumns({"prediction": pred, "model": F.lit(model)})


def argmax_first(logits) -> Column:
    """M8: index of the first maximum (0-based)."""
    c = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def nli_validity(df: DataFrame) -> DataFrame:
    """F8: ``_valid`` = premise and hypothesis non-empty and a known label; ``_label_id``."""
    prem, hyp = tx.prompt_fields()
    lid = label_id(F.col("label"))
    valid = (F.coalesce(F.length(prem), F.lit(0)) > 0) & (F.coalesce(F.length(hyp), F.lit(0)) > 0) & lid.isNotNull()
    return df.withColumns({"_valid": valid, "_label_id": lid})


def scaling_table(
    logits: DataFrame,
    sizes: DataFrame,
    train_split: str = "train",
    test_split: str = "test",
    clean_variant: str = "clean",
    pert_variant: str = "perturbed",
    seed: int = 42,
) -> DataFrame:
    """Clean vs perturbed classifier accuracy per model, with skip counts and size.

    ``logits``: examples (NLI) with ``model`` and a 3-way ``logits`` array. Rows
    with an empty premise/hypothesis or unknown label are skipped and counted.
    One pass with conditional aggregates, then a left join with the small size table.
    """
    v = nli_validity(logits.where(F.col("task") == F.lit("nli")))
    hit = (argmax_first("logits") == F.col("_label_id")).cast("double")
    s, var = F.col("split"), F.col("variant")
    tr = (s == train_split) & (var == clean_variant)
    tc = (s == test_split) & (var == clean_variant)
    tp = (s == test_split) & (var == pert_variant)
    valid = F.col("_valid")
    g = v.groupBy("model").agg(
        F.count(F.when(tr & valid, 1)).cast("long").alias("n_train"),
        F.count(F.when(tc & valid, 1)).cast("long").alias("n_test_clean"),
        F.count(F.when(tp & valid, 1)).cast("long").alias("n_test_perturbed"),
        F.count(F.when(tr & ~valid, 1)).cast("long").alias("train_skipped"),
        F.count(F.when(tc & ~valid, 1)).cast("long").alias("test_clean_skipped"),
        F.count(F.when(tp & ~valid, 1)).cast("long").alias("test_perturbed_skipped"),
        F.coalesce(F.avg(F.when(tc & valid, hit)), F.lit(0.0)).alias("clean_accuracy"),
        F.coalesce(F.avg(F.when(tp & valid, hit)), F.lit(0.0)).alias("perturbed_accuracy"),
    )
    g = g.join(F.broadcast(sizes), on="model", how="left")
    drop = F.col("clean_accuracy") - F.col("perturbed_accuracy")
    return g.select(
        F.lit("nli").alias("task"), "model", F.lit(seed).alias("seed"),
        F.lit(train_split).alias("train_split"), F.lit(test_split).alias("test_split"),
        "n_train", "n_test_clean", "n_test_perturbed", "train_skipped", "test_clean_skipped", "test_perturbed_skipped",
        "clean_accuracy", "perturbed_accuracy", drop.alias("robustness_gap_delta"),
        F.col("model").alias("model_name"), F.col("estimated_model_size"),
        F.col("perturbed_accuracy").alias("switchmix_accuracy"), drop.alias("robustness_drop"),
    )
