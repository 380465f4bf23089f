"""Pairing rules, dense index, and the analysis tables' shapes and bounds (the reference's module tests)."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairshift.operators import pairing, reports, vectors
from pairshift.operators import tokens as tk
from pairshift.operators.index import with_dense_index

EX_SCHEMA = "id string, pair_id string, task string, split string, variant string, input string, prompt string, label string"


def _toy(spark):
    rows = [
        ("ex1_clean", "ex1", "nli", "test", "clean", "Le chat est sur le tapis.", None, "entailment"),
        ("ex1_pert", "ex1", "nli", "test", "perturbed", "Le chat est on the rug.", None, "entailment"),
    ]
    return spark.createDataFrame(rows, EX_SCHEMA)


def test_pairing_rules(spark):
    rows = [
        ("p1__clean", None, "nli", "train", "clean", "old", None, "x"),
        ("p1__clean~2", "p1", "nli", "train", "clean", "new", None, "x"),   # larger id: last wins
        ("p1__perturbed", None, "nli", "train", "switchmix", "mix", None, "x"),
        ("p2__clean", "p2", "qa", "test", "clean", "", "from prompt", "y"),
        ("p2__perturbed", "p2", "qa", "test", "perturbed", "pert", None, "y"),
        ("p2__switchmix", "p2", "qa", "test", "switchmix", "legacy", None, "y"),
        ("lonely", "p3", "nli", "test", "clean", "alone", None, "z"),
        ("", None, "nli", "test", "clean", "k1", None, "z"),        # keyless rows share the "" pair
        ("", None, "nli", "test", "perturbed", "k2", None, "z"),
        (None, None, "nli", "test", "clean", "ignored", None, "z"),  # no id: the "" pair, before any row with an id
    ]
    df = spark.createDataFrame(rows, EX_SCHEMA)
    got = {r.pair_id: r for r in pairing.pair_rows(df).collect()}
    assert set(got) == {"p1", "p2", ""}
    assert got["p1"].clean_text == "new" and got["p1"].perturbed_text == "mix"
    assert got["p2"].clean_text == "from prompt" and got["p2"].perturbed_text == "pert"
    assert got[""].clean_text == "k1"
    # first-seen order by smallest id: "" (id ""), p3 ("lonely"), p1, p2 -> the first two keys are
    # taken before incomplete pairs are dropped, so only "" survives
    limited = {r.pair_id for r in pairing.pair_rows(df, max_pairs=2).collect()}
    assert limited == {""}


def test_dense_index_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"), (F.col("id") % 3).alias("g")).repartition(13)
    got = with_dense_index(df, ["k"], ["g"]).select("g", "k", "idx")
    ref = df.withColumn("idx", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert sorted(got.collect()) == sorted(ref.select("g", "k", "idx").collect())


def test_tokenizer_stats_shape_and_bounds(spark):
    st = tk.tokenizer_stats(_toy(spark), "positions", tokenizer_name="fake").collect()
    assert len(st) >= 1
    r = st[0].asDict()
    assert len(r) == 14
    for k, v in r.items():
        if isinstance(v, float):
            assert math.isfinite(v) and v >= 0, k
    assert r["n_pairs"] == 1 and r["avg_clean_tokens"] == 6 and r["avg_perturbed_tokens"] == 6


def test_representation_shift_identical_states(spark):
    rows = [("f", "nli", "test", "ex1", v, layer, [1.0] * 8) for v in ("clean", "perturbed") for layer in range(3)]
    df = spark.createDataFrame(rows, "dataset string, task string, split string, pair_id string, variant string, layer int, vector array<double>")
    out = vectors.representation_shift(df).collect()
    assert len(out) == 3 and len(out[0]) == 10
    for r in out:
        assert r.mean_cosine == pytest.approx(1.0)
        assert r.mean_drift == pytest.approx(0.0, abs=1e-12)
        assert -1.0 <= r.mean_cosine <= 1.0 + 1e-12


def test_cosine_zero_vector_and_dimension_check(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine("a", "b").alias("c")).collect()[0].c == 0.0
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        bad.select(vectors.cosine("a", "b")).collect()


def test_mean_pool_mask(spark):
    rows = [("d", "t", "s", "p", "clean", 0, [1.0, 2.0], 1), ("d", "t", "s", "p", "clean", 1, [3.0, 4.0], 0),
            ("d", "t", "s", "q", "clean", 0, [5.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "dataset string, task string, split string, pair_id string, variant string, pos int, vector array<double>, mask int")
    got = {r.pair_id: r.vector for r in vectors.pool(df, "mean").collect()}
    assert got["p"] == [1.0, 2.0] and got["q"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.pool(df, "max")


def test_efficiency_summary_shape(spark):
    out = reports.efficiency_summary(_toy(spark), "fake", reports.hidden_size_from_config({"hidden_size": 8}), "positions").collect()
    r = out[0]
    assert r.avg_seq_len_delta >= 0 and r.hidden_size == 8
    assert r.activation_bytes_clean_est == 6 * 8 * 4
    assert reports.hidden_size_from_config({}) == 768
    assert reports.hidden_size_from_config({"d_model": 512, "dim": 3}) == 512


def test_model_size_lookup_unknown_is_null(spark):
    df = spark.createDataFrame([("xlm-roberta-base",), ("nope",)], "model string")
    got = {r.model: r.estimated_model_size for r in reports.model_size_lookup(df).collect()}
    assert got == {"xlm-roberta-base": 270, "nope": None}


def test_paper_table_requires_columns(spark):
    df = spark.createDataFrame([("m", "fr-en", 0.5)], "model string, language_pair string, clean_accuracy double")
    with pytest.raises(ValueError, match="missing required columns"):
        reports.paper_table(df)


def test_legacy_suffix_pairing_is_opt_in(spark):
    rows = [("x1_clean", None, "nli", "test", "clean", "a", None, "l"), ("x1_switchmix", None, "nli", "test", "switchmix", "b", None, "l")]
    df = spark.createDataFrame(rows, EX_SCHEMA)
    assert pairing.pair_rows(df).count() == 0
    got = pairing.pair_rows(df, legacy_suffix=True).collect()
    assert [(r.pair_id, r.clean_text, r.perturbed_text) for r in got] == [("x1", "a", "b")]


def test_build_from_parallel_with_quotas(spark):
    from pairshift.operators import build

    base = spark.createDataFrame(
        [(f"b{i}", "train" if i % 4 else "test", i // 1, f"p{i} un deux trois quatre cinq six", f"h{i}", i % 3) for i in range(40)],
        "id string, split string, idx long, premise string, hypothesis string, label int")
    ins = spark.createDataFrame(
        [("train" if i % 4 else "test", i, f"one two three four five six {i}", f"hyp {i}") for i in range(30)],
        "split string, idx long, premise string, hypothesis string")
    ex = build.build_from_parallel(base, ins, "nli", "toy", quotas={"train": 5, "test": 2})
    counts = {r.split: r["count"] for r in ex.groupBy("split").count().collect()}
    assert counts == {"train": 10, "test": 4}
    full = build.build_from_parallel(base, ins, "nli", "toy")
    assert full.count() == 2 * 30


def test_dense_index_sparse_and_negative_keys(spark):
    df = spark.range(0, 300).select((F.xxhash64("id")).alias("k"))
    got = with_dense_index(df, ["k"]).select("k", "idx")
    ref = df.withColumn("idx", F.row_number().over(Window.orderBy("k")) - 1)
    assert sorted(got.collect()) == sorted(ref.collect())


def test_dense_index_starts_no_job(spark):
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    with_dense_index(spark.range(1000).withColumnRenamed("id", "k"), ["k"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == seen


def test_dense_index_strings(spark):
    df = spark.range(0, 300).select(F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 2).alias("g"))
    got = with_dense_index(df, ["k"], ["g"]).select("g", "k", "idx")
    ref = df.select("g", "k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).alias("idx"))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_dense_index_composite_integer_order(spark):
    df = spark.range(0, 3000).select((F.col("id") % 37).alias("a"), (F.col("id") * 7 % 1000003).alias("b"))
    got = with_dense_index(df, ["a", "b"]).select("a", "b", "idx")
    ref = df.withColumn("idx", F.row_number().over(Window.orderBy("a", "b")) - 1)
    assert sorted(got.collect()) == sorted(ref.collect())
    neg = df.withColumn("a", -F.col("a"))
    got = with_dense_index(neg, ["a", "b"]).select("a", "b", "idx")
    ref = neg.withColumn("idx", F.row_number().over(Window.orderBy("a", "b")) - 1)
    assert sorted(got.collect()) == sorted(ref.collect())


def test_equal_ids_come_out_alike_in_any_order(spark):
    rows = [("p1__c", "p1", "nli", "t", "clean", x, None, "l") for x in ("first", "second", "third")]
    rows.append(("p1__p", "p1", "nli", "t", "perturbed", "x", None, "l"))
    got = set()
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[3], rows[2]]):
        df = spark.createDataFrame(order, EX_SCHEMA).coalesce(1)
        got.add(pairing.pair_rows(df).collect()[0].clean_text)
    assert len(got) == 1


def test_vector_pairing_follows_the_pairing_rules(spark):
    rows = [("d", "t", "s", "p", 0, "clean", 0, [1.0, 0.0]), ("d", "t", "s", "p", 0, "switchmix", 5, [0.0, 1.0]),
            ("d", "t", "s", "p", 0, "perturbed", 1, [0.0, 1.0]), ("d", "t", "s", "p", 0, "perturbed", 2, [1.0, 0.0])]
    schema = "dataset string, task string, split string, pair_id string, layer int, variant string, pos int, vector array<double>"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).coalesce(1)
        assert vectors.paired_vectors(df, order_col="pos").collect()[0].perturbed == [1.0, 0.0]
        assert len({tuple(r.perturbed) for r in vectors.paired_vectors(df).collect()}) == 1


def test_inspection_edges(spark):
    from pairshift.functions import text as tx
    from pairshift.operators import inspect

    rows = [("a", "p", "nli", "t", None, "x", None, "l"), ("b", "p", "nli", "t", "", "y", None, "l"), ("c", "p", "nli", "t", "clean", "zz", None, "l")]
    df = spark.createDataFrame(rows, EX_SCHEMA)
    assert {(r.dimension, r.value): r.n_rows for r in inspect.counts_by_dim(df).collect()}["variant", ""] == 2
    got = {r.side: (r.n, r["mean"], r["max"]) for r in inspect.length_stats(df).collect()}
    assert got == {"clean": (1, 2.0, 2.0), "perturbed": (0, 0.0, 0.0)}
    prem, hyp = tx.prompt_fields()
    p = spark.createDataFrame([("Premise: a\u2028Hypothesis: b\rx", None, None, None)], "input string, prompt string, text_a string, text_b string")
    assert [(r.p, r.h) for r in p.select(prem.alias("p"), hyp.alias("h")).collect()] == [("a", "b")]


def test_distinct_values_are_sorted(spark):
    df = spark.createDataFrame([("b", "fr-en"), ("a", "fr-en"), ("b", "fr-de")], "model string, language_pair string")
    assert [tuple(r) for r in reports.distinct_values(df).collect()] == [
        ("language_pair", "fr-de"), ("language_pair", "fr-en"), ("model", "a"), ("model", "b")]


def test_tokenizer_stats_tokenizes_once(spark):
    """After execution one exchange of entries is left; the other branches reuse it, so the explode runs once."""
    ex = _toy(spark)
    df = tk.tokenizer_stats(ex, "simple")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("Generate explode(concat(array(struct(kind") == 1 and "ReusedExchange" in final
