"""Plan properties the design relies on, and property-based checks of the text scalars."""

import io
import contextlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.operators import build, pairing
from pairshift.operators import tokens as tk
from pairshift.sources import tables as tb

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_language_filter_and_columns_reach_the_scan(spark):
    s = _plan(tb.read_table(spark, SF, "documents").where(F.col("lang") == "fr").select("doc_id", "text"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in s
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in s


def test_limited_windows_use_window_group_limit(spark):
    p = tb.nli_pairs(spark, SF).select("pair_id", "split")
    assert "WindowGroupLimit" in _plan(build.sample_per_split(p, {"train": 3, "test": 2}, "pair_id"))
    ex = tb.nli_examples(spark, SF).withColumn("dataset", F.col("split"))
    assert "WindowGroupLimit" in _plan(pairing.pair_rows(ex, dataset_col="dataset", max_pairs=5))
    # a single (literal) dataset: no partitioning left, Spark plans a top-k instead
    one = tb.nli_examples(spark, SF).withColumn("dataset", F.lit("d"))
    assert "TakeOrderedAndProject" in _plan(pairing.pair_rows(one, dataset_col="dataset", max_pairs=5))


def test_token_histogram_aggregates_before_the_shuffle(spark):
    ex = tb.nli_examples(spark, SF).withColumn("dataset", F.lit("d"))
    s = _plan(tk.token_histogram(pairing.pair_rows(ex, dataset_col="dataset"), "whitespace"))
    assert "partial_sum" in s
    assert "Generate" in s


def test_sample_n_gathers_no_n_rows(spark, monkeypatch):
    """Equal to a sort by draw for any n, with few rows a place and with many; one range exchange moves whole rows."""
    from pairshift.functions.draws import u01
    from pairshift.operators import select

    docs = spark.range(3000).selectExpr("id AS k", "id % 7 AS v").repartition(7)
    want = [tuple(r) for r in docs.withColumn("d", u01(42, "sample", F.col("k"))).orderBy("d", "k").drop("d").collect()]
    for bits, levels, sizes in ((12, 2, (-1, 0, 1, 1234, 2999, 3000, 5000)), (2, 1, (1, 700, 3000)), (1, 3, (5, 1500))):
        monkeypatch.setattr(select, "LEVEL_BITS", bits)
        monkeypatch.setattr(select, "LEVELS", levels)
        for n in sizes:
            assert [tuple(r) for r in build.sample_n(docs, n, "k").collect()] == want[: max(n, 0)], (bits, n)
    plan = _plan(build.sample_n(docs, 2000, "k"))
    assert "TakeOrderedAndProject" not in plan and "Join" not in plan and "CollectLimit" not in plan
    assert build.sample_n(docs.where("k < 0"), 5, "k").count() == 0


def test_bitmap_of_keys_never_drops_a_key(spark):
    from pairshift.operators.select import may_contain

    rows = spark.range(20_000).selectExpr("id % 500 AS a", "cast(id AS string) AS b")
    keys = rows.where("a < 5")
    kept = rows.where(may_contain(keys, ["a", "b"], 200))
    assert kept.where("a < 5").count() == 200 and kept.count() < 2500
    assert rows.where(may_contain(keys.where("a < 0"), ["a"], 0)).count() == 0
    assert rows.where(may_contain(rows, ["b"], 1)).count() == 20_000  # far more keys than expected: all pass


def test_max_pairs_drops_the_other_texts_before_the_shuffle(spark):
    """The bitmap stands below the pairing exchange; rows that reach it are those of the chosen pairs and few others."""
    ex = tb.nli_examples(spark, SF).withColumn("dataset", F.col("split"))
    full = pairing.pair_rows(ex, dataset_col="dataset")
    some = pairing.pair_rows(ex, dataset_col="dataset", max_pairs=2)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and plan.index("max_by") < plan.index("getbit")
    chosen = {(r["dataset"], r["pair_id"]) for r in some.collect()}
    first = {}
    for r in sorted(ex.select("dataset", "pair_id", "id").collect(), key=lambda r: r["id"]):
        if r["pair_id"] not in (ids := first.setdefault(r["dataset"], [])):
            ids.append(r["pair_id"])
    assert chosen == {(k, p) for k, ids in first.items() for p in ids[:2]}
    by = {(r["dataset"], r["pair_id"]): r for r in full.collect()}
    assert all(by[r["dataset"], r["pair_id"]] == r for r in some.collect())


def test_file_order_over_many_files(spark):
    import tempfile

    from pairshift.sources.io import read_in_file_order

    d = tempfile.mkdtemp(prefix="pairshift-test-") + "/t"
    spark.range(0, 1000, 1, 7).selectExpr("id AS k", "id * 3 AS idx_start", "'x' AS `odd.name`").write.parquet(d)
    df = read_in_file_order(spark, d, out="place")
    got = df.collect()
    assert [(r["k"], r["idx_start"]) for r in sorted(got, key=lambda r: r["place"])] == [(i, 3 * i) for i in range(1000)]
    assert sorted(r["place"] for r in got) == list(range(1000)) and df.columns == ["k", "idx_start", "odd.name", "place"]
    plan = _plan(build.parallel_zip(df.select("place", "k"), df.select("place", "k"), on=("place",)))
    assert "BroadcastHashJoin" in plan and "row_index" in plan


WS_CHARS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
            " ", " ", " ", " ", "　"]
ALPHABET = st.sampled_from(WS_CHARS + list("ab,.!?-_é") + ["​", "́", "😀"])


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=200, max_size=200))
def test_whitespace_scalars_match_python_on_random_strings(spark, strings):
    import re

    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    rows = df.select("i", tx.ws_tokens("s").alias("t"), tx.simple_tokenize("s").alias("k"),
                     tx.chars_no_ws("s").alias("c"), tx.strip_ws("s").alias("x")).collect()
    for r in rows:
        s = strings[r.i]
        assert r.t == s.split()
        assert r.k == re.findall(r"\w+|[^\w\s]", s)
        assert r.c == sum(1 for ch in s if not ch.isspace())
        assert r.x == s.strip()


def test_hot_pair_key_is_reduced_map_side(spark):
    ex = tb.nli_examples(spark, SF).select("id", "pair_id", "task", "split", "variant", "input", "prompt")
    n = ex.count()
    hot = spark.range(0, n // 2).select(
        F.lit("").alias("id"), F.lit(None).cast("string").alias("pair_id"), F.lit("nli").alias("task"),
        F.lit("test").alias("split"),
        F.when(F.col("id") % 2 == 0, F.lit("clean")).otherwise(F.lit("perturbed")).alias("variant"),
        F.concat(F.lit("hot "), F.col("id").cast("string")).alias("input"), F.lit(None).cast("string").alias("prompt"))
    both = ex.unionByName(hot).repartition(8)
    p = pairing.pair_rows(both)
    s = _plan(p)
    assert "partial_max_by" in s
    got = {r.pair_id: r for r in p.collect()}
    assert len(got) == n // 2 + 1 and "" in got
    assert got[""].clean_text.startswith("hot ") and got[""].perturbed_text.startswith("hot ")


def test_queries_that_read_no_perturbed_column_compute_none(spark):
    from pairshift.plans.queries import QUERIES

    for name in ("filter_task_split", "first_n_examples", "counts_by_dim"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan, name


def test_building_queries_starts_no_job(spark):
    from pairshift.plans.queries import QUERIES

    tb.read_table(spark, SF, "documents")  # the reader's own schema job may run first
    for name in ("build_nli_examples", "cross_language", "tokenizer_stats", "max_pairs_limit"):
        spark.sparkContext.setJobGroup(f"build-{name}", "")
        try:
            QUERIES[name](spark, SF)
        finally:
            ids = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}")
            spark.sparkContext.setJobGroup("rest", "")
        # reading a table's schema from its footer is Spark's own single-task job, one per scan
        infos = [spark.sparkContext.statusTracker().getJobInfo(i) for i in ids]
        assert all(len(i.stageIds) == 1 for i in infos if i is not None), name


def test_key_columns_of_a_frame_do_not_leak_into_the_next(spark):
    from pairshift.functions.perturb import with_perturbation

    for _ in range(2):
        df = spark.createDataFrame([("p", "test", "le chat et le chien dorment ici", "x y z u v w")], "pair_id string, split string, a string, b string")
        out = with_perturbation(df, "a", "b", [df["split"], df["pair_id"]], "a", "leak", 42).collect()
        assert len(out) == 1
