"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pairshift.plans.queries import QUERIES
from pairshift.sources.tables import TABLES

from oracle_check import digest

SF = "/root/testdata/sf0.001"
FAST = ["build_nli_examples", "tokenizer_stats", "pair_rows", "robustness_report", "length_stats",
        "f1_per_example", "representation_shift", "pool_mean", "synthetic_qa", "scaling_table", "max_pairs_limit",
        "eval_prompt", "first_answer", "sample_per_split", "pair_rows_without_id", "vector_drift", "build_from_parallel", "cross_language_pivot",
        "counts_by_dim", "sweep_plan", "predict_hook", "filter_task", "distinct_models", "qa_f1_report", "efficiency_latency",
        "examples_jsonl_roundtrip", "examples_parquet_roundtrip", "metric_table_roundtrip", "metric_tables_layouts", "parallel_zip_file_order",
        "sample_n", "sample_half", "pair_table", "json_array_documents"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_declared():
    assert set(QUERIES) - set(oracle_sql()) == {"capacity_sweep"}
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and len(df.columns) == 14
