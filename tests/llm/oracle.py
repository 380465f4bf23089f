"""A registered query against its DuckDB SQL on a whole table."""

import duckdb

from pairshift.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def same_as_sql(spark, name, sf=SF, tables=("documents", "pages")):
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    want = sorted(map(str, res.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want
    return len(want)
