import hashlib
import random

import pytest

from oracle import same_as_sql
from pairshift.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, kept = [], set()
    for i, t in rows:
        g = groups[t or ""]
        best = max((x for x in g if x is not None), default=None)
        first = i == best and (t or "") not in kept
        if first:
            kept.add(t or "")
        out.append((i, best, len(g), first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_whole_table(spark):
    assert same_as_sql(spark, "op1_exact_dedup") == 1000


def rows_of_all_kinds():
    r = random.Random(3)
    texts = ["", None, "a", "A", "a ", "é", "x" * 300_000, *("t%d" % r.randint(0, 30) for _ in range(400))]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, texts[7]), (7, texts[7]), (None, "a"), (None, "only null id"), (None, "only null id"), (3, "another text, same id")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("table_bytes", [48 << 20, 2000])
def test_all_kinds_of_rows(spark, table_bytes):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS keep_id", "'k' AS kept", "2 AS h", "3 AS id").repartition(5)
    got = ed.exact_dedup(df, table_bytes=table_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_rows_that_stay_keep_all_columns(spark):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame([(i, t, f"src{k % 3}", k % 5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, payload string, text_is_null int")
    got = ed.drop_exact_copies(df, table_bytes=2000)
    assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    stay = [tuple(r) for r in got.collect()]
    assert len(stay) == len({t or "" for _, t in rows})
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert all((-1 if r[0] is None else r[0]) == best[r[1] or ""] for r in stay)
    assert set(stay) <= {tuple(r) for r in df.collect()}


def test_open_addressing_table_compares_contents_under_equal_hashes():
    t = ed.ContentTable()
    for k in range(3000):
        t.add(k % 7, f"text {k % 1000}", k, 1, None, 10)
    assert len(t) == len({(k % 7, k % 1000) for k in range(3000)})
    gone = t.remove(lambda h: h < 3)
    t.drop(gone)
    assert all(h >= 3 for h in t.hashes) and t.bytes == 10 * len(t)
    n = len(t)
    t.add(5, t.texts[t.hashes.index(5)], 9999, 1, None, 10)
    assert len(t) == n


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_dedup(empty).count() == 0 and ed.drop_exact_copies(empty).count() == 0
