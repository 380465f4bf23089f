import random
from collections import Counter

from pairshift.llm import shared_passages as sp
from pairshift.llm.queries import QUERIES


def sharing(rows, n):
    """Per row: whether another row has some n neighbouring words of it."""
    have = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in ((t or "").encode().split() for _, t in rows)]
    times = Counter(x for c in have for x in c)
    return [any(times[x] > 1 for x in c) for c in have]


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS text_key", "3 AS key", "4 AS n", "5 AS body")


def sample():
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["é", "a\x1cb", " "]
    passage = [" ".join(r.choices(words, k=k)) for k in (9, 10, 11, 30)]
    rows = []
    for i in range(200):
        parts = [" ".join(r.choices(words, k=r.randint(0, 25)))] + r.choices(passage, k=r.randint(0, 2)) + [" ".join(r.choices(words, k=r.randint(0, 25)))]
        rows.append((i, r.choice([" ", "\n", "\t\x0b"]).join(parts)))
    return [*rows, (300, None), (301, ""), (None, passage[3]), (302, passage[3]), (302, passage[3]), (303, "only once " * 40), (304, "w1 " * 9)]


def check(got, keys, rows, words, gram):
    """Rows that share ``words`` words are found; rows that are found share ``gram`` words. Returns the number found."""
    found = [got.get(k, 0) > 0 for k in keys]
    assert all(f for f, s in zip(found, sharing(rows, words), strict=True) if s)
    assert all(s for f, s in zip(found, sharing(rows, gram), strict=True) if f)
    return sum(found)


def run(spark, rows, words, gram, **kw):
    got = {(r["id"], r["text_key"]): r["n_shared"] for r in sp.shared_anchors(make(spark, rows), words=words, gram=gram, **kw).collect()}
    keys = [tuple(r) for r in make(spark, rows).selectExpr("doc_id", "xxhash64(coalesce(text, ''))").collect()]
    return check(got, keys, rows, words, gram)


def test_finds_shared_passages_and_no_others(spark, monkeypatch):
    rows = sample()
    first = run(spark, rows, 10, 4)
    assert 50 < first < len(rows)
    monkeypatch.setattr(sp, "LOT", 300)
    assert run(spark, rows, 10, 4, map_bits=16) == first  # lots and a fuller map change nothing
    assert run(spark, rows, 10, 10) > 50 and run(spark, rows, 3, 1) > 50


def test_anchors_against_every_window():
    import numpy as np

    texts = [(t or "").encode() for _, t in sample()]
    owner, least = sp.anchors(texts, 10, 4)
    pairs = set(zip(owner.tolist(), least.tolist(), strict=True))
    want = set()
    for i, t in enumerate(texts):
        words = t.split()
        if len(words) >= 10:
            h = sp.Fingerprints(np.frombuffer(b"".join(words), dtype=np.uint8)).of(np.cumsum([0, *map(len, words)])[:-1], np.array(list(map(len, words))))
            grams = [int(sp._of_neighbours(h[j : j + 4], 4)[0]) for j in range(len(words) - 3)]
            want |= {(i, min(grams[j : j + 7])) for j in range(len(words) - 9)}
    assert pairs == want and len(pairs) == len(owner)


def test_registered_column(spark):
    """Passages of over 50 words are found also where they have under 400 bytes; whole table."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet') ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: r["n_shared"] for r in QUERIES["op3_suffix_dedup"](spark, sf).collect()}
    assert len(got) == 1000 and check(got, [i for i, _ in rows], rows, 51, 40) > 50


def test_long_text_and_empty_table(spark):
    rows = [(1, "a b c d e f g " * 50_000), (2, "x " * 100 + "a b c d e f g " * 8), (3, "x y z " * 30)]
    assert run(spark, rows, 51, 40) == 2
    assert sp.shared_anchors(make(spark, rows).limit(0)).count() == 0
