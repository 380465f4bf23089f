import math
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import pytest

from pairshift.llm import quality_ftrl as qf
from pairshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in QUERIES["op6_quality_ftrl"](spark, SF).collect()}


def test_held_out_accuracy(scored):
    labels = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{SF}/labels.parquet')").fetchall()
    assert len(scored) == 10000
    for i in range(0, 10000, 7):
        assert scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(q, scored[i]) for i, q in labels if scored[i]["held_out"]]
    good, bad = [[r for q, r in held if q == k] for k in (1, 0)]
    assert len(good) > 500 and len(bad) > 50
    assert sum(r["predicted"] == 1 for r in good) / len(good) > 0.97
    assert sum(r["predicted"] == 0 for r in bad) / len(bad) > 0.93
    pairs = [(g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.98


def test_edges_and_folds(spark):
    docs = [(i, ("good words here and there " * 4) if i % 2 else "BAD!! BAD!! BAD!! BAD!!") for i in range(60)]
    docs += [(None, "null id"), (60, None), (61, ""), (5, docs[5][1]), (62, "x " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS score", "3 AS id", "4 AS quality")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = qf.quality_scores(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    empty = {r["score"] for r in got if r["doc_id"] in (60, 61)}
    assert len(empty) == 1
    # labels of the held-out fold change nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {str(tuple(r)) for r in qf.quality_scores(df, flipped).collect()}
    assert again == {str(tuple(r)) for r in got}


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r["score"] for r in qf.quality_scores(df, none).collect()] == [0.5]
    assert qf.quality_scores(df.limit(0), none).count() == 0


def test_ftrl_follows_the_closed_form():
    import numpy as np

    m = qf.Ftrl(4)
    at, v = np.array([0, 2]), np.array([1.0, 2.0])
    m.learn(at, v, 1.0)
    g = (0.5 - 1.0) * v
    assert np.allclose(m.z[at], g) and np.allclose(m.n[at], g * g)
    want = -(g - np.sign(g) * qf.L1) / ((qf.BETA + np.abs(g)) / qf.ALPHA + qf.L2)
    assert np.allclose(m.weights(at), want) and not m.weights(np.array([1, 3])).any()


MASK = 2 ** 64 - 1
A, B, C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9  # fixed values of the feature hash


def plain_features(text):
    """Counts of hashed n-grams by integers and dictionaries, and the number of words."""
    def place(h, space):
        x = (h + space) * A & MASK
        x ^= x >> 29
        return max((x * B & MASK) >> (64 - qf.BITS), 1)

    def sign(b):
        return "X" if 65 <= b <= 90 else "x" if 97 <= b <= 122 or b >= 128 else "9" if 48 <= b <= 57 else chr(b)

    raw = (text or "").encode()
    words = [zlib.crc32(w) for w in raw.split()]
    shapes = [zlib.crc32(w.encode()) for w in "".join(k for k, _ in groupby(map(sign, raw))).split()]
    out, seen = Counter(), set()
    for w, s in zip(words, shapes, strict=True):
        out[place(w, 1)] += 1
        out[place(s, 3)] += 1
    for i in range(len(words) - 1):
        pair = words[i] * B + words[i + 1] * C & MASK
        out[place(pair, 2)] += 1
        out[place(shapes[i] * C + shapes[i + 1] * A + (pair in seen) & MASK, 4)] += 1
        seen.add(pair)
    return out, len(words)


def plain_scores(train, texts):
    """Train on (text, label) in order and score: one weight at a time, by the published update."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= qf.L1:
            return 0.0
        return -(z[i] - math.copysign(qf.L1, z[i])) / ((qf.BETA + math.sqrt(n[i])) / qf.ALPHA + qf.L2)

    def inputs(text):
        counts, words = plain_features(text)
        return {qf.BIAS: 1.0, **{i: c * qf.SCALE / words for i, c in counts.items()}}

    def chance(x, w):
        return 1 / (1 + math.exp(-min(max(sum(w[i] * v for i, v in x.items()), -35.0), 35.0)))

    rows = [(inputs(t), y) for t, y in train]
    for _ in range(qf.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            error = chance(x, w) - y
            for i, v in x.items():
                g = error * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / qf.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [chance(x, {i: weight(i) for i in x}) for x in map(inputs, texts)]


def test_whole_table_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall())
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall())
    ids = [i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs]
    order = {r.i: (r.h, r.i) for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "xxhash64(i) AS h").collect()}
    assert len(ids) <= qf.TRAIN_ROWS
    want = plain_scores([(docs[i], labels[i]) for i in sorted(ids, key=order.get)], docs.values())
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_ftrl"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, score in zip(docs, want):
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and (abs(score - 0.7) < 1e-9 or got[i]["predicted"] == int(score >= 0.7))
