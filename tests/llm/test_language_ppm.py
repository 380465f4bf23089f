import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pairshift.llm import language_ppm as lp
from pairshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


class Tree:
    """Plain dictionaries: blended distributions with escape C and exclusion, over all 256 bytes."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            raw = b"\n" * order + t.encode()
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    self.seen[raw[i - k : i]][raw[i]] += 1

    def p(self, context):
        lower = [1 / 256] * 256 if not context else self.p(context[1:])
        if not context and context not in self.seen:
            return lower
        if context not in self.seen:
            return lower
        n = self.seen[context]
        mass = sum(n.values()) + len(n)
        rest = 1 - sum(lower[s] for s in n)
        return [n[s] / mass if s in n else len(n) / mass * lower[s] / max(rest, 1e-12) for s in range(256)]

    def bits(self, text):
        raw = b"\n" * self.order + text.encode()
        return sum(-math.log2(self.p(raw[i - self.order : i])[raw[i]]) for i in range(self.order, len(raw)))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS source", "2 AS id", "3 AS body", "4 AS score", "5 AS gram", "6 AS n")


def sample():
    r = random.Random(4)
    kinds = {"aa": ["ba", "na", "ma", "é"], "bb": ["sto", "str", "ß"], "cc": ["o", "oo", "na", "日本"]}
    return [(i, " ".join(r.choices(kinds[k], k=r.randint(1, 30))), k) for i in range(240) for k in [r.choice(list(kinds))]]


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_equal_plain_dictionaries(spark, order):
    rows = sample()
    model = lp.fit(docs(spark, rows), order=order)
    assert model.langs == ["aa", "bb", "cc"]
    trees = [Tree([t for i, t, k in rows if k == lang and zlib.crc32(str(i).encode()) % 4 != 2], order) for lang in model.langs]
    texts = [t for _, t, _ in rows[:12]] + ["", "zzz bana", "sto\nna日", "\x00\x7fé", "q"]
    got = model.code_lengths(texts)
    for i, t in enumerate(texts):
        for j, tree in enumerate(trees):
            assert abs(got[i, j] - tree.bits(t)) < 1e-3 * (1 + len(t)), (t, model.langs[j])


def test_every_context_is_a_proper_distribution(spark):
    import numpy as np

    model = lp.fit(docs(spark, sample()), order=2, nodes=60)  # pruned trees as well
    for context in (b"na", b" b", b"zz", b"\n\n", "é".encode()):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        total = np.exp2(-model._bits(keys, 2)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-4)


def test_pruned_size(spark):
    rows = sample()
    kept = lp.frozen_counts(docs(spark, rows), "lang", "text", 3, 60).groupBy("k").count().collect()
    assert all(r["count"] <= 60 for r in kept) and {r["k"] for r in kept} == {0, 1, 2, 3}


def test_table_lookup():
    import numpy as np

    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 32, 5000, dtype=np.uint64)).astype(np.uint32)
    places = lp.Places(keys)
    assert (places.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(r.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32), keys)
    assert (places.find(others) == len(keys)).all() and len(lp.Places(keys[:0]).find(keys[:3])) == 3


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_language_ppm"](spark, SF).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang FROM read_parquet('{SF}/documents.parquet')").fetchall()
    assert len(got) == 1000 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in truth)
    held = [(lang, got[i]) for i, lang in truth if got[i]["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == lang for lang, r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lp, "LOT", 4096)
    rows = sample()
    odd = [(None, "bana bana", "bb"), (1000, None, "aa"), (1001, "", "aa"), (1002, "123 ?!", "aa"), (1003, "bana mana", None), (1003, "bana mana", None),
           (1004, "na ma ba " * 30_000, "zz" if zlib.crc32(b"1004") % 4 == 2 else None)]
    got = lp.predicted_languages(docs(spark, rows + odd), order=2).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert by[None]["held_out"] is False and by[None]["lang_pred"] in ("aa", "bb", "cc")
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "aa" and by[1004]["lang_pred"] == "aa"
    # neither the labels of the held-out fold nor rows without id teach anything
    other = [(i, t, "bb" if i is None or zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows + odd]
    again = lp.predicted_languages(docs(spark, other), order=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert {r["lang_pred"] for r in lp.predicted_languages(docs(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert lp.predicted_languages(docs(spark, rows).limit(0)).count() == 0
