import hashlib
import random
from collections import Counter

import duckdb

from pairshift.llm import suffix_dedup as sd
from pairshift.llm.queries import QUERIES


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter()
    for b in raw:
        seen.update(hash(b[p : p + length]) for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (20, 40, 90, 200)]
    out = [None, "", "a" * 500, "a" * 399, "a" * 401, "ab" * 700, text(30) * 9]
    for _ in range(25):
        t = text(r.randint(5, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 2)
            t += p[cut : len(p) - r.randint(0, len(p) // 3)] + text(r.randint(0, 20))
        out.append(t)
    out += [out[9], out[9], out[10] + "x", "y" + out[10]]
    base = text(300)
    for _ in range(8):
        at = r.randrange(len(base))
        out.append(base[:at] + "#" + base[at + 1 :])
    return out


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return [tuple(r)[1:5] for r in sorted(sd.suffix_dedup(df, **kw).collect())]


def test_random_texts(spark):
    for seed, kw in ((1, {}), (2, {"length": 60, "window": 40, "gram": 8})):
        texts = random_texts(seed)
        assert run(spark, texts, **kw) == brute(texts, kw.get("length", 400))


def test_hot_ranks_and_segments(spark, monkeypatch):
    texts = random_texts(3)
    expected = brute(texts, 400)
    monkeypatch.setattr(sd, "HOT_RANK", 2)
    monkeypatch.setattr(sd, "SEGMENT", 700)
    make = sd._rank
    monkeypatch.setattr(sd, "_rank", lambda *a: _patched(make, *a))
    assert run(spark, texts) == expected


def _patched(make, *args):
    run_ = make(*args)

    def run(batches):
        from pairshift.llm import suffix_dedup

        suffix_dedup.SEGMENT = 700
        return run_(batches)

    return run


def test_doubling_rounds(spark):
    """Steps double up to what a range surely shares; a range leaves in the round that makes it unique."""
    assert sd.doubling_steps(400, 256, 32) == [0, 32, 64, 128, 145] and sd.doubling_steps(60, 40, 8) == [0, 8, 16, 21]
    assert sd.doubling_steps(10, 5, 6) == [0, 3, 6]
    rows = [(1, 1, 1, 9), (1, 1, 1, 8), (1, 1, 2, 7), (1, 2, 1, 6), (2, 1, 1, 5), (3, 3, 3, 4), (3, 3, 3, 4), (3, 3, 3, 3)]
    df = spark.createDataFrame([(*r, 0, i, i, i) for i, r in enumerate(rows)], "step_0 long, step_1 long, step_2 long, whole long, state int, id long, text_key long, packed long")
    rounds = lambda steps: sd.doubled(*_with_path(df, steps))
    got = sorted((r["id"], r["n"]) for r in rounds(3)[0].collect())
    assert got == [(0, 2), (1, 2), (5, 3), (6, 3), (7, 3)]
    assert sorted(r["id"] for r in rounds(2)[0].collect()) == [0, 1, 2, 5, 6, 7]


def _with_path(df, steps):
    table, path = sd.written_at(df, "first_ranks")
    return table, steps, path


def test_one_passage_everywhere(spark, monkeypatch):
    """A passage in most documents, cut at many places: its ranks are hot and are dealt by their stretches."""
    monkeypatch.setattr(sd, "HOT_RANK", 16)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmn ") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    texts = [word() * r.randint(1, 3) + passage[r.randint(0, 90) : len(passage) - r.randint(0, 90)] + word() for _ in range(120)] + [" ".join(word() for _ in range(200)) for _ in range(20)]
    assert run(spark, texts) == brute(texts, 400)


def test_repeated_rows_null_ids_extra_columns(spark):
    t = "".join(random.Random(5).choice("abcdefgh ") for _ in range(900))
    df = spark.createDataFrame([(1, t, "q"), (1, t, "q"), (None, t[:500], "q"), (7, "short", "q"), (8, None, "q")], "doc_id long, text string, id string")
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in sd.suffix_dedup(df.selectExpr("doc_id", "text", "id AS lo", "id AS packed"), with_bytes=True).collect())
    assert got == [("1", 900, 900, 1), ("1", 900, 900, 1), ("7", 5, 0, 0), ("8", 0, 0, 0), ("None", 500, 500, 1)]


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op3_suffix_dedup"](spark, sf).drop("n_shared").collect())
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 400))]
    assert got == want and sum(w[2] for w in want) > 0
