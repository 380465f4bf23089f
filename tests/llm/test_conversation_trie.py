import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from oracle import same_as_sql
from pairshift.llm import conversation_trie as ct
from pyspark.sql import functions as F


def brute(rows, seed=0):
    """Rebuilt texts in full, prefix by prefix."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), hash32(seed)))
            turns[c].append(((turn is not None, turn or 0, key - (1 << 64) if key >> 63 else key), (role, text)))
    own = {c: [e for _, e in sorted(t, key=lambda x: x[0])] for c, t in turns.items()}
    rebuilt = {}
    for c, es in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + es[h:]
    members = defaultdict(list)
    for c, es in rebuilt.items():
        for d in range(len(es) + 1):
            members[tuple(es[:d])].append(c)
    out = []
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(s) == len(q) + 1 and s[: len(q)] == q for s in members)]
        saved = sum((len(members[q]) - 1) * words(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def hash32(seed):
    """xxhash64 of an int column with Spark's starting value."""
    return _spark_int(seed)


def _spark_int(i, h=42):
    m = (1 << 64) - 1
    p1, p2, p3, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    x = (h + p5 + 4) & m
    x ^= (i & 0xFFFFFFFF) * p1 & m
    x = ((x << 23 | x >> 41) & m) * p2 + p3 & m
    x = (x ^ x >> 33) * p2 & m
    x = (x ^ x >> 29) * p3 & m
    return x ^ x >> 32


def make(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS key", "3 AS depth", "4 AS n", "5 AS words")


def trie(spark, rows, **kw):
    return sorted((tuple(r) for r in ct.conversation_trie(make(spark, rows), **kw).drop("last_conv_id", "last_turn").collect()), key=str)


def sample(seed, n=60, longest=6):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "hi there you", "", None, "é ü"])))
    return rows


def test_whole_table(spark):
    assert same_as_sql(spark, "op13_conversation_trie", tables=("conversations",)) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_rebuilt_texts(spark, seed):
    rows = sample(seed)
    rows += [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, None, None, "first too"), (-25, 3, "user", "hi"), (-20, 3, "user", "hi"), (500, 9, "user", None)]
    rows += [(8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "assistant", "tie")]
    assert trie(spark, rows) == brute(rows)


def test_long_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK_BITS", 2)
    monkeypatch.setattr(ct, "END_BITS", 1)
    rows = [(c, 3 * t, "user" if t % 2 else "bot", f"turn {t % 5} of {0 if t < 20 else c}") for c in (20, 21, 22, 23, 24) for t in range(45)]
    rows += [(c, t, "user", "same") for c in range(60, 75) for t in range(3)]
    assert trie(spark, rows) == brute(rows)


def test_references_hold_the_last_turn(spark):
    rows = [r for r in sample(9) if r[0] != 3]
    got = ct.conversation_trie(make(spark, rows)).collect()
    stored = defaultdict(set)
    for c, t, role, text in rows:
        stored[c, t].add((role or "", text or ""))
    assert all((r["last_conv_id"], r["last_turn"]) in stored for r in got if r["depth"] > 0)
    assert [r["last_conv_id"] for r in got if r["depth"] == 0] == [None]


def test_other_base_and_head(spark):
    rows = [(c, t, "u", f"{c} {t}") for c in range(6) for t in range(4)]
    got = trie(spark, rows, base=F.lit(0).cast("long"), head=F.lit(2), most=2)
    # every conversation starts with two turns of conversation 0
    assert [r[:5] for r in got if r[1] == 2] == [(0, 2, 0, 6, 6)] and len(got) == 1 + 2 + 12


def test_powers(spark):
    exps = [-3, -1, 0, 1, 255, 256, 65_537, 1 << 24, (1 << 32) - 1]
    df = spark.createDataFrame([(e,) for e in exps], "e long")
    for lane in range(ct.LANES):
        got = [r[0] for r in df.select(ct._power(lane, F.col("e"))).collect()]
        assert got == [pow(ct.BASES[lane], e, ct.PRIME) for e in exps]


def test_shared_key_is_an_error(spark, monkeypatch):
    """Keys that do not tell turns apart are noticed, never merged."""
    real = ct._turns
    monkeypatch.setattr(ct, "_turns", lambda *a: real(*a).withColumn("key", F.length("text").cast("long")))
    with pytest.raises(Exception, match="share a key"):
        trie(spark, [(1, 0, "u", "ab"), (2, 0, "u", "cd")])


def test_empty_table_and_long_text(spark):
    assert trie(spark, []) == []
    rows = [(40, 0, "u", "word " * 200_000), (60, 0, "u", "word " * 200_000)]
    assert trie(spark, rows) == brute(rows)
