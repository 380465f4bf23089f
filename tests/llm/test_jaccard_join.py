import random
import re

import numpy as np
import pytest

from oracle import same_as_sql
from pairshift.llm import jaccard_join as jj
from pairshift.llm.components import components


def brute_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows, percent=75):
    sets = brute_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(str((d, len(sets[i]), low.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 9))
    text = lambda n: [word() for _ in range(n)]
    rows = [None, "", "   ", "one", "ONE", "one two three", "One Two Three", "a b c d e", "a b c d e f"]
    passage = text(30)
    base = text(60)
    for _ in range(40):  # near copies in chains: every text edits an earlier one
        parent = r.choice([base, *(x.split(" ") for x in rows[9:])]) if len(rows) > 9 else base
        new = list(parent)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(new))
            new[at : at + r.randint(0, 2)] = text(r.randint(0, 2))
        rows.append(" ".join(new))
    rows += [" ".join(text(20) + passage + text(20)) for _ in range(30)]  # a shared passage does not link
    rows += [" ".join(text(r.randint(1, 80))) for _ in range(30)]
    rows += [rows[12].upper(), rows[12] + " "]
    out = [(500 - i, t) for i, t in enumerate(rows)]
    return out + [(None, rows[13]), (None, "only null id"), (480, out[20][1]), (480, out[20][1])]


def run(spark, rows, percent=75):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS set_id", "3 AS id", "4 AS component_id").repartition(3)
    return sorted(str((r["id"], r["n_shingles"], r["component_id"])) for r in jj.jaccard_components(df, percent=percent).collect())


def test_whole_table(spark):
    assert same_as_sql(spark, "op8_jaccard_join") == 1000


@pytest.mark.parametrize("percent", [75, 40])
def test_chains_passages_and_odd_rows(spark, percent):
    rows = corpus(percent)
    assert run(spark, rows, percent) == brute(rows, percent)


def test_blocks(spark, monkeypatch):
    """Groups and coarse components far over the block sizes."""
    monkeypatch.setattr(jj, "BLOCK", 5)
    monkeypatch.setattr(jj, "VERIFY_ROWS", 4)
    rows = corpus(9)
    assert run(spark, rows) == brute(rows)


def test_rows_that_stay(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS reject_0", "1 AS key_reject_0")
    stay = jj.drop_near_copies(df)
    assert stay.columns == df.columns
    want = sorted(str(r[0]) for r in map(eval, brute(rows)) if r[0] == r[2])
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == want


def test_tree_prunes_no_possible_pair():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(r.choice(base[k * 100 : k * 100 + 300], r.integers(150, 280), replace=False)) for k in r.integers(0, 30, 300)]
    sizes = np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(jj.bitmap(s, 1024) for s in sets), dtype=np.uint64).reshape(len(sets), -1)
    tree = jj.SignatureTree(sizes, bits, np.arange(len(sets)))
    found = {(int(i), int(j)) for a, b in tree.pairs(50) for i, j in zip(a, b)}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jj.linked(sets[i], sets[j], 50)}
    assert linked and linked <= found and len(found) < len(sets) * (len(sets) - 1) // 4


def test_widths_fold_and_few_sets_agree_with_the_tree(monkeypatch):
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.unique(r.choice(base[:n], int(n * 0.9), replace=False)) for n in r.integers(100, 900, 60)]
    for s in sets[:9]:
        assert np.array_equal(jj.folded(jj.bitmap(s), 256), np.frombuffer(jj.bitmap(s, 256), dtype=np.uint64))
    args = ([len(s) for s in sets], [jj.bitmap(s) for s in sets], [int(s[0] >> np.uint64(1)) for s in sets])
    order = np.argsort(args[2], kind="stable").tolist()
    args = [[a[i] for i in order] for a in args]

    def groups(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            root = [root[a] if x == root[b] else x for x in root]
        return [{j for j in range(len(sets)) if root[j] == root[i]} for i in range(len(sets))]

    tree = groups(jj.candidate_forest(*args, 75))
    assert len({frozenset(g) for g in tree}) > 1
    for i in range(len(sets)):
        for j in range(i):
            assert j in tree[i] or not jj.linked(sets[order[i]], sets[order[j]], 75)
    monkeypatch.setattr(jj, "FEW", 1000)
    few = groups(jj.candidate_forest(*args, 75))
    for i in range(len(sets)):
        for j in range(i):
            assert j in few[i] or not jj.linked(sets[order[i]], sets[order[j]], 75)


def test_prefix_filter_is_whole_for_short_sets():
    assert jj.prefix_length(1, 75) == 1 and jj.prefix_length(4, 75) == 2 and jj.prefix_length(80, 75) == 21
    assert jj.prefix_length(10_000, 75) == jj.PREFIX


def test_prefix_keeps_the_miss_at_any_threshold():
    assert jj.PREFIX == 24
    for percent in (1, 5, 20, 40, 60, 75, 90, 99):
        long = jj.prefix_length(10**6, percent)
        assert (1 - percent / 100) ** long <= jj.MISS < (1 - percent / 100) ** (long - 1)
    assert jj.prefix_length(10**6, 100) == 1 and jj.prefix_length(50, 20) == 41


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(50)] + [(200, 200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "u long, v long")
    want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(empty).count() == 0 and jj.drop_near_copies(empty).count() == 0
