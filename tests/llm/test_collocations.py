import random
import re
from collections import Counter

import pytest
from oracle import same_as_sql
from pairshift.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top=2000, max_words=5, nested=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    gone = set()
    for (lang, *words), a in found.items():
        for m in range(2, len(words)):
            for s in range(len(words) - m + 1):
                inside = (lang, *words[s : s + m])
                if 100 * a >= nested * f[inside]:
                    gone.add(inside)
    out = []
    for p, a in found.items():
        if p not in gone:
            lang, words = p[0], p[1:]
            cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]], n[lang], k))
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right, total, k in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score, k))
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS k", "2 AS phrase", "3 AS f", "4 AS n", "5 AS w1", "6 AS score", "7 AS words")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def texts(seed=3):
    r = random.Random(seed)
    vocabulary = ["a", "b", "C", "de", "é", "ß", "x\x1cy", " ", "z" * 40]
    rows = []
    for i in range(300):
        words = r.choices(vocabulary, weights=[9, 8, 7, 6, 5, 4, 3, 2, 1], k=r.randint(0, 40))
        text = "".join(w + r.choice([" ", " ", "\t", "  ", " ", ", ", ".", "\n"]) for w in words)
        rows.append((r.choice(["en", "fr", None, "und"]), text))
    return [*rows, ("en", None), (None, ""), ("fr", "\n.;"), ("xx", "a b c d e"), *[("rep", "One two three four five six seven")] * 12]


def test_whole_table(spark):
    assert same_as_sql(spark, "op11_collocations") > 0


@pytest.mark.parametrize("min_count,nested", [(10, 100), (2, 100), (10, 60), (1, 100)])
def test_equals_brute_force(spark, min_count, nested):
    rows = texts()
    got = rows_of(co.collocations(make(spark, rows), min_count=min_count, nested_percent=nested))
    assert got == brute(rows, min_count, nested=nested)


def test_full_map_top_and_other_lengths(spark, monkeypatch):
    """A map that is nearly full pads less and changes nothing; neither do small lots."""
    monkeypatch.setattr(co, "LOT", 64)
    monkeypatch.setattr(co, "HELD", 50)
    rows = texts(5)
    assert rows_of(co.collocations(make(spark, rows), min_count=5, top=7, max_words=4, map_bits=16)) == brute(rows, 5, 7, 4)
    assert rows_of(co.collocations(make(spark, rows), min_count=5, max_words=2)) == brute(rows, 5, max_words=2)


def test_lots_cut_at_piece_ends_only():
    raw = ("word " * 9 + ". ") * 40 + "x" * 500
    words = co.Words(raw.encode())
    follows = int(words.follows.sum())
    co_lot, co.LOT = co.LOT, 100
    try:
        import pyarrow as pa

        lots = [x for x in co._lots(pa.RecordBatch.from_arrays([pa.array(["l"]), pa.array([raw])], names=["lang", "body"]))]
    finally:
        co.LOT = co_lot
    assert len(lots) > 10 and sum(int(co.Words(x).follows.sum()) for _, x in lots) == follows
    assert sum(len(co.Words(x).code) for _, x in lots) == len(words.code)


def test_products_beyond_64_bits(spark):
    """Counts of 10**8 in the score's formula, through the same expression on a table of counts."""
    got = spark.sql("SELECT cast(1000 AS decimal(4,0)) * cast(99999999999 AS decimal(17,0)) * cast(9999999999999 AS decimal(17,0)) div (cast(99999999999 AS decimal(19,0)) * cast(7777777777 AS decimal(19,0))) AS s").first()["s"]
    assert got == 1000 * 99999999999 * 9999999999999 // (99999999999 * 7777777777)


def test_long_text_and_empty_table(spark):
    rows = [("en", "up and down the hill " * 40_000), ("en", "w" * 300_000 + " up and")]
    assert rows_of(co.collocations(make(spark, rows), min_count=100)) == brute(rows, 100)
    assert co.collocations(make(spark, rows).limit(0)).count() == 0
