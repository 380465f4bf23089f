import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairshift.llm import best_fit_packing as bp
from pairshift.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Hello, World... it's  I'M fine.\n\tÉcole é ß ΑΣ. x", "a.b.c... !!! don't' s.", "<|startoftext|>Yes.<|endoftext|>", "x\x1cy\x85z w　v", "1. 2.5, 3e4;"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def brute_pieces(tokenizer, rows, capacity=4096):
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out, key=str)


def check_sequences(rows, capacity):
    bins = {}
    for _, _, _, length, _, sequence, offset in rows:
        bins.setdefault(sequence, []).append((offset, length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_odd_texts_and_rows(spark, tokenizer):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length", "3 AS id")
    got = [tuple(r) for r in bp.best_fit_packing(df, VOCABULARY, capacity=7).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute_pieces(tokenizer, rows, 7)
    check_sequences(got, 7)


def test_whole_table(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    got = [tuple(r) for r in QUERIES["op7_best_fit_packing"](spark, sf).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute_pieces(tokenizer, rows)
    least = -(-sum(r[3] for r in got) // 4096)
    assert check_sequences(got, 4096) <= least + 2


def test_best_two_fit_never_wastes_room_that_a_waiting_piece_fits():
    r = random.Random(4)
    for _ in range(200):
        sizes = np.array([r.randint(1, 50) for _ in range(r.randint(0, 60))], dtype=np.int64)
        bins = bp.best_two_fit(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        later = [min((sizes[i] for b in bins[k + 1 :] for i in b), default=51) for k in range(len(bins))]
        for b, smallest in zip(bins, later):
            room = 50 - int(sizes[b].sum())
            assert 0 <= room < smallest


def test_two_replace_the_smallest():
    # greedy alone: 6 + 3 leaves one free; 2 + 2 in place of the 3 fill the bin
    assert sorted(sorted(b) for b in bp.best_two_fit(np.array([6, 3, 2, 2]), 10)) == [[0, 2, 3], [1]]


def test_tables_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(bp, "KNOWN_RUNS", 4)
    e = bp.RunEncoder(VOCABULARY)
    texts = ["one two three four.", "five six seven eight nine ten", "One, TWO three!"]
    for text, raw in zip(texts, e.encode(texts)):
        assert np.frombuffer(raw, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert bp.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
