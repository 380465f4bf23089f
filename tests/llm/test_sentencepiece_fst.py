import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pairshift.llm import sentencepiece_fst as sf
from pairshift.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "    ", "\n\n", "a" * 60, "  Hello  wé \n\txﬁ <s> <0x41>", "日本語テスト 中文", "😀 x 😀", "\x00a\x00", "x" + " " * 33 + "y", "...,,,;;", "e.g. U.S.A., i.e. don't!?", "²³ x²."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def fst():
    return sf.Transducer(MODEL, "bpe")


def ids_of(fst, text):
    return np.frombuffer(fst.encode(text), dtype="<u4").tolist()


def test_equal_to_the_library(library, fst):
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("abcdeth ing.,|é日\n  ") for _ in range(r.randint(1, 90))) for _ in range(1500)]
    for t in texts:
        assert ids_of(fst, t) == library.encode(t)
        assert fst.decode(ids_of(fst, t)) == library.decode(library.encode(t))


def test_only_path_equals_the_lattice_with_fewer_pairs(monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeinorst▁") for _ in range(r.randint(1, 30))) for _ in range(400)] + ["transformation", "▁internationally", "aaaaaaaaaaaa"]
    quick, full = sf.Transducer(MODEL, "bpe"), sf.Transducer(MODEL, "bpe")
    assert [quick.only(w) for w in words] == [full.shortest(w) for w in words]
    assert len(quick.pairs) < 0.8 * len(full.pairs)
    assert quick.only("a😀") is None or quick.only("a😀") == full.shortest("a😀")  # bytes: left to the lattice


def test_joint_normalisers_are_refused(tmp_path):
    for rule in ("nfkc", "identity"):
        sentencepiece.SentencePieceTrainer.train(
            sentence_iterator=iter(["the quick brown fox jumps over the lazy dog", "pack my box with five dozen jugs"] * 20), model_prefix=str(tmp_path / rule),
            vocab_size=320, model_type="bpe", byte_fallback=True, normalization_rule_name=rule, remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2)
    sf.Transducer(str(tmp_path / "identity.model"), "bpe")
    with pytest.raises(ValueError, match="jointly"):
        sf.Transducer(str(tmp_path / "nfkc.model"), "bpe")


def test_decode_of_any_ids(library, fst):
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(3, 32000) for _ in range(r.randint(0, 12))]
        assert fst.decode(ids) == b"".join(fst.output[i] for i in ids).decode(errors="replace").removeprefix(" ")


def test_bounded_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sf, "KNOWN_CHUNKS", 5)
    monkeypatch.setattr(sf, "KNOWN_PAIRS", 7)
    t = sf.Transducer(MODEL, "bpe")
    for text in ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs"] * 2:
        assert ids_of(t, text) == library.encode(text)


def test_unigram_weights_take_the_best_sum(fst):
    uni = sf.Transducer(MODEL, "unigram")
    text = uni.normalise("thinking")
    best = {0: 0.0}
    for i in range(1, len(text) + 1):
        best[i] = min((best[j] - uni.scores[text[j:i]] for j in range(i) if j in best and text[j:i] in uni.scores), default=float("inf"))
    path = uni.shortest(text)
    assert "".join(uni.pieces[i] for i in path) == text
    assert sum(-uni.scores[uni.pieces[i]] for i in path) == pytest.approx(best[len(text)])


def test_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_sentencepiece_fst"](spark, d).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{d}/documents.parquet')").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "")
        back = library.decode(ids)
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or ""))
    assert sum(v[3] for v in got.values()) > 0.99 * len(got)


def test_round_trip_rows(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id"), (99, None), (98, "x ▁ y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS body", "3 AS id")
    enc = sf.encoded(df, MODEL, with_ids=True)
    back = sf.decoded(enc, MODEL).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), "x   y" if i == 98 else t or "") for i, t in rows)
    assert {r["doc_id"]: r["round_trip"] for r in back}[98] is False
    none = sf.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<long>"), MODEL).collect()
    assert none[0]["text"] is None


def test_empty_table(spark):
    assert sf.encoded(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
