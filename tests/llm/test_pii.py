import duckdb
import pytest

from brute import iban_ok, luhn_ok, pii_row
from pairshift.llm.pii import BLOCK, find_pii, mask_pii
from pairshift.llm.queries import QUERIES

HAND = [
    "", None, "nothing here", "mail a.b+c@x-y.example.com now", "a@b.com_x@y.zz and @c.d a@b", "1.2.3.4.5 and 256.1.1.1 and 001.002.003.255",
    "4111 1111 1111 1111 then 4111-1111-1111-1112", "+1 (555) 123-4567, +12, +(1)", "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433",
    "é😀 é a@b.cc 😀😀 +44 20 7946 0958 x", "9" * 5000, "1 " * 4000, "a." * 3000 + "@x.y", "x@" + "y." * 3000 + "z", "+1.2.3.4 4111111111111111",
    "\n1.2.3.4\n\t+1 555 123 45678 90123", "a%b@c.d" * 50, "٣٤@x.yy 1٣.1.1.1.1", "DE89370400440532013000", "xDE89370400440532013000",
    "api_key: ab_" + "9" * 40 + " and " + "z" * 30 + " token " + "a1" * 70, "call 1234567, account 123456 tel (030) 12/34-567 konto 99887766x", "token " + "a1b2" * 6 + " " + "c3d4" * 9,
]


@pytest.fixture(scope="module")
def hand(spark):
    rows = [(i, t) for i, t in enumerate(HAND)] + [(100, "a@b.cc " * (2 * BLOCK + 3)), (100, "a@b.cc"), (None, "1.1.1.1")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS start", "2 AS body")


def rows_of(df):
    return [tuple(r)[:7] for r in df.collect()]


def test_hand_cases(hand):
    want = sorted((str(r[0]), *pii_row(r[1])) for r in hand.select("doc_id", "text").collect())
    assert sorted((str(r[0]), *r[1:]) for r in rows_of(find_pii(hand))) == want


def test_whole_table_against_brute(spark):
    sf = "/root/testdata/sf0.01"
    got = {r[0]: r[1:] for r in rows_of(QUERIES["op9_pii"](spark, sf))}
    want = {i: pii_row(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()}
    assert got == want
    assert sum(w[0] > 0 for w in want.values()) > 0 and sum(w[2] > 0 for w in want.values()) > 0
    assert sum("secret" in w[5] for w in want.values()) > 0  # only the words near them confirm these


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(1, "server 10.0.0.1"), (2, "zzz 10.0.0.1")], "doc_id long, text string")
    got = {r["doc_id"]: float(r["scores"].split(":")[-1]) for r in find_pii(df).collect()}
    assert got[1] > got[2]


def test_context_decides_on_numbers_without_other_proof(spark):
    pairs = [("my phone is 030 1234567 now", "my house is 030 1234567 now", "local_phone:12:23"), ("Tel. (555) 123-4567", "Lot. (555) 123-4567", "local_phone:5:19"),
             ("account AB12345678.", "catalogue AB12345678.", "account:8:18"),
             ('token = "0123456789abcdef0123456789abcdef"', 'digest = "0123456789abcdef0123456789abcdef"', "secret:9:41")]
    df = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in find_pii(df).collect()}
    assert got == {2 * i + j: p[2] if j == 0 else "" for i, p in enumerate(pairs) for j in (0, 1)}
    no = ["call +44 20 7946 0958 x", "phone 4111 1111 1111 1111", "tel 12 34", "call 5551234567x", "hotel 5551234567", "call 1234567.5", "account 12345", "phone " + "1 " * 4000 + "x"]
    rows = find_pii(spark.createDataFrame(list(enumerate(no)), "doc_id long, text string")).collect()
    assert not [r for r in rows if "local_phone" in r["spans"] or "account" in r["spans"]]


def test_masking(spark, hand):
    long = "é" * 4090 + "a@b.cc " + "x" * 5000 + " +1 (555) 123-4567 / 4111111111111111"
    df = hand.select("doc_id", "text").unionByName(spark.createDataFrame([(500, long)], "doc_id long, text string"))
    got = {(r[0], r[1] is None, i): r[1] for i, r in enumerate(mask_pii(df).collect())}
    texts = [v for v in got.values() if v is not None]
    assert "é" * 4090 + "<EMAIL> " + "x" * 5000 + " <PHONE> / <CARD>" in texts
    assert "nothing here" in texts and "" in texts and None in got.values()
    assert not any("a@b.cc" in t or "1.1.1.1" == t for t in texts)


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_checksums():
    assert luhn_ok("4111111111111111") and not luhn_ok("4111111111111112")
    assert iban_ok("GB82WEST12345698765432") and not iban_ok("GB82WEST12345698765433")
