"""Text scalars, label parsers, F1 and percentiles against plain-Python definitions on hostile strings."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.functions.labels import parse_nli_label
from pairshift.operators import inspect, scoring
from pairshift.operators import tokens as tk

HOSTILE = [
    "",
    "   ",
    "Bonjour ! Ça va ?",
    "a　b",
    "x\x1cy",
    "a - b",
    " . Yes, ",
    "déjà_vu",
    "café naïve",
    "emoji 😀 ok",
    "Ne PAS You ARE",
    "  leading and trailing  ",
    "?!.,;",
    "tab\there\nnew line\r\nend",
    " ".join(f"w{i}" for i in range(20000)),
]

# model output -> label with verb forms, label without them (worked out by hand)
LABEL_OUTPUTS = {
    "Entailment.": ("entailment", "entailment"),
    "It entails X": ("entailment", ""),
    "not entailment but contradiction": ("entailment", "entailment"),
    "contradicted, so entailed": ("entailment", ""),
    "nan": ("", ""),
    "": ("", ""),
    "neutral,contradiction": ("neutral", "neutral"),
    "CONTRADICTED: yes": ("contradiction", ""),
    "It contradicts a neutral claim": ("contradiction", "neutral"),
    "Neutral": ("neutral", "neutral"),
    "label: neutral.": ("neutral", "neutral"),
    "en.tail.ment": ("", ""),
}

# string -> normalised answer (worked out by hand)
NORMALISED = {
    "": "", "   ": "", "Bonjour ! Ça va ?": "bonjour  ça va ", "a - b": "a  b", " . Yes, ": " yes", "déjà_vu": "déjà_vu",
    "café naïve": "café naïve", "emoji 😀 ok": "emoji  ok", "Ne PAS You ARE": "ne pas you are", "a　b": "a b",
    "  leading and trailing  ": "leading and trailing", "?!.,;": "", "tab\there\nnew line\r\nend": "tab here new line end",
}


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(HOSTILE)], "i int, s string")


def test_whitespace_tokens_match_python(strings):
    rows = strings.select("i", tx.ws_tokens("s").alias("t"), tx.normalize_ws("s").alias("n"),
                          tx.word_count("s").alias("w"), tx.chars_no_ws("s").alias("c")).collect()
    for r in rows:
        s = HOSTILE[r.i]
        assert r.t == s.split()
        assert r.n == re.sub(r"\s+", " ", s).strip()
        assert r.w == len(s.strip().split())
        assert r.c == sum(1 for ch in s if not ch.isspace())


def test_simple_tokenize_and_normalize_match_python(strings):
    rows = strings.select("i", tx.simple_tokenize("s").alias("t"), tx.normalize_answer("s").alias("n")).collect()
    for r in rows:
        s = HOSTILE[r.i]
        assert r.t == re.findall(r"\w+|[^\w\s]", s, flags=re.UNICODE)
        if s in NORMALISED:
            assert r.n == NORMALISED[s]


def test_label_parsers(spark):
    df = spark.createDataFrame([(s,) for s in LABEL_OUTPUTS] + [(None,)], "x string")
    expected = {**LABEL_OUTPUTS, None: ("", "")}
    rows = df.select("x", parse_nli_label("x", True).alias("v"), parse_nli_label("x", False).alias("p")).collect()
    for r in rows:
        assert (r.v, r.p) == expected[r.x]



def test_f1_of_lone_rows_is_counted_without_exploding(spark):
    """Rows alone with their keys give one line each; rows of repeated and null keys count as one text."""
    rows = [(1, "a b b c, D", "b a b b d"), (2, None, ""), (3, "", "x"), (4, "x y", "z"), (5, "a a a", "a"), (6, "b z", "b a"), (7, "é  É", "É"),
            (8, "a b", "a"), (8, "c", "b c c"), (None, "a a", "a"), (None, "b", "a b")]
    df = spark.createDataFrame(rows, "id long, prediction string, label string")
    terms = scoring._f1_terms(df, ["id"], "prediction", "label")
    lines = {r.id: r["count"] for r in terms.groupBy("id").count().collect()}
    assert all(lines[i] == 1 for i in range(1, 8)) and lines[8] == 3 + 4 + 2 and lines[None] == 3 + 3 + 2
    words = lambda t: Counter("".join(c for c in (t or "").lower() if c.isalnum() or c == " ").split())
    got = {r.id: r for r in scoring.f1_per_example(df, ["id"]).collect()}
    for i in {r[0] for r in rows}:
        p, g = sum((words(r[1]) for r in rows if r[0] == i), Counter()), sum((words(r[2]) for r in rows if r[0] == i), Counter())
        n, m, c = sum(p.values()), sum(g.values()), sum((p & g).values())
        f1 = 1.0 if n == m == 0 else 0.0 if not c else 2 * (c / n) * (c / m) / (c / n + c / m)
        assert (got[i].n_pred, got[i].n_gold, got[i].common) == (n, m, c) and abs(got[i].f1 - f1) < 1e-12


def test_f1_forms_agree_with_python(spark):
    # prediction, gold, F1 = 2 * common / (tokens of both), worked out by hand
    pairs = [("", "", 1.0), ("", "a", 0.0), ("a", "", 0.0), ("the cat the cat", "the cat", 4 / 6), ("!!!", "...", 1.0), ("a b c", "c b a", 1.0),
             ("Paris, France", "paris", 2 / 3), ("x y z", "q", 0.0), (" ".join(["le"] * 50 + ["chat"]), "le chat le", 6 / 54)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(pairs)], "id int, prediction string, label string")
    inline = {r.id: r.f for r in df.select("id", scoring.f1_inline("prediction", "label").alias("f")).collect()}
    exploded = {r.id: r.f1 for r in scoring.f1_per_example(df, ["id"]).collect()}
    for i, (_, _, ref) in enumerate(pairs):
        assert inline[i] == pytest.approx(ref)
        assert exploded[i] == pytest.approx(ref)
        assert 0.0 <= exploded[i] <= 1.0


# n -> median and 90th percentile of 0, 41, 82, 22, 63, 3, ... at rank round((n - 1) * p), halves to even
@pytest.mark.parametrize("n, p50, p90", [(1, 0, 0), (2, 0, 41), (3, 41, 82), (10, 41, 82), (11, 41, 82), (21, 44, 85)])
def test_nearest_rank_percentiles(spark, n, p50, p90):
    xs = [(i * 7919) % 101 for i in range(n)]
    df = spark.createDataFrame([("g", x) for x in xs], "g string, v int")
    r = inspect.nearest_rank_stats(df, "g", "v").collect()[0]
    assert (r.p50, r.p90) == (p50, p90)
    assert r.max == float(max(xs))
    assert r.mean == pytest.approx(sum(xs) / n)


def _hist_df(spark, bags):
    rows = []
    for g, (c, p) in bags.items():
        for tok in set(c) | set(p):
            rows.append(("d", "t", g, tok, c.get(tok, 0), p.get(tok, 0)))
    schema = "dataset string, task string, split string, token string, n_clean long, n_perturbed long"
    return spark.createDataFrame(rows, schema)


def test_js_divergence_cases(spark):
    bags = {
        "same": (Counter(a=3, b=1), Counter(a=3, b=1)),
        "disjoint": (Counter(a=5), Counter(b=5)),
        "one_empty": (Counter(a=2, b=2), Counter()),
        "mixed": (Counter(le=10, chat=3, x=1), Counter(le=8, the=4, chat=3)),
    }
    h = _hist_df(spark, bags)
    groups = spark.createDataFrame([("d", "t", g) for g in list(bags) + ["both_empty"]], "dataset string, task string, split string")
    got = {r.split: r.token_js_divergence_bits for r in tk.js_divergence(h, groups).collect()}
    assert got["one_empty"] == pytest.approx(0.0, abs=1e-9)  # an empty side is uniform over the other's tokens
    # entropy of the mean less the mean entropy of (10, 3, 1)/14 and (8, 3, 4)/15 over le, chat, x, the
    assert got["mixed"] == pytest.approx(0.17872467951, abs=1e-9)
    assert got["same"] == pytest.approx(0.0, abs=1e-12)
    assert got["disjoint"] == pytest.approx(1.0, abs=1e-6)
    assert got["both_empty"] == 0.0
    assert all(0.0 <= v <= 1.0 + 1e-9 for v in got.values())


def test_strip_echo_and_prompt_fields(spark):
    df = spark.createDataFrame(
        [("PROMPT answer ", "PROMPT", "causal"), ("PROMPT answer", "PROMPT", "seq2seq"), ("no echo", "PROMPT", "causal")],
        "t string, p string, k string",
    )
    got = [r.a for r in df.select(tx.strip_echo("t", "p", "k").alias("a")).collect()]
    assert got == ["answer", "PROMPT answer", "no echo"]
    p = spark.createDataFrame(
        [("Premise: a: b\nHypothesis: c\n premise:  last ", None, None)], "input string, text_a string, text_b string"
    ).withColumn("prompt", F.lit(None).cast("string"))
    prem, hyp = tx.prompt_fields()
    r = p.select(prem.alias("p"), hyp.alias("h")).collect()[0]
    assert (r.p, r.h) == ("last", "c")


def test_eval_prompt_and_first_answer(spark):
    df = spark.createDataFrame([("p", "i"), (None, "i"), ("", None)], "prompt string, input string")
    got = [r.x for r in df.select(tx.eval_prompt().alias("x")).collect()]
    assert got == ["p", "i", ""]
    bad = spark.createDataFrame([(None, None)], "prompt string, input string")
    with pytest.raises(Exception):
        bad.select(tx.eval_prompt()).collect()
    a = spark.createDataFrame([(["x", "y"], "z"), ([], "z"), (None, None), ([], None)], "t array<string>, answer string")
    assert [r.a for r in a.select(tx.first_answer("t", "answer").alias("a")).collect()] == ["x", "z", "", ""]
    f = spark.createDataFrame([("des pommes",), (" des bananes ",)], "x string")
    assert [r.a for r in f.select(tx.fruit_answer("x").alias("a")).collect()] == ["pommes", "bananes"]
