"""Perturbation golden rows and invariants, determinism across layouts, builder invariants."""

from pyspark.sql import functions as F

from pairshift.functions.perturb import with_perturbation
from pairshift.operators import build
from pairshift.sources import tables as tb

SF = "/root/testdata/sf0.01"


def _perturbed(df):
    keys = [F.col("split"), F.col("pair_id")]
    return with_perturbation(df, "a_clean", "a_insert", keys, "a", "out", 42)


BASE = "Le chat ne mange pas le poisson ce soir"
INSERT = "The cat does not eat the fish tonight you are"
# pair id -> text, span length, place and span (none: not applied), tokens dropped, abbreviated, punctuation;
# worked out from the keyed draws once and kept
GOLDEN = {
    "0": (BASE, 0, None, "", 0, 0, ""),
    "2": ("Le chat ne mange not eat the fish pas le poisson ce soir", 4, 4, "not eat the fish", 0, 0, ""),
    "4": ("Le chat ne mange u are pas le poisson ce soir", 2, 4, "you are", 0, 1, ""),
    "5": ("Le chat ne eat the fish tonight you are mange pas le poisson ce soir", 6, 3, "eat the fish tonight you are", 0, 0, ""),
    "10": ("Le fish tonight u r chat ne mange pas le poisson ce soir", 4, 1, "fish tonight you are", 0, 2, ""),
    "11": ("Le chat ne does not eat the fish mange pas le poisson ce soir!", 5, 3, "does not eat the fish", 0, 0, "!"),
}
SHORT = {"y0": "you are ne pas here", "y1": "you r ne pas here", "y3": "u are ne pas here", "y6": "you are pas here", "y7": "you are ne here",
         "y9": "you are ne pas here!!"}


def test_perturbation_golden_rows(spark):
    rows = [(k, "test", BASE, INSERT) for k in GOLDEN] + [(k, "test", "you are ne pas here", "a b") for k in SHORT]
    df = spark.createDataFrame(rows, "pair_id string, split string, a_clean string, a_insert string")
    got = {r.pair_id: r for r in _perturbed(df).collect()}
    for k, (text, n, at, span, dropped, abbreviated, mark) in GOLDEN.items():
        cs, nz = got[k].out_meta.code_switch, got[k].out_meta.noise
        assert got[k].out == text
        assert (cs.applied, cs.span_len, cs.insert_pos, cs.insert_lang_span) == (n > 0, n, at, span)
        assert (nz.dropped_tokens, nz.abbreviations, nz.punct_added) == (dropped, abbreviated, mark)
    assert {k: got[k].out for k in SHORT} == SHORT
    assert not any(got[k].out_meta.code_switch.applied for k in SHORT)


def test_same_result_under_any_layout(spark):
    pairs = tb.nli_pairs(spark, SF).select("pair_id", "split", "a_clean", "a_insert")
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    a = sorted(_perturbed(pairs.repartition(1)).select("pair_id", "out").collect())
    b = sorted(_perturbed(pairs.repartition(7)).select("pair_id", "out").collect())
    c = sorted(_perturbed(pairs.orderBy(F.desc("pair_id"))).select("pair_id", "out").collect())
    assert a == b == c


def test_unapplied_and_unhit_keeps_tokens(spark):
    pairs = tb.nli_pairs(spark, SF)
    ex = _perturbed(pairs).select("a_clean", "out", "out_meta").collect()
    for r in ex:
        cs, nz = r.out_meta.code_switch, r.out_meta.noise
        if not cs.applied and nz.dropped_tokens == 0 and nz.abbreviations == 0:
            assert r.out[: len(r.out) - len(nz.punct_added)].split() == r.a_clean.split()
        if cs.applied and nz.dropped_tokens == 0 and nz.abbreviations == 0:
            toks = r.out[: len(r.out) - len(nz.punct_added)].split()
            pos, n = cs.insert_pos, cs.span_len
            assert toks[:pos] + toks[pos + n:] == r.a_clean.split()
            assert " ".join(toks[pos:pos + n]) == cs.insert_lang_span


def test_two_rows_per_pair_and_label_preserved(spark):
    ex = tb.nli_examples(spark, SF)
    rows = ex.select("pair_id", "variant", "label", "id").collect()
    assert len(rows) == 2 * 145
    by = {}
    for r in rows:
        by.setdefault(r.pair_id, []).append(r)
    for pid, rs in by.items():
        assert sorted(r.variant for r in rs) == ["clean", "perturbed"]
        assert len({r.label for r in rs}) == 1
        assert {r.id for r in rs} == {f"{pid}__clean", f"{pid}__perturbed"}


def test_legacy_builder_handles_missing_second_field(spark):
    rows = [("u1", "test", "Le chat est sur le tapis rouge", "The cat is on the red rug", None, None, "entailment"),
            ("u2", "test", "a", "b", "c", "d", "neutral"),
            ("u3", "test", "x", "y", "z", "w", "contradiction")]
    df = spark.createDataFrame(rows, "pair_id string, split string, a_clean string, a_insert string, b_clean string, b_insert string, label string")
    ex = build.build_examples(df, "nli", variant_name="switchmix").collect()
    assert len(ex) == 6
    assert {r.variant for r in ex} == {"clean", "switchmix"}
    u1 = [r for r in ex if r.pair_id == "u1"]
    assert all(r.text_b == "" for r in u1)
    tiny = [r for r in ex if r.pair_id in ("u2", "u3") and r.variant == "switchmix"]
    assert all(not r.metadata.perturbation.a.code_switch.applied for r in tiny)


def test_sampling_is_exact_and_deterministic(spark):
    docs = tb.read_table(spark, SF, "documents").select("doc_id")
    a = [r.doc_id for r in build.sample_n(docs, 37, "doc_id").collect()]
    b = [r.doc_id for r in build.sample_n(docs.repartition(5), 37, "doc_id").collect()]
    assert len(a) == 37 and a == b and len(set(a)) == 37
    p = tb.nli_pairs(spark, SF).select("pair_id", "split")
    s = build.sample_per_split(p, {"train": 10, "test": 1000}, "pair_id").groupBy("split").count().collect()
    got = {r.split: r["count"] for r in s}
    assert got["train"] == 10 and got["test"] == p.where("split = 'test'").count()


def test_lexicon_and_thresholds_are_parameters(spark):
    df = spark.createDataFrame([("p", "test", "le chat et le chien dorment ici", "x y z")],
                               "pair_id string, split string, a_clean string, a_insert string")
    out = with_perturbation(df, "a_clean", "a_insert", [F.col("split"), F.col("pair_id")], "a", "o", 42,
                            p_switch=1.0, noise_p=1.0, drop_words=("le",), abbreviations=(("chat", "ct"),),
                            punct_choices=("?",), min_tokens=3, max_span=2).collect()[0]
    cs, nz = out.o_meta.code_switch, out.o_meta.noise
    assert cs.applied and cs.span_len == 2
    assert nz.dropped_tokens == 2 and nz.abbreviations == 1 and nz.punct_added == "?"
    assert out.o.endswith("?") and " le " not in f" {out.o} " and "ct" in out.o.split()


def test_examples_identical_under_other_shuffle_layouts(spark):
    base = sorted(tb.nli_examples(spark, SF).select("id", "input").collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(tb.nli_examples(spark, SF).select("id", "input").collect()) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


SEED_NLI = [
    ("n1", "Le facteur passe devant la maison.", "The postman walks past the house.", "Quelqu'un est dehors.", "Somebody is outside.", "entailment"),
    ("n2", "La neige couvre tout le village.", "Snow covers the whole village.", "Il fait très chaud.", "It is very hot.", "contradiction"),
    ("n3", "Jeanne lit dans le train du soir.", "Jeanne reads on the evening train.", "Jeanne habite à la mer.", "Jeanne lives by the sea.", "neutral"),
]
SEED_QA = [
    ("q1", "Luc a réparé le vieux vélo avec son oncle, puis il est parti vers le lac avec deux amis.",
     "Luc repaired the old bicycle with his uncle, then he left for the lake with two friends.",
     "Où Luc est-il allé ?", "Where did Luc go?", "vers le lac"),
]


def test_seed_corpus_through_legacy_builder_and_stats(spark):
    from pairshift.operators import tokens as tk

    schema = "pair_id string, a_clean string, a_insert string, b_clean string, b_insert string, label string"
    nli = spark.createDataFrame(SEED_NLI, schema).withColumn("split", F.lit("test"))
    qa = spark.createDataFrame(SEED_QA, schema).withColumn("split", F.lit("test"))
    ex = build.build_examples(nli, "nli", variant_name="switchmix").unionByName(
        build.build_examples(qa, "qa", variant_name="switchmix"))
    rows = ex.collect()
    assert len(rows) == 8 and {r.variant for r in rows} == {"clean", "switchmix"}
    qa_pert = [r for r in rows if r.task == "qa" and r.variant == "switchmix"][0]
    cs = qa_pert.metadata.perturbation.a.code_switch
    assert cs.applied in (True, False) and (cs.span_len == 0) == (not cs.applied)
    st = {r.task: r for r in tk.tokenizer_stats(ex, "whitespace").collect()}
    assert st["nli"].n_pairs == 3 and st["qa"].n_pairs == 1


def test_applied_rate_on_eligible_pairs_near_p_switch(spark):
    ex = tb.nli_examples(spark, "/root/testdata/sf0.1").where("variant = 'perturbed'")
    rows = ex.select("metadata.perturbation.a.code_switch.applied", "text_a").collect()
    assert len(rows) == 1508
    rate = sum(r.applied for r in rows) / len(rows)
    assert abs(rate - 0.35) < 0.04
