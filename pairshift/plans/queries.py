"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole driver tables through the adapters in
``pairshift.sources.tables`` and runs the named operators on them. Doubles are
rounded to 6 places and counts cast to ``bigint`` so results compare exactly
with the DuckDB oracle in ``pairshift.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.functions import text as tx
from pairshift.functions.labels import parse_nli_label
from pairshift.functions.perturb import with_code_switch, with_informal_noise, with_perturbation
from pairshift.operators import build, inspect, pairing, reports, scoring, vectors
from pairshift.operators import tokens as tk
from pairshift.session import shared_path
from pairshift.sources import io
from pairshift.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEED = tb.SEED


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> Column:
    """Round half up to 6 places with plain IEEE operations (``floor(x * 1e6 + 0.5) / 1e6``),
    which any engine evaluates bit-identically; decimal-based rounding of a double
    disagrees between engines on ties such as 641/640."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (float sums are order-dependent)."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


def flat_examples(ex: DataFrame) -> DataFrame:
    """Examples with the nested provenance of fields A and B as flat columns."""
    cols = [F.col(c) for c in ("id", "pair_id", "task", "split", "variant", "input", "text_a", "text_b", "label")]
    for f in ("a", "b"):
        m = f"metadata.perturbation.{f}"
        cols += [
            F.col(f"{m}.code_switch.applied").alias(f"{f}_applied"),
            F.col(f"{m}.code_switch.span_len").alias(f"{f}_span_len"),
            F.col(f"{m}.code_switch.insert_pos").alias(f"{f}_insert_pos"),
            F.col(f"{m}.code_switch.insert_lang_span").alias(f"{f}_span"),
            F.col(f"{m}.noise.dropped_tokens").alias(f"{f}_dropped"),
            F.col(f"{m}.noise.abbreviations").alias(f"{f}_abbr"),
            F.col(f"{m}.noise.punct_added").alias(f"{f}_punct"),
        ]
    return ex.select(*cols)


def nli_ex(spark: SparkSession, d: str, insert: str = "en") -> DataFrame:
    return tb.nli_examples(spark, d, "fr", insert).withColumn("dataset", F.lit(f"docs_fr-{insert}"))


def qa_ex(spark: SparkSession, d: str) -> DataFrame:
    return tb.qa_examples(spark, d).withColumn("dataset", F.lit("conv_fr-en"))


def nli_preds(spark: SparkSession, d: str, insert: str = "en") -> DataFrame:
    return tb.nli_predictions(nli_ex(spark, d, insert)).withColumn("language_pair", F.lit(f"fr-{insert}"))


# ---------------------------------------------------------------- text scalars
@register("normalize_ws")
def q_normalize_ws(spark, d):
    """T1 over every document."""
    return tb.read_table(spark, d, "documents").select("doc_id", tx.normalize_ws("text").alias("normalized"))


@register("simple_tokenize")
def q_simple_tokenize(spark, d):
    """T2 over every document: token count and the tokens joined by spaces."""
    t = tx.simple_tokenize("text")
    return tb.read_table(spark, d, "documents").select(
        "doc_id", F.size(t).cast("int").alias("n_tokens"), F.array_join(t, " ").alias("tokens")
    )


@register("normalize_answer")
def q_normalize_answer(spark, d):
    """T3 over every conversation turn."""
    return tb.read_table(spark, d, "conversations").select("conv_id", "turn", tx.normalize_answer("text").alias("normalized"))


@register("char_word_counts")
def q_char_word_counts(spark, d):
    """T7/T8 over every document."""
    return tb.read_table(spark, d, "documents").select(
        "doc_id", tx.chars_no_ws("text").alias("chars_no_ws"), tx.word_count("text").alias("words")
    )


# ---------------------------------------------------------------- sources, zip, sampling
@register("parallel_zip")
def q_parallel_zip(spark, d):
    """J5/IO12: French and English NLI corpora aligned by position."""
    z = tb.nli_source(spark, d)
    return z.select(F.col("idx").cast("long").alias("idx"), F.col("b_id").alias("base_id"), F.col("i_id").alias("insert_id"), "split")


@register("parallel_zip_file_order")
def q_parallel_zip_file_order(spark, d):
    """Two corpora zipped in file order, whatever their keys: documents with conversation turns."""
    base = io.read_in_file_order(spark, f"{d}/documents.parquet").select("idx", "doc_id", "text")
    insert = io.read_in_file_order(spark, f"{d}/conversations.parquet").select("idx", "conv_id", "turn", "text")
    z = build.parallel_zip(base, insert, on=("idx",))
    return z.select("idx", "b_doc_id", "i_conv_id", "i_turn", F.length("b_text").cast("long").alias("base_chars"), F.length("i_text").cast("long").alias("insert_chars"))


@register("label_map")
def q_label_map(spark, d):
    """Pair ids and label names (integer 3 falls back to neutral)."""
    return tb.nli_pairs(spark, d).select("pair_id", "label")


@register("sample_n")
def q_sample_n(spark, d):
    """100 French documents without replacement, keyed random order."""
    fr = tb.read_table(spark, d, "documents").where(F.col("lang") == "fr").select("doc_id")
    return build.sample_n(fr, 100, "doc_id", seed=SEED)


@register("sample_half")
def q_sample_half(spark, d):
    """G13/G18 with a large n: half of what sf0.01 has, whole rows; the sample's place in the order is the draw."""
    docs = tb.read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return build.sample_n(docs, 500, "doc_id", seed=SEED)


@register("sample_per_split")
def q_sample_per_split(spark, d):
    """Per-split quotas (train 60, test 15) over the fr-en pairs."""
    p = tb.nli_pairs(spark, d).select("pair_id", "split")
    return build.sample_per_split(p, {"train": 60, "test": 15}, "pair_id", seed=SEED)


# ---------------------------------------------------------------- perturbation
def _pairs_a(spark, d):
    return tb.nli_pairs(spark, d).select("pair_id", "split", "a_clean", "a_insert")


@register("code_switch")
def q_code_switch(spark, d):
    """G1: premise with an English span spliced in (or verbatim)."""
    df = with_code_switch(_pairs_a(spark, d), "a_clean", "a_insert", [F.col("split"), F.col("pair_id")], "a", "cs", SEED)
    return df.select("pair_id", F.col("cs_mixed").alias("mixed"))


@register("code_switch_meta")
def q_code_switch_meta(spark, d):
    """Code-switch provenance per premise."""
    df = with_code_switch(_pairs_a(spark, d), "a_clean", "a_insert", [F.col("split"), F.col("pair_id")], "a", "cs", SEED)
    return df.select(
        "pair_id", F.col("cs_cs.applied").alias("applied"), F.col("cs_cs.span_len").alias("span_len"),
        F.col("cs_cs.insert_pos").alias("insert_pos"), F.col("cs_cs.insert_lang_span").alias("span"),
    )


def _noised(spark, d):
    df = _pairs_a(spark, d).withColumn("_t", tx.ws_tokens("a_clean"))
    return with_informal_noise(df, "_t", [F.col("split"), F.col("pair_id")], "a", "nz", SEED)


@register("informal_noise")
def q_informal_noise(spark, d):
    """Informal noise alone on every premise."""
    return _noised(spark, d).select("pair_id", F.col("nz_text").alias("noised"))


@register("informal_noise_meta")
def q_informal_noise_meta(spark, d):
    """Noise provenance (drops, abbreviations, punctuation)."""
    return _noised(spark, d).select(
        "pair_id", F.col("nz_noise.dropped_tokens").alias("dropped"), F.col("nz_noise.abbreviations").alias("abbr"),
        F.col("nz_noise.punct_added").alias("punct"),
    )


@register("perturb")
def q_perturb(spark, d):
    """Code-switch then noise on both fields."""
    df = tb.nli_pairs(spark, d)
    keys = [F.col("split"), F.col("pair_id")]
    df = with_perturbation(df, "a_clean", "a_insert", keys, "a", "a_pert", SEED)
    df = with_perturbation(df, "b_clean", "b_insert", keys, "b", "b_pert", SEED)
    return df.select("pair_id", "a_pert", "b_pert")


# ---------------------------------------------------------------- prompts
@register("nli_prompt")
def q_nli_prompt(spark, d):
    """T9 on every fr-en pair."""
    return tb.nli_pairs(spark, d).select("pair_id", tx.nli_prompt("a_clean", "b_clean").alias("prompt"))


@register("qa_prompt")
def q_qa_prompt(spark, d):
    """T10 on every QA pair."""
    p = build.qa_pairs_from_zip(tb.qa_source(spark, d), "conv_fr-en", "fr")
    return p.select("pair_id", tx.qa_prompt("a_clean", "b_clean").alias("prompt"))


@register("legacy_frame")
def q_legacy_frame(spark, d):
    """Legacy two-frame dataset from French documents."""
    return build.legacy_frame_examples(tb.legacy_raw(spark, d), seed=SEED).select("id", "variant", "input", "label")


@register("prompt_parse")
def q_prompt_parse(spark, d):
    """premise/hypothesis from fields, or parsed back from prompt lines."""
    leg = build.legacy_frame_examples(tb.legacy_raw(spark, d), seed=SEED).select(
        "id", "input", F.lit(None).cast("string").alias("prompt"),
        F.lit(None).cast("string").alias("text_a"), F.lit(None).cast("string").alias("text_b"))
    ex = nli_ex(spark, d).select("id", "input", "prompt", "text_a", "text_b")
    df = leg.unionByName(ex)
    prem, hyp = tx.prompt_fields()
    return df.select("id", prem.alias("premise"), hyp.alias("hypothesis"))


@register("strip_echo")
def q_strip_echo(spark, d):
    """Outputs of a causal model that echo the prompt are cut after it."""
    p = nli_preds(spark, d)
    kind = F.when(F.col("model") == F.lit(tb.ADAPTER_MODELS[1]), F.lit("causal")).otherwise(F.lit("seq2seq"))
    raw = F.when(kind == "causal", F.concat(F.col("input"), F.lit("\n"), F.col("prediction"))).otherwise(F.col("prediction"))
    return p.select("id", "model", tx.strip_echo(raw, F.col("input"), kind).alias("answer"))


# ---------------------------------------------------------------- builders
@register("build_nli_examples")
def q_build_nli_examples(spark, d):
    """French documents zipped with English ones, two rows per pair."""
    return flat_examples(tb.nli_examples(spark, d))


@register("build_qa_examples")
def q_build_qa_examples(spark, d):
    """user/assistant turns zipped with English documents, two rows per pair."""
    return flat_examples(tb.qa_examples(spark, d))


@register("build_legacy_pairs")
def q_build_legacy_pairs(spark, d):
    """Prototype builder (variant name ``switchmix``) over the fr-en pairs."""
    ex = build.build_examples(tb.nli_pairs(spark, d), "nli", "fr", "en", seed=SEED, variant_name="switchmix")
    return flat_examples(ex)


def _syn_keys(spark, d):
    return tb.read_table(spark, d, "documents").select("doc_id")


@register("synthetic_nli")
def q_synthetic_nli(spark, d):
    """One templated NLI example per document key."""
    return build.synthetic_nli(_syn_keys(spark, d), "doc_id", seed=SEED)


@register("synthetic_qa")
def q_synthetic_qa(spark, d):
    """One templated QA example per document key."""
    return build.synthetic_qa(_syn_keys(spark, d), "doc_id", seed=SEED)


@register("build_synthetic_examples")
def q_build_synthetic_examples(spark, d):
    """Templated NLI examples through the two-row builder."""
    s = build.synthetic_nli(_syn_keys(spark, d).withColumnRenamed("doc_id", "k"), "k", seed=SEED)
    s = s.withColumn("_k", F.regexp_extract("pair_id", r"(\d+)$", 1).cast("long"))
    pairs = s.select(
        "pair_id", F.when(F.col("_k") % 5 < 4, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        F.col("premise_fr").alias("a_clean"), F.col("premise_en").alias("a_insert"),
        F.col("hypothesis_fr").alias("b_clean"), F.col("hypothesis_en").alias("b_insert"), "label",
    )
    return flat_examples(build.build_examples(pairs, "nli", "fr", "en", seed=SEED))


# ---------------------------------------------------------------- pairing
def damaged(spark, d):
    return tb.damaged_examples(nli_ex(spark, d))


@register("pair_key")
def q_pair_key(spark, d):
    """J2 on damaged examples (null pair ids fall back to the id prefix)."""
    return damaged(spark, d).select("id", "variant", pairing.pair_key().alias("pair_key"))


@register("pair_rows")
def q_pair_rows(spark, d):
    """Last row per variant wins, switchmix aliases perturbed, incomplete pairs dropped."""
    p = pairing.pair_rows(damaged(spark, d), dataset_col="dataset")
    return p.select("dataset", "pair_id", F.col("clean.id").alias("clean_id"), F.col("perturbed.id").alias("perturbed_id"),
                    "task", "split", F.length("clean_text").cast("long").alias("clean_len"),
                    F.length("perturbed_text").cast("long").alias("perturbed_len"))


@register("pair_rows_without_id")
def q_pair_rows_without_id(spark, d):
    """J1/J2 on prototype rows that carry a pair id and no id: no row is lost."""
    p = pairing.pair_rows(nli_ex(spark, d).withColumn("id", F.lit(None).cast("string")), dataset_col="dataset")
    return p.select("dataset", "pair_id", "task", "split", F.length("clean_text").cast("long").alias("clean_len"),
                    F.length("perturbed_text").cast("long").alias("perturbed_len"))


@register("build_from_parallel")
def q_build_from_parallel(spark, d):
    """French and English documents aligned per split by position, sampled to per-split quotas, built."""
    from pairshift.operators.index import with_dense_index

    def side(lang: str) -> DataFrame:
        docs = tb.corpus_texts(spark, d, lang, "premise", "hypothesis").withColumn(
            "split", F.when(F.col("doc_id") % 5 < 4, F.lit("train")).otherwise(F.lit("test")))
        pos = with_dense_index(docs.select("doc_id", "split"), ["doc_id"], ["split"]).select("doc_id", "idx")
        return docs.join(pos, on="doc_id").select(
            F.col("doc_id").cast("string").alias("id"), "split", "idx", "premise", "hypothesis", (F.col("doc_id") % 4).cast("int").alias("label"))

    ex = build.build_from_parallel(side("fr"), side("en").drop("label"), "nli", "docs", quotas={"train": 30, "test": 10}, seed=SEED)
    return ex.select("id", "pair_id", "split", "variant", "label", F.length("input").cast("long").alias("input_len"))


@register("max_pairs_limit")
def q_max_pairs_limit(spark, d):
    """First 40 pair keys per dataset in first-seen order, then incomplete pairs dropped."""
    both = damaged(spark, d).unionByName(tb.damaged_examples(qa_ex(spark, d)), allowMissingColumns=True)
    p = pairing.pair_rows(both, dataset_col="dataset", max_pairs=40)
    return p.select("dataset", "pair_id")


@register("pair_size_histogram")
def q_pair_size_histogram(spark, d):
    """Rows per pair key as the inspector pairs them."""
    return inspect.pair_size_histogram(damaged(spark, d))


# ---------------------------------------------------------------- tokens
@register("pair_token_deltas")
def q_pair_token_deltas(spark, d):
    """M2 per pair (simple tokenizer)."""
    p = pairing.pair_rows(nli_ex(spark, d), dataset_col="dataset")
    return rounded(tk.pair_token_deltas(p, "simple"))


@register("token_histogram")
def q_token_histogram(spark, d):
    """Token counts per group, clean vs perturbed (whitespace tokenizer)."""
    p = pairing.pair_rows(nli_ex(spark, d), dataset_col="dataset")
    return tk.token_histogram(p, "whitespace")


@register("js_divergence")
def q_js_divergence(spark, d):
    """JS divergence (bits) of the whitespace-token distributions per group."""
    return rounded(tk.js_divergence_of_examples(nli_ex(spark, d), "whitespace", dataset_col="dataset"))


@register("tokenizer_stats")
def q_tokenizer_stats(spark, d):
    """A7-A9 with the word/punctuation tokenizer over the fr-en examples."""
    return rounded(tk.tokenizer_stats(nli_ex(spark, d), "simple", dataset_col="dataset"))


# ---------------------------------------------------------------- scoring
@register("parse_label_variants")
def q_parse_label_variants(spark, d):
    """T5: parser with verb forms over every model output."""
    p = nli_preds(spark, d)
    return p.select("id", "model", "prediction", parse_nli_label("prediction", True).alias("parsed"))


@register("parse_label_plain")
def q_parse_label_plain(spark, d):
    """Parser without verb forms."""
    p = nli_preds(spark, d)
    return p.select("id", "model", "prediction", parse_nli_label("prediction", False).alias("parsed"))


def _qa_preds(spark, d):
    return tb.qa_predictions(qa_ex(spark, d))


@register("f1_per_example")
def q_f1_per_example(spark, d):
    """M1/T4: multiset token F1 of every QA answer (exploded form, whole texts)."""
    f = scoring.f1_per_example(_qa_preds(spark, d), ["id", "model"])
    return rounded(f.select("id", "model", F.col("n_pred").cast("int").alias("n_pred"), F.col("n_gold").cast("int").alias("n_gold"), "f1"))


@register("accuracy_normalized")
def q_accuracy_normalized(spark, d):
    """A1: evaluator accuracy (parsed with T5, both sides normalised) per model and variant."""
    p = nli_preds(spark, d).withColumn("parsed", parse_nli_label("prediction", True))
    return rounded(scoring.accuracy(p, ["model", "variant"], pred="parsed"))


@register("exact_match")
def q_exact_match(spark, d):
    """A2: QA exact match per model and variant."""
    return rounded(scoring.exact_match(_qa_preds(spark, d), ["model", "variant"]))


@register("mean_f1")
def q_mean_f1(spark, d):
    """A3: mean token F1 per model and variant."""
    f = scoring.f1_per_example(_qa_preds(spark, d), ["id", "model", "variant"])
    return rounded(scoring.mean_f1(f, ["model", "variant"]))


@register("robustness_drop")
def q_robustness_drop(spark, d):
    """A5: clean minus perturbed accuracy (lower+strip compare of the parsed label)."""
    p = nli_preds(spark, d).withColumn("parsed", parse_nli_label("prediction", True))
    return rounded(scoring.robustness_drop(p, ["model"], pred="parsed"))


@register("robustness_report")
def q_robustness_report(spark, d):
    """Robustness summary per (language pair, task, model), NLI and QA."""
    qa = _qa_preds(spark, d).withColumn("language_pair", F.lit("fr-en"))
    both = nli_preds(spark, d).unionByName(qa, allowMissingColumns=True)
    return rounded(scoring.robustness_report(both))


@register("score_join")
def q_score_join(spark, d):
    """Predictions kept as their own table and joined back to examples on (id)."""
    ex = nli_ex(spark, d)
    preds = tb.nli_predictions(ex).select("id", "model", "prediction")
    j = ex.select("id", "variant", "label").join(preds, on="id")
    j = j.withColumn("parsed", parse_nli_label("prediction", True))
    return rounded(scoring.accuracy(j, ["model", "variant"], pred="parsed"))


@register("baseline_random")
def q_baseline_random(spark, d):
    """Seeded random-label baseline over NLI and QA examples."""
    both = nli_ex(spark, d).unionByName(qa_ex(spark, d))
    return scoring.baseline_random(both, seed=SEED).select("id", "task", "model", "prediction")


@register("filter_task_split")
def q_filter_task_split(spark, d):
    """rows of one task, split and variant."""
    ex = nli_ex(spark, d).unionByName(qa_ex(spark, d))
    return ex.where((F.col("task") == "nli") & (F.col("split") == "test") & (F.col("variant") == "clean")).select("id")


@register("first_n_examples")
def q_first_n_examples(spark, d):
    """the first 25 examples by id (a limit is the feature here)."""
    return nli_ex(spark, d).select("id", "label").orderBy("id").limit(25)


@register("skip_counts")
def q_skip_counts(spark, d):
    """Rows skipped for an empty premise/hypothesis or unknown label, per split and variant."""
    v = scoring.nli_validity(nli_ex(spark, d))
    return v.groupBy("split", "variant").agg(
        F.count(F.when(F.col("_valid"), 1)).cast("long").alias("n_valid"),
        F.count(F.when(~F.col("_valid"), 1)).cast("long").alias("n_skipped"),
    )


# ---------------------------------------------------------------- reports
def _cross(spark, d, models=None) -> DataFrame:
    """Robustness of the three language pairs; ``models`` names a pair's models where they are not all."""
    rows = []
    for ins in ("en", "es", "de"):
        preds = tb.nli_predictions(nli_ex(spark, d, ins), models=(models or {}).get(ins, tb.ADAPTER_MODELS))
        rows.append(scoring.robustness_report(preds.withColumn("language_pair", F.lit(f"fr-{ins}"))))
    return reports.cross_language(reports.all_results(rows))


@register("cross_language")
def q_cross_language(spark, d):
    """NLI robustness per language pair (fr-en, fr-es, fr-de) and model."""
    return rounded(_cross(spark, d))


@register("cross_language_pivot")
def q_cross_language_pivot(spark, d):
    """Mean drop per language pair (rows) and model (columns); the second model has no predictions for fr-de,
    so that cell is 0.0."""
    some = _cross(spark, d, models={"de": tb.ADAPTER_MODELS[:1]})
    p = reports.cross_language_pivot(some, list(tb.ADAPTER_MODELS))
    return rounded(p.toDF("language_pair", "drop_model_a", "drop_model_b"))


@register("paper_table")
def q_paper_table(spark, d):
    """The five paper columns."""
    return rounded(reports.paper_table(_cross(spark, d)))


@register("all_results")
def q_all_results(spark, d):
    """Robustness summary and cross-language table in one outer union."""
    rep = scoring.robustness_report(nli_preds(spark, d))
    return rounded(reports.all_results([rep, _cross(spark, d)]))


# ---------------------------------------------------------------- inspection
@register("counts_by_dim")
def q_counts_by_dim(spark, d):
    """Row counts by variant, task and split (grouping sets)."""
    return inspect.counts_by_dim(nli_ex(spark, d))


@register("length_stats")
def q_length_stats(spark, d):
    """Nearest-rank length stats of clean and perturbed inputs."""
    return rounded(inspect.length_stats(nli_ex(spark, d)))


@register("perturbation_rates")
def q_perturbation_rates(spark, d):
    """Applied rate, span length, drops, abbreviations, punctuation per (task, split, label)."""
    return rounded(inspect.perturbation_rates(nli_ex(spark, d)))


@register("show_pairs")
def q_show_pairs(spark, d):
    """Five random pairs side by side (top-n by keyed draw)."""
    return inspect.show_pairs(nli_ex(spark, d), n=5, seed=SEED)


# ---------------------------------------------------------------- vectors, efficiency, models
@register("vector_drift")
def q_vector_drift(spark, d):
    """M3: cosine and drift per pair and layer."""
    return rounded(vectors.vector_drift(tb.vectors(spark, d)).select("pair_id", "layer", "cosine", "drift"))


@register("pool_cls")
def q_pool_cls(spark, d):
    """Drift between CLS-pooled token vectors."""
    return rounded(vectors.pooled_drift(tb.token_vectors(spark, d), "cls"))


@register("pool_mean")
def q_pool_mean(spark, d):
    """Drift between mask-aware mean-pooled token vectors."""
    return rounded(vectors.pooled_drift(tb.token_vectors(spark, d), "mean"))


@register("representation_shift")
def q_representation_shift(spark, d):
    """A10/O1: per-layer cosine summary (population std)."""
    return rounded(vectors.representation_shift(tb.vectors(spark, d), model="embeddings", pool="cls"))


@register("efficiency_summary")
def q_efficiency_summary(spark, d):
    """Truncated lengths and activation estimates per group."""
    hs = reports.hidden_size_from_config({"d_model": 512})
    return rounded(reports.efficiency_summary(nli_ex(spark, d), "encoder-512", hs, "simple", max_length=256, dataset_col="dataset"))


@register("logits_accuracy")
def q_logits_accuracy(spark, d):
    """M8: accuracy of the first-maximum class per model, split and variant (valid rows)."""
    lg = scoring.nli_validity(tb.logits_table(nli_ex(spark, d))).where(F.col("_valid"))
    hit = (scoring.argmax_first("logits") == F.col("_label_id")).cast("double")
    return rounded(lg.groupBy("model", "split", "variant").agg(
        F.avg(hit).alias("accuracy"), F.count(F.lit(1)).cast("long").alias("n")))


@register("scaling_table")
def q_scaling_table(spark, d):
    """Clean vs perturbed accuracy, skip counts and model size per model."""
    lg = tb.logits_table(nli_ex(spark, d))
    return rounded(scoring.scaling_table(lg, reports.model_sizes(spark), seed=SEED))


@register("model_size_lookup")
def q_model_size_lookup(spark, d):
    """Models seen in the predictions with their size (unknown -> null)."""
    return reports.model_size_lookup(nli_preds(spark, d))


@register("capacity_sweep")
def q_capacity_sweep(spark, d):
    """Hashed bag-of-tokens logistic regression at three capacities, clean vs perturbed
    accuracy (iterative model fitting: no SQL oracle)."""
    from pairshift.operators.sweep import capacity_sweep

    out = capacity_sweep(nli_ex(spark, d), capacities=(2 ** 8, 2 ** 10, 2 ** 12), seed=SEED)
    return out.drop("train_time_s")


@register("sweep_plan")
def q_sweep_plan(spark, d):
    """X4, the part that is exact: rows trained on, tested and skipped, and parameters, per capacity."""
    from pairshift.operators.sweep import sweep_plan

    return sweep_plan(nli_ex(spark, d))


@register("predict_hook")
def q_predict_hook(spark, d):
    """A user predictor over every NLI prompt (here: a label by the prompt's length)."""
    from pairshift.operators.ml import predict

    ex = nli_ex(spark, d).select("id", "variant", "prompt")
    return predict(ex, lambda s: s.str.len().map(lambda n: tb.NLI_LABELS[n % 3])).select("id", "variant", "prediction")


@register("filter_task")
def q_filter_task(spark, d):
    """the rows of one task."""
    both = nli_ex(spark, d).unionByName(qa_ex(spark, d))
    return both.where(F.col("task") == "qa").select("id", "split", "variant")


@register("distinct_models")
def q_distinct_models(spark, d):
    """O3: models and language pairs seen in the predictions."""
    return reports.distinct_values(nli_preds(spark, d).unionByName(nli_preds(spark, d, "es")))


@register("qa_f1_report")
def q_qa_f1_report(spark, d):
    """A3 by variant: QA robustness by mean token F1."""
    return rounded(scoring.qa_f1_report(_qa_preds(spark, d).withColumn("language_pair", F.lit("fr-en"))))


@register("efficiency_latency")
def q_efficiency_latency(spark, d):
    """A11 with latencies from an input column (here: a keyed draw per row, in milliseconds)."""
    from pairshift.functions.draws import u01

    ex = nli_ex(spark, d).withColumn("latency_ms", u01(SEED, "latency", F.col("id")) * 50)
    out = reports.efficiency_summary(ex, "encoder-512", 512, "simple", dataset_col="dataset", latency_col="latency_ms")
    return rounded(out.select("data_path", "task", "split", "n_pairs", "avg_latency_ms_clean", "avg_latency_ms_perturbed"))


def _written_examples(spark, d, fmt: str) -> DataFrame:
    """The NLI examples written to the shared folder as a dataset and read back by the readers."""
    path = shared_path(spark, f"dataset-{fmt}")
    io.write_dataset(nli_ex(spark, d).drop("dataset"), path, fmt=fmt)
    return io.read_examples(spark, path)


@register("examples_jsonl_roundtrip")
def q_examples_jsonl_roundtrip(spark, d):
    """IO3/IO4/IO6/IO7/U2: JSON lines in task / language pair / split folders, read back by the folder's name as one
    dataset; the pairs that the pairing finds there."""
    back = _written_examples(spark, d, "jsonl")
    p = pairing.pair_rows(back, dataset_col="dataset")
    return p.select("pair_id", F.length("clean_text").cast("long").alias("clean_len"), F.length("perturbed_text").cast("long").alias("perturbed_len"))


@register("examples_parquet_roundtrip")
def q_examples_parquet_roundtrip(spark, d):
    """IO3/IO5/IO6: the same as Parquet; the example rows with their provenance."""
    back = _written_examples(spark, d, "parquet")
    return back.select("id", "pair_id", "variant", "input", "label", F.col("metadata.perturbation.a.code_switch.span_len").alias("a_span_len"))


@register("json_array_documents")
def q_json_array_documents(spark, d):
    """IO1: documents as JSON arrays (one per 500 ids, one file each) read back object by object from any split."""
    path = shared_path(spark, "json-arrays")
    docs = tb.read_table(spark, d, "documents").select("doc_id", "text", "lang", F.struct(F.col("source").alias("name"), "n_chars").alias("origin"))
    arrays = docs.groupBy(F.expr("doc_id div 500").alias("part")).agg(
        F.concat(F.lit("["), F.concat_ws(",\n ", F.collect_list(F.to_json(F.struct("doc_id", "text", "lang", "origin")))), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = io.read_json_arrays(spark, path, docs.schema)
    return back.select("doc_id", "lang", F.col("origin.name").alias("source"), F.col("origin.n_chars").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("pair_table")
def q_pair_table(spark, d):
    """J1/J4 over a stored layout: damaged examples as a table bucketed by the pair key, paired without a shuffle on it."""
    path = shared_path(spark, "pair-table")
    table = io.write_pair_table(damaged(spark, d), "pairs_" + path.rsplit("-", 1)[1], path, 16, dataset_col="dataset")
    p = pairing.pair_rows(table, dataset_col="dataset", order_col="stored_order", keyed=True)
    return p.select("dataset", "pair_id", F.col("clean.id").alias("clean_id"), F.col("perturbed.id").alias("perturbed_id"), "task", "split",
                    F.length("clean_text").cast("long").alias("clean_len"), F.length("perturbed_text").cast("long").alias("perturbed_len"))


@register("metric_table_roundtrip")
def q_metric_table_roundtrip(spark, d):
    """IO8-IO10: the robustness summary written as CSV with a header row and read back with typed columns."""
    path = shared_path(spark, "metrics")
    io.write_metric_table(rounded(scoring.robustness_report(nli_preds(spark, d))).drop("language_pair"), path)
    return io.read_metric_tables(spark, path).select("model", "task", "clean_score", "switchmix_score", "robustness_drop")


@register("metric_tables_layouts")
def q_metric_tables_layouts(spark, d):
    """IO8/IO10/IO11: three CSV tables of different layouts (a summary with its pair in the name, a table with its own
    ``language_pair``, model sizes) read by one pattern, with all their columns."""
    folder = shared_path(spark, "tables")
    summary = rounded(scoring.robustness_report(nli_preds(spark, d, "es")))
    io.write_metric_table(summary.select("robustness_drop", "task", "model", "clean_score", "switchmix_score"), f"{folder}/robustness_summary_fr-es.csv")
    io.write_metric_table(rounded(_cross(spark, d)), f"{folder}/cross_language_robustness.csv")
    io.write_metric_table(reports.model_size_lookup(nli_preds(spark, d)), f"{folder}/model_sizes.csv")
    tables = io.read_metric_tables(spark, f"{folder}/*.csv")
    return io.promote_columns(tables, T.StructType([T.StructField("estimated_model_size", T.LongType())])).drop("extra")


@register("eval_prompt")
def q_eval_prompt(spark, d):
    """The evaluator's text, ``prompt`` else ``input``; a keyed ~third of the
    examples arrive without ``prompt`` (as in files that only carry ``input``)."""
    from pairshift.functions.draws import u01

    ex = nli_ex(spark, d).withColumn(
        "prompt", F.when(u01(SEED, "no_prompt", F.col("id")) < 0.3, F.lit(None).cast("string")).otherwise(F.col("prompt")))
    return ex.select("id", tx.eval_prompt().alias("text"))


@register("first_answer")
def q_first_answer(spark, d):
    """Gold answer from ``answers.text[0]``, else ``answer``, else ``''`` over QA turns;
    a keyed ~third arrive with an empty ``answers.text`` list."""
    from pairshift.functions.draws import u01

    t = tb.qa_turns(spark, d)
    empty = u01(SEED, "no_answers", F.col("id")) < 0.3
    answers = F.when(empty, F.array().cast("array<string>")).otherwise(F.array(F.col("answer"), F.col("question")))
    return t.select("id", tx.first_answer(answers, F.col("question")).alias("answer"))
