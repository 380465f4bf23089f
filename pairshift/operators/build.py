"""Paired-dataset construction: positional zip, sampling, two-row emission.

Shape of a build: ``parallel_zip`` (one shuffle join on the position) ->
optional sampling -> one projection holding every draw and both perturbations
-> ``explode`` of the two variants. After the zip and the sampling
there is no further shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.functions import text as tx
from pairshift.functions.draws import pick, u01
from pairshift.functions.perturb import (
    DEFAULT_NOISE_P,
    DEFAULT_P_SWITCH,
    FIELD_META_TYPE,
    with_perturbation,
)
from pairshift.operators.index import with_dense_index
from pairshift.operators.select import nth_smallest

# FIXED VALUES: integer NLI labels of the parallel corpora; unknown ids become "neutral".
NLI_LABEL_NAMES = {0: "entailment", 1: "neutral", 2: "contradiction"}
DEFAULT_NLI_LABEL = "neutral"

PARAMS_TYPE = T.StructType([
    T.StructField("p_switch", T.DoubleType()),
    T.StructField("noise_p", T.DoubleType()),
])
PERTURBATION_META_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("a", FIELD_META_TYPE),
    T.StructField("b", FIELD_META_TYPE),
    T.StructField("params", PARAMS_TYPE),
])


def label_name(label_int, names: Mapping[int, str] = NLI_LABEL_NAMES, default: str = DEFAULT_NLI_LABEL) -> Column:
    """Integer label -> name, unknown -> ``default`` (a literal map, no join)."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    c = F.col(label_int) if isinstance(label_int, str) else label_int
    return F.coalesce(F.element_at(m, c.cast("int")), F.lit(default))


def positions(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (), out: str = "idx") -> DataFrame:
    """0-based position of each row by ``order_col`` (inside ``partition_cols``)."""
    return with_dense_index(df, [order_col], partition_cols, out)


def parallel_zip(
    base: DataFrame,
    insert: DataFrame,
    on: Sequence[str] = ("split", "idx"),
    base_prefix: str = "b_",
    insert_prefix: str = "i_",
) -> DataFrame:
    """Align two corpora by position, truncated to the shorter (inner join).

    Both sides must already carry the position columns (see ``positions``).
    Non-key columns are prefixed so the two sides never collide.
    """
    keys = list(on)
    b = base.select(*keys, *[F.col(c).alias(base_prefix + c) for c in base.columns if c not in keys])
    i = insert.select(*keys, *[F.col(c).alias(insert_prefix + c) for c in insert.columns if c not in keys])
    return b.join(i, on=keys, how="inner")


def pair_id_fallback(id_col, dataset: str, lang: str, split_col, idx_col) -> Column:
    """Source id if present, else ``{dataset}_{lang}_{split}_{i}``."""
    return F.coalesce(
        F.nullif(F.col(id_col).cast("string"), F.lit("")),
        F.concat_ws("_", F.lit(dataset), F.lit(lang), F.col(split_col), F.col(idx_col).cast("string")),
    )


SAMPLE_STRIPS = 64


def sample_n(df: DataFrame, n: int, key_col: str, seed=42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, in random order.

    The order is a keyed draw (ties broken by the key, which must be unique), so the sample does not depend on
    partitioning. The n-th smallest draw is found by distributed selection (``select.nth_smallest``), then one filter
    keeps the rows up to it: no task gathers n rows, and the wide rows move only for the final sort.
    """
    if n <= 0:
        return df.where(F.lit(False))
    draw = u01(seed, "sample", F.col(key_col))
    last = nth_smallest(df, draw, key_col, n)
    drawn = df.withColumn("_draw", draw)
    chosen = drawn.where(F.coalesce(F.struct(F.col("_draw").alias("draw"), F.col(key_col).alias("key")) <= last, F.lit(True)))
    return chosen.orderBy("_draw", key_col).drop("_draw")


def sample_per_split(df: DataFrame, quotas: Mapping[str, int], key_col: str, split_col: str = "split", seed=42) -> DataFrame:
    """Per-split quotas (a quota above the split size keeps the whole split).

    Ranking runs on narrow ``(key, split, draw)`` rows, first within ``SAMPLE_STRIPS`` hashed strips of each split and
    then among what the strips leave. The literal bound ``rn <= max(quotas)`` lets Spark insert a WindowGroupLimit
    before each exchange, so a split's last task holds at most ``SAMPLE_STRIPS x max quota`` narrow rows, whatever the
    number of partitions; the chosen keys are joined back to the full rows (``key_col`` must be unique).
    """
    qmap = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(int(v)))])
    top = max(int(v) for v in quotas.values()) if quotas else 0
    drawn = df.select(key_col, split_col, u01(seed, F.col(split_col), "sample", F.col(key_col)).alias("_draw"))
    strip = F.pmod(F.xxhash64(key_col), F.lit(SAMPLE_STRIPS))
    in_strip = Window.partitionBy(split_col, "_strip").orderBy("_draw", key_col)
    in_split = Window.partitionBy(split_col).orderBy("_draw", key_col)
    few = drawn.withColumn("_strip", strip).withColumn("_rn", F.row_number().over(in_strip)).where(F.col("_rn") <= F.lit(top)).drop("_rn", "_strip")
    picked = (
        few.withColumn("_rn", F.row_number().over(in_split))
        .where((F.col("_rn") <= F.lit(top)) & (F.col("_rn") <= F.coalesce(F.element_at(qmap, F.col(split_col)), F.lit(0))))
        .select(key_col)
    )
    return df.join(picked, on=key_col)


def _example_columns(
    variant: Column | str,
    pair_id: Column,
    task: str,
    split: Column,
    prompt: Column,
    text_a: Column,
    text_b: Column,
    label: Column,
    clean_lang: str,
    insert_lang: str,
    perturbation: Column,
    id_sep: str = "__",
) -> list[Column]:
    v = F.lit(variant) if isinstance(variant, str) else variant
    return [
        F.concat(pair_id, F.lit(id_sep), v).alias("id"),
        pair_id.alias("pair_id"),
        F.lit(task).alias("task"),
        split.alias("split"),
        v.alias("variant"),
        prompt.alias("input"),
        prompt.alias("prompt"),
        text_a.alias("text_a"),
        text_b.alias("text_b"),
        label.alias("label"),
        label.alias("target"),
        F.struct(
            pair_id.alias("pair_id"),
            F.lit(task).alias("task"),
            F.struct(F.lit(clean_lang).alias("clean"), F.lit(insert_lang).alias("insert")).alias("languages"),
            perturbation.alias("perturbation"),
        ).alias("metadata"),
    ]


def perturbed_pairs(
    pairs: DataFrame,
    seed=42,
    p_switch: float = DEFAULT_P_SWITCH,
    noise_p: float = DEFAULT_NOISE_P,
    **lexicon,
) -> DataFrame:
    """G5 on both fields of every source pair, one wide row per pair.

    ``pairs`` columns: ``pair_id, split, a_clean, a_insert, b_clean, b_insert,
    label`` (``b_*`` may be null: then field B is empty on both sides, as in the
    prototype builder). Adds ``a_pert``, ``b_pert`` and their ``*_meta``
    provenance structs; ``_b_ok`` tells whether field B was present. Field B's
    draws use their own field name, so A and B are independent streams.
    """
    df = pairs.withColumns({
        "b_clean": F.coalesce(F.col("b_clean"), F.lit("")),
        "_b_ok": F.col("b_clean").isNotNull() & F.col("b_insert").isNotNull(),
        "b_insert": F.coalesce(F.col("b_insert"), F.lit("")),
    })
    keys = [F.col("split"), F.col("pair_id")]
    df = with_perturbation(df, "a_clean", "a_insert", keys, "a", "a_pert", seed, p_switch, noise_p, **lexicon)
    df = with_perturbation(df, "b_clean", "b_insert", keys, "b", "b_pert", seed, p_switch, noise_p, **lexicon)
    return df.withColumn("b_pert", F.when(F.col("_b_ok"), F.col("b_pert")).otherwise(F.lit("")))


def prompt_pairs(perturbed: DataFrame, task: str, dataset: str) -> DataFrame:
    """The clean and perturbed prompt of each built pair side by side.

    This is what pairing the two emitted rows would give back, obtained
    without a shuffle because both twins come from the same source row; it
    feeds M2/A7 directly (and works unchanged on a stream).
    """
    prompt = tx.nli_prompt if task == "nli" else tx.qa_prompt
    return perturbed.select(
        F.lit(dataset).alias("dataset"), F.lit(task).alias("task"), "split", "pair_id",
        prompt(F.col("a_clean"), F.col("b_clean")).alias("clean_text"),
        prompt(F.col("a_pert"), F.col("b_pert")).alias("perturbed_text"),
    )


def build_examples(
    pairs: DataFrame,
    task: str,
    clean_lang: str = "fr",
    insert_lang: str = "en",
    seed=42,
    p_switch: float = DEFAULT_P_SWITCH,
    noise_p: float = DEFAULT_NOISE_P,
    variant_name: str = "perturbed",
    **lexicon,
) -> DataFrame:
    """G6/G7 (and G8 with ``variant_name='switchmix'``): two rows per source pair.

    For NLI, fields A/B are premise/hypothesis; for QA, context/question (see
    ``perturbed_pairs`` for the input columns). A two-element variant array is
    exploded and each column chosen by it: no shuffle, and a query that needs no
    perturbed column computes no perturbation.
    """
    df = perturbed_pairs(pairs, seed, p_switch, noise_p, **lexicon)
    prompt = tx.nli_prompt if task == "nli" else tx.qa_prompt
    none_meta = F.struct(
        F.lit("none").alias("type"),
        F.lit(None).cast(FIELD_META_TYPE).alias("a"),
        F.lit(None).cast(FIELD_META_TYPE).alias("b"),
        F.lit(None).cast(PARAMS_TYPE).alias("params"),
    )
    pert_meta = F.struct(
        F.lit("switchmix+informal_noise").alias("type"),
        F.col("a_pert_meta").alias("a"),
        F.when(F.col("_b_ok"), F.col("b_pert_meta")).alias("b"),
        F.struct(F.lit(float(p_switch)).alias("p_switch"), F.lit(float(noise_p)).alias("noise_p")).alias("params"),
    )
    df = df.withColumn("_variant", F.explode(F.array(F.lit("clean"), F.lit(variant_name))))
    is_clean = F.col("_variant") == F.lit("clean")

    def side(clean: Column, perturbed: Column) -> Column:
        return F.when(is_clean, clean).otherwise(perturbed)

    row = _example_columns(
        F.col("_variant"), F.col("pair_id"), task, F.col("split"),
        side(prompt(F.col("a_clean"), F.col("b_clean")), prompt(F.col("a_pert"), F.col("b_pert"))),
        side(F.col("a_clean"), F.col("a_pert")), side(F.col("b_clean"), F.col("b_pert")), F.col("label"), clean_lang, insert_lang,
        side(none_meta, pert_meta),
    )
    return df.select(*row)


def nli_pairs_from_zip(
    zipped: DataFrame,
    dataset: str,
    clean_lang: str,
    label_col: str = "b_label",
    id_col: str = "b_id",
) -> DataFrame:
    """G15 (NLI): zipped parallel rows -> builder input with pair ids and label names.

    Expects ``split, idx, b_premise, b_hypothesis, i_premise, i_hypothesis`` plus
    the base side's id and integer label.
    """
    return zipped.select(
        pair_id_fallback(id_col, dataset, clean_lang, "split", "idx").alias("pair_id"),
        F.col("split"),
        F.col("b_premise").alias("a_clean"),
        F.col("i_premise").alias("a_insert"),
        F.col("b_hypothesis").alias("b_clean"),
        F.col("i_hypothesis").alias("b_insert"),
        label_name(F.col(label_col)).alias("label"),
    )


def qa_pairs_from_zip(zipped: DataFrame, dataset: str, clean_lang: str, id_col: str = "b_id") -> DataFrame:
    """G15 (QA): zipped parallel rows -> builder input; the answer comes from the base side."""
    return zipped.select(
        pair_id_fallback(id_col, dataset, clean_lang, "split", "idx").alias("pair_id"),
        F.col("split"),
        F.col("b_context").alias("a_clean"),
        F.col("i_context").alias("a_insert"),
        F.col("b_question").alias("b_clean"),
        F.col("i_question").alias("b_insert"),
        F.col("b_answer").alias("label"),
    )


def legacy_frame_examples(raw: DataFrame, seed=42) -> DataFrame:
    """Legacy NLI set, two rows per raw example (French frame / English frame).

    ``raw``: ``id, premise, hypothesis, label`` (integer). The perturbed row keeps
    premise and hypothesis untouched and only changes the frame, adding one of
    seven discourse markers drawn per example. Ids end in ``_clean`` /
    ``_switchmix`` (one underscore), as in the legacy data.
    """
    lab = label_name(F.col("label"))
    marker = pick(tx.LEGACY_MARKERS, seed, "frame", F.col("id"))
    clean = F.struct(
        F.concat(F.col("id"), F.lit("_clean")).alias("id"), F.lit("nli").alias("task"),
        F.lit("test").alias("split"), F.lit("clean").alias("variant"),
        tx.legacy_clean_prompt(F.col("premise"), F.col("hypothesis")).alias("input"), lab.alias("label"),
    )
    mix = F.struct(
        F.concat(F.col("id"), F.lit("_switchmix")).alias("id"), F.lit("nli").alias("task"),
        F.lit("test").alias("split"), F.lit("switchmix").alias("variant"),
        tx.legacy_mix_prompt(F.col("premise"), F.col("hypothesis"), F.col("_marker")).alias("input"), lab.alias("label"),
    )
    return raw.withColumn("_marker", marker).select(F.inline(F.array(clean, mix)))


# ---------------------------------------------------------------------------
# Template generators (G11, G12). FIXED VALUES: word lists and sentence
# templates of the benchmark's synthetic tasks, stated as plain text.
# ---------------------------------------------------------------------------
SYN_NLI_LABELS = ["entailment", "neutral", "contradiction"]
SYN_NAMES = ["Marie", "Paul", "Aïcha", "Ibrahim", "Sofia", "Lucas", "Fatou", "Noah"]
SYN_CITIES = ["Paris", "Lyon", "Marseille", "Dakar", "Abidjan", "Montréal", "Bruxelles"]
SYN_ITEMS_FR = ["une voiture", "un livre", "un téléphone", "des pommes", "des bananes", "un vélo"]
SYN_ITEMS_EN = ["a car", "a book", "a phone", "apples", "bananas", "a bicycle"]
SYN_HOBBIES_FR = ["le sport", "la musique", "la lecture", "le cinéma", "la danse"]
SYN_HOBBIES_EN = ["sports", "music", "reading", "movies", "dancing"]
SYN_PLACES_FR = ["au marché", "à la bibliothèque", "au parc", "au restaurant"]
SYN_PLACES_EN = ["to the market", "to the library", "to the park", "to the restaurant"]
SYN_FRUITS_FR = ["des pommes", "des bananes", "des oranges"]
SYN_FRUITS_EN = ["apples", "bananas", "oranges"]


def _arr(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _at(values: Sequence[str], i: Column) -> Column:
    return F.element_at(_arr(values), i + 1)


def synthetic_nli(keys: DataFrame, key_col: str, seed=42, id_prefix: str = "syn_nli") -> DataFrame:
    """One templated NLI example per key row (label, name, city, item, hobby drawn by key).

    Output: ``pair_id, premise_fr, premise_en, hypothesis_fr, hypothesis_en, label``.
    """
    k = F.col(key_col)

    def draw_i(name: str, n: int) -> Column:
        return F.floor(u01(seed, id_prefix, k, name) * n).cast("int")

    df = keys.select(
        k.alias("_k"),
        _at(SYN_NLI_LABELS, draw_i("label", 3)).alias("label"),
        _at(SYN_NAMES, draw_i("name", len(SYN_NAMES))).alias("_name"),
        _at(SYN_CITIES, draw_i("city", len(SYN_CITIES))).alias("_city"),
        draw_i("item", len(SYN_ITEMS_FR)).alias("_item"),
        draw_i("hobby", len(SYN_HOBBIES_FR)).alias("_hobby"),
    )
    name, city = F.col("_name"), F.col("_city")
    item_fr, item_en = _at(SYN_ITEMS_FR, F.col("_item")), _at(SYN_ITEMS_EN, F.col("_item"))
    hob_fr, hob_en = _at(SYN_HOBBIES_FR, F.col("_hobby")), _at(SYN_HOBBIES_EN, F.col("_hobby"))
    lab = F.col("label")
    ent, con = lab == F.lit("entailment"), lab == F.lit("contradiction")

    def by_label(e: Column, c: Column, n: Column) -> Column:
        return F.when(ent, e).when(con, c).otherwise(n)

    return df.select(
        F.concat_ws("_", F.lit(id_prefix), F.lit(str(seed)), F.lpad(F.col("_k").cast("string"), 6, "0")).alias("pair_id"),
        by_label(F.concat(name, F.lit(" a acheté "), item_fr, F.lit(" hier.")),
                 F.concat(F.lit("Il pleut aujourd'hui à "), city, F.lit(".")),
                 F.concat(name, F.lit(" aime "), hob_fr, F.lit("."))).alias("premise_fr"),
        by_label(F.concat(name, F.lit(" bought "), item_en, F.lit(" yesterday.")),
                 F.concat(F.lit("It is raining today in "), city, F.lit(".")),
                 F.concat(name, F.lit(" likes "), hob_en, F.lit("."))).alias("premise_en"),
        by_label(F.concat(name, F.lit(" a acheté quelque chose.")),
                 F.concat(F.lit("Le temps est sec aujourd'hui à "), city, F.lit(".")),
                 F.concat(name, F.lit(" a acheté "), item_fr, F.lit("."))).alias("hypothesis_fr"),
        by_label(F.concat(name, F.lit(" bought something.")),
                 F.concat(F.lit("The weather is dry today in "), city, F.lit(".")),
                 F.concat(name, F.lit(" bought "), item_en, F.lit("."))).alias("hypothesis_en"),
        lab.alias("label"),
    )


def synthetic_qa(keys: DataFrame, key_col: str, seed=42, id_prefix: str = "syn_qa") -> DataFrame:
    """One templated QA example per key row; answer via T18.

    Output: ``pair_id, context_fr, context_en, question_fr, question_en, answer``.
    """
    k = F.col(key_col)

    def draw_i(name: str, n: int) -> Column:
        return F.floor(u01(seed, id_prefix, k, name) * n).cast("int")

    df = keys.select(
        k.alias("_k"),
        _at(SYN_NAMES, draw_i("name", len(SYN_NAMES))).alias("_name"),
        draw_i("place", len(SYN_PLACES_FR)).alias("_place"),
        draw_i("fruit", len(SYN_FRUITS_FR)).alias("_fruit"),
    )
    name = F.col("_name")
    fruit_fr = _at(SYN_FRUITS_FR, F.col("_fruit"))
    return df.select(
        F.concat_ws("_", F.lit(id_prefix), F.lit(str(seed)), F.lpad(F.col("_k").cast("string"), 6, "0")).alias("pair_id"),
        F.concat(name, F.lit(" est allé "), _at(SYN_PLACES_FR, F.col("_place")),
                 F.lit(" ce matin pour acheter des fruits. Il a choisi "), fruit_fr, F.lit(".")).alias("context_fr"),
        F.concat(name, F.lit(" went "), _at(SYN_PLACES_EN, F.col("_place")),
                 F.lit(" this morning to buy fruit. He chose "), _at(SYN_FRUITS_EN, F.col("_fruit")), F.lit(".")).alias("context_en"),
        F.concat(F.lit("Quels fruits "), name, F.lit(" a-t-il achetés ?")).alias("question_fr"),
        F.concat(F.lit("What fruits did "), name, F.lit(" buy?")).alias("question_en"),
        tx.fruit_answer(fruit_fr).alias("answer"),
    )


def build_from_parallel(
    base: DataFrame,
    insert: DataFrame,
    task: str,
    dataset: str,
    clean_lang: str = "fr",
    insert_lang: str = "en",
    quotas: Mapping[str, int] | None = None,
    seed=42,
    p_switch: float = DEFAULT_P_SWITCH,
    noise_p: float = DEFAULT_NOISE_P,
) -> DataFrame:
    """J5 -> (G14) -> G6/G7 in one plan.

    ``base``/``insert`` carry ``split, idx`` (see ``positions``) and the task
    fields: ``id, premise, hypothesis, label`` (integer) for NLI, ``id, context,
    question, answer`` for QA (the insert side needs only the two text fields).
    With ``quotas``, each split is sampled to its quota (keyed draws) after the
    zip; without, every aligned pair is built.
    """
    zipped = parallel_zip(base, insert, on=("split", "idx"))
    pairs = (nli_pairs_from_zip(zipped, dataset, clean_lang) if task == "nli"
             else qa_pairs_from_zip(zipped, dataset, clean_lang))
    if quotas:
        pairs = sample_per_split(pairs, quotas, "pair_id", seed=seed)
    return build_examples(pairs, task, clean_lang, insert_lang, seed=seed, p_switch=p_switch, noise_p=noise_p)
