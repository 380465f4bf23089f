"""Readers for the driver's Parquet tables and the adapters that turn them into engine inputs.

Adapters only reshape rows into the schemas the operators expect (parallel
corpora, examples, predictions, vectors); all the work a query names runs in
the operators. Every adapter scans whole tables: language and role filters
select rows of the right *kind* and are pushed into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.functions.draws import u01
from pairshift.operators import build
from pairshift.operators.index import with_dense_index

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SEED = 42
NLI_LABELS = ("entailment", "neutral", "contradiction")
# Model names used by the prediction adapter: one the size lookup knows, one it does not.
ADAPTER_MODELS = ("google/flan-t5-small", "acme/unknown-model")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """Scan one driver table.

    A table stored as fewer files than the cluster has task slots would be processed by few tasks, and text work is
    long per byte; ``spread`` deals its rows round-robin over at least ``defaultParallelism`` partitions. The rule looks
    at the number of scan partitions only. Filters and column pruning still reach the scan below the exchange.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots)
    return df


def _halves(df: DataFrame, text_col: str, first: str, second: str) -> DataFrame:
    """Split a whole text into its first and second half of whitespace tokens."""
    df = df.withColumn("_tok", tx.ws_tokens(F.col(text_col)))
    n = F.size(F.col("_tok"))
    h = F.floor((n + 1) / 2).cast("int")
    return df.withColumns({
        first: F.array_join(F.slice(F.col("_tok"), F.lit(1), h), " "),
        second: F.array_join(F.slice(F.col("_tok"), h + 1, n - h), " "),
    }).drop("_tok")


def corpus_keys(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """``doc_id`` of the documents of one language with ``idx`` = 0-based position by ``doc_id`` (no text is read)."""
    keys = read_table(spark, sf_dir, "documents", spread=False).where(F.col("lang") == F.lit(lang)).select("doc_id")
    return with_dense_index(keys, ["doc_id"])


def corpus_texts(spark: SparkSession, sf_dir: str, lang: str, first: str, second: str) -> DataFrame:
    """Documents of one language, each text as its two halves."""
    docs = read_table(spark, sf_dir, "documents").where(F.col("lang") == F.lit(lang)).select("doc_id", "text")
    return _halves(docs, "text", first, second).drop("text")


def _zip_texts(base: DataFrame, insert: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """J5 keys first: ``aligned`` maps the base ``keys`` to ``idx`` and the insert's ``i_key``.

    The narrow map fetches the insert texts, and the result meets the base texts on their own keys, so the base
    texts move once. Columns come out as from ``build.parallel_zip``.
    """
    ins = insert.select(F.col("doc_id").alias("i_key"), F.col("doc_id").cast("string").alias("i_id"),
                        *[F.col(c).alias("i_" + c) for c in insert.columns if c != "doc_id"])
    found = aligned.join(ins, on="i_key").drop("i_key")
    return base.join(found, on=keys)


def nli_source(spark: SparkSession, sf_dir: str, clean_lang: str = "fr", insert_lang: str = "en") -> DataFrame:
    """J5 over two NLI-shaped corpora (premise/hypothesis are the two halves of each document); the split and the
    label come from the base side."""
    aligned = corpus_keys(spark, sf_dir, clean_lang).join(
        corpus_keys(spark, sf_dir, insert_lang).withColumnRenamed("doc_id", "i_key"), on="idx")
    base = corpus_texts(spark, sf_dir, clean_lang, "b_premise", "b_hypothesis").select(
        "doc_id", F.col("doc_id").cast("string").alias("b_id"), "b_premise", "b_hypothesis",
        (F.col("doc_id") % 4).cast("int").alias("b_label"),
        F.when(F.col("doc_id") % 5 < 4, F.lit("train")).otherwise(F.lit("test")).alias("split"))
    insert = corpus_texts(spark, sf_dir, insert_lang, "premise", "hypothesis")
    return _zip_texts(base, insert, aligned, ["doc_id"]).drop("doc_id")


def nli_pairs(spark: SparkSession, sf_dir: str, clean_lang: str = "fr", insert_lang: str = "en") -> DataFrame:
    dataset = f"docs_{clean_lang}-{insert_lang}"
    return build.nli_pairs_from_zip(nli_source(spark, sf_dir, clean_lang, insert_lang), dataset, clean_lang)


def nli_examples(spark: SparkSession, sf_dir: str, clean_lang: str = "fr", insert_lang: str = "en", seed=SEED) -> DataFrame:
    """Two example rows per French/insert document pair (G15 -> G6)."""
    pairs = nli_pairs(spark, sf_dir, clean_lang, insert_lang)
    return build.build_examples(pairs, "nli", clean_lang, insert_lang, seed=seed)


def qa_turns(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """A user turn directly followed by an assistant turn of the same conversation.

    The self-join is on the full key ``(conv_id, turn)``, so a very long
    conversation is spread over many tasks instead of landing in one window.
    """
    conv = read_table(spark, sf_dir, "conversations", spread=spread)
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context")
    )
    qa = u.join(a, on=["conv_id", "turn"], how="inner")
    return qa.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "context", "question",
        F.col("context").alias("answer"),
        F.when(F.col("conv_id") % 5 < 4, F.lit("train")).otherwise(F.lit("test")).alias("split"),
    )


def qa_source(spark: SparkSession, sf_dir: str, insert_lang: str = "en") -> DataFrame:
    """QA turns zipped by position (order ``conv_id, turn``) with an insert-language corpus."""
    keys = with_dense_index(qa_turns(spark, sf_dir, spread=False).select("conv_id", "turn"), ["conv_id", "turn"])
    aligned = keys.join(corpus_keys(spark, sf_dir, insert_lang).withColumnRenamed("doc_id", "i_key"), on="idx")
    turns = qa_turns(spark, sf_dir).select(
        "conv_id", "turn", "split", *[F.col(c).alias("b_" + c) for c in ("id", "context", "question", "answer")])
    insert = corpus_texts(spark, sf_dir, insert_lang, "context", "question")
    return _zip_texts(turns, insert, aligned, ["conv_id", "turn"]).drop("conv_id", "turn")


def qa_examples(spark: SparkSession, sf_dir: str, insert_lang: str = "en", seed=SEED) -> DataFrame:
    pairs = build.qa_pairs_from_zip(qa_source(spark, sf_dir, insert_lang), f"conv_fr-{insert_lang}", "fr")
    return build.build_examples(pairs, "qa", "fr", insert_lang, seed=seed)


def damaged_examples(examples: DataFrame) -> DataFrame:
    """Examples of which a deterministic few are orphaned, duplicated, keyless or renamed; no row is lost.

    ``r = md5 draw of id`` in twentieths: 0 a variant that no pairing knows (its pair stays incomplete),
    1 duplicate, 2 null pair_id, 3 legacy variant name ``switchmix`` on perturbed rows.
    """
    r = F.floor(u01(SEED, "damage", F.col("id")) * 20).cast("int")
    df = examples.withColumn("_r", r)
    df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_r") == 1, F.lit(2)).otherwise(F.lit(1)))))
    renamed = F.when(F.col("_r") == 0, F.lit("draft")).when((F.col("_r") == 3) & (F.col("variant") == "perturbed"), F.lit("switchmix"))
    return df.withColumns({
        "pair_id": F.when(F.col("_r") == 2, F.lit(None).cast("string")).otherwise(F.col("pair_id")),
        "variant": renamed.otherwise(F.col("variant")),
    }).drop("_r", "_copy")


def nli_predictions(examples: DataFrame, models=ADAPTER_MODELS, seed=SEED) -> DataFrame:
    """Every example answered by each model, as free text.

    The predicted label is correct with probability 0.62 on clean rows and 0.41
    otherwise; the answer is then worded in one of six styles, including verb
    forms, upper case, a distractor phrase and an empty output.
    """
    m = F.explode(F.array(*[F.lit(x) for x in models])).alias("model")
    df = examples.select("*", m)
    labs = F.array(*[F.lit(x) for x in NLI_LABELS])
    gold = F.coalesce(F.array_position(labs, F.col("label")).cast("int") - 1, F.lit(0))
    hit = u01(seed, "pred", F.col("model"), F.col("id")) < F.when(F.col("variant") == "clean", F.lit(0.62)).otherwise(F.lit(0.41))
    shift = 1 + F.floor(u01(seed, "wrong", F.col("model"), F.col("id")) * 2).cast("int")
    chosen = F.element_at(labs, F.when(hit, gold).otherwise((gold + shift) % 3) + 1)
    other = F.element_at(labs, ((gold + 1) % 3) + 1)
    style = F.floor(u01(seed, "style", F.col("model"), F.col("id")) * 6).cast("int")
    df = df.withColumns({"_l": chosen, "_o": other, "_s": style})
    verb = (
        F.when(F.col("_l") == "entailment", F.lit("It entails the premise."))
        .when(F.col("_l") == "contradiction", F.lit("The hypothesis contradicts it."))
        .otherwise(F.lit("Neutral, I think."))
    )
    text = (
        F.when(F.col("_s") == 0, F.col("_l"))
        .when(F.col("_s") == 1, F.concat(F.lit("The answer is "), F.initcap(F.col("_l")), F.lit(".")))
        .when(F.col("_s") == 2, verb)
        .when(F.col("_s") == 3, F.concat(F.lit("Label: "), F.upper(F.col("_l"))))
        .when(F.col("_s") == 4, F.lit(""))
        .otherwise(F.concat(F.lit("not "), F.col("_o"), F.lit(" but "), F.col("_l")))
    )
    return df.withColumn("prediction", text).drop("_l", "_o", "_s")


def qa_predictions(examples: DataFrame, models=ADAPTER_MODELS, seed=SEED) -> DataFrame:
    """Every QA example answered by each model: the gold answer with one token
    dropped, repeated or added (or left intact), chosen by keyed draws."""
    m = F.explode(F.array(*[F.lit(x) for x in models])).alias("model")
    df = examples.select("*", m)
    toks = tx.ws_tokens(F.col("label"))
    df = df.withColumn("_t", toks)
    n = F.size(F.col("_t"))
    op = F.floor(u01(seed, "qa_op", F.col("model"), F.col("id")) * 4).cast("int")
    j = (F.floor(u01(seed, "qa_pos", F.col("model"), F.col("id")) * F.greatest(n, F.lit(1))) + 1).cast("int")
    df = df.withColumns({"_op": op, "_j": j})
    dropped = F.concat(F.slice(F.col("_t"), F.lit(1), F.col("_j") - 1), F.slice(F.col("_t"), F.col("_j") + 1, F.greatest(n, F.lit(1))))
    repeated = F.concat(F.slice(F.col("_t"), F.lit(1), F.col("_j")), F.slice(F.col("_t"), F.col("_j"), F.greatest(n, F.lit(1))))
    added = F.concat(F.col("_t"), F.array(F.lit("extra")))
    pred = (
        F.when(F.col("_op") == 1, dropped)
        .when(F.col("_op") == 2, repeated)
        .when(F.col("_op") == 3, added)
        .otherwise(F.col("_t"))
    )
    return df.withColumn("prediction", F.array_join(pred, " ")).drop("_t", "_op", "_j")


def logits_table(examples: DataFrame, models=ADAPTER_MODELS, seed=SEED) -> DataFrame:
    """Three-way logits per (example, model): md5 draws rounded to one decimal, so
    ties occur and the first maximum must win."""
    m = F.explode(F.array(*[F.lit(x) for x in models])).alias("model")
    df = examples.select("*", m)
    lg = F.array(*[F.floor(u01(seed, "logit", F.col("model"), F.col("id"), k) * 10 + 0.5) / 10 for k in range(3)])
    return df.withColumn("logits", lg)


def vectors(spark: SparkSession, sf_dir: str, layers: int = 8) -> DataFrame:
    """``embeddings`` as paired layer vectors: ``pair_id = vec_id div 2``, even = clean.

    The 64 dimensions are read as ``layers`` blocks; the clean vector of layer 0
    is zeroed for a deterministic few pairs (draw < 0.02) to exercise the
    zero-norm rule.
    """
    e = read_table(spark, sf_dir, "embeddings")
    df = e.select(
        (F.col("vec_id") / 2).cast("long").alias("pair_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("clean")).otherwise(F.lit("perturbed")).alias("variant"),
        F.col("embedding"),
    )
    width = F.floor(F.size("embedding") / layers).cast("int")
    df = df.select(
        "pair_id", "variant", F.posexplode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("_p", "layer"), "embedding", width.alias("_w")
    )
    vec = F.transform(F.slice(F.col("embedding"), F.col("layer") * F.col("_w") + 1, F.col("_w")), lambda x: x.cast("double"))
    zero = (F.col("layer") == 0) & (F.col("variant") == "clean") & (u01(SEED, "zero", F.col("pair_id")) < 0.02)
    vec = F.when(zero, F.transform(vec, lambda x: F.lit(0.0))).otherwise(vec)
    return df.select(
        F.lit("embeddings").alias("dataset"),
        F.lit("nli").alias("task"),
        F.when(F.col("pair_id") % 5 < 4, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        "pair_id", "variant", F.col("layer").cast("int").alias("layer"), vec.alias("vector"),
    )


def token_vectors(spark: SparkSession, sf_dir: str, positions: int = 8) -> DataFrame:
    """``embeddings`` re-read as ``positions`` token vectors per row with an attention mask.

    Position 0 is always attended; other positions are masked out by a keyed
    draw (~30%), and every position of pair 3 is masked to exercise the
    floor-at-one denominator.
    """
    e = read_table(spark, sf_dir, "embeddings")
    df = e.select(
        (F.col("vec_id") / 2).cast("long").alias("pair_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("clean")).otherwise(F.lit("perturbed")).alias("variant"),
        F.col("embedding"),
        F.floor(F.size("embedding") / positions).cast("int").alias("_w"),
        F.posexplode(F.sequence(F.lit(0), F.lit(positions - 1))).alias("_p", "pos"),
    )
    keep = (F.col("pos") == 0) | (u01(SEED, "mask", F.col("pair_id"), F.col("variant"), F.col("pos")) >= 0.3)
    mask = F.when((F.col("pair_id") == 3), F.lit(0)).when(keep, F.lit(1)).otherwise(F.lit(0))
    return df.select(
        F.lit("embeddings").alias("dataset"), F.lit("nli").alias("task"),
        F.when(F.col("pair_id") % 5 < 4, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        "pair_id", "variant", F.col("pos").cast("int").alias("pos"),
        F.transform(F.slice(F.col("embedding"), F.col("pos") * F.col("_w") + 1, F.col("_w")), lambda x: x.cast("double")).alias("vector"),
        mask.cast("int").alias("mask"),
    )


def legacy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw NLI slice (``id, premise, hypothesis, label``) from French documents."""
    fr = read_table(spark, sf_dir, "documents").where(F.col("lang") == "fr").select("doc_id", "text")
    c = _halves(fr, "text", "premise", "hypothesis")
    return c.select(
        F.concat(F.lit("docs_fr_"), F.col("doc_id").cast("string")).alias("id"), "premise", "hypothesis",
        (F.col("doc_id") % 4).cast("int").alias("label"),
    )


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)
