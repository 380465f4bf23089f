"""Capacity sweep (X4): one hashed bag-of-tokens classifier per capacity, trained on clean rows, tested on both sides.

The fine-tuned encoders of the original are replaced by TF-IDF over hashed tokens and multinomial logistic
regression; the capacity is the number of hash buckets.

* **Features.** Tokens are hashed once, to the least common multiple of all capacities; a smaller capacity folds
  these bucket numbers (``b mod c``), so texts are read and tokenized once whatever the number of capacities. Equal
  rows become one with a weight. The features of a row have length 1, and bucket -1 with value 1 is the intercept.
  The distinct rows are written first, as their joined tokens; their size gives the number of buckets. The features
  are written once, bucketed by row, so a step finds all features of a row in one task.
* **Steps.** Accelerated gradient descent on the mean log loss plus ``reg_param / 2`` times the squared weights
  (intercepts free). A step joins the features with the weights, sums the scores of each (row, capacity) inside the
  bucket, and adds the gradients of all capacities in one aggregation by (capacity, bucket), whose exchange carries
  one row per bucket and task. The weights are rows of a DataFrame, so all steps are one lazy plan; only the rows
  and features are written while it is built.

Rows of one length bound the curvature, so the step size is a constant: the softmax has second derivatives of at
most 1/2, and a row with its intercept has squared length 2.

Edge cases: no training rows give zero weights (all rows get class 0); no test rows on a side give accuracy 0; rows
without tokens have the intercept only; null or unknown labels, and empty fields, are counted as skipped; texts of any
length are read whole unless ``max_tokens`` cuts their token lists; ties between classes go to the smallest label id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.operators.scoring import nli_validity
from pairshift.session import materialize, shared_path

COUNTS = ("n_train", "n_test_clean", "n_test_perturbed", "train_skipped", "test_clean_skipped", "test_perturbed_skipped")
CAPACITIES = (2 ** 8, 2 ** 10, 2 ** 12)
CLASSES = (0, 1, 2)
INTERCEPT = -1
BROADCAST_BUCKETS = 1 << 20  # weights of more buckets than this (about 64 MB) are joined by shuffle
BUCKET_FEATURES = 1 << 20  # features that a task holds, at most (a row is never split); the number of buckets grows with the input


def _rows(examples: DataFrame) -> DataFrame:
    """The NLI rows of a sweep: split, side, validity, label id and lower-cased tokens of both fields."""
    prem, hyp = tx.prompt_fields()
    v = nli_validity(examples.where(F.col("task") == "nli"))
    return v.select(
        "split", F.when(F.col("variant") == "clean", "clean").when(F.col("variant").isin("perturbed", "switchmix"), "perturbed").alias("side"),
        F.col("_valid").alias("valid"), F.col("_label_id").alias("y"),
        F.concat(tx.simple_tokenize(F.lower(prem)), tx.simple_tokenize(F.lower(hyp))).alias("tokens"))


def sweep_plan(examples: DataFrame, capacities: Sequence[int] = CAPACITIES, train_split: str = "train", test_split: str = "test") -> DataFrame:
    """X4 without the fitting: per capacity, the rows that train and test, the rows skipped and the parameter count."""
    rows = _rows(examples)
    picks = [("clean", train_split, True), ("clean", test_split, True), ("perturbed", test_split, True),
             ("clean", train_split, False), ("clean", test_split, False), ("perturbed", test_split, False)]
    counts = rows.agg(*[F.count(F.when((F.col("side") == side) & (F.col("split") == split) & (F.col("valid") == ok), 1)).cast("long").alias(name)
                        for name, (side, split, ok) in zip(COUNTS, picks)])
    sizes = F.explode(F.array(*[F.lit(int(c)) for c in capacities])).alias("capacity")
    return counts.select(sizes, *COUNTS).withColumn("n_parameters", (3 * F.col("capacity") + 3).cast("long"))


def sweep_features(examples: DataFrame, capacities: Sequence[int] = CAPACITIES, train_split: str = "train", test_split: str = "test",
                   max_tokens: int | None = None) -> DataFrame:
    """Features of all capacities: ``key, trains, test_side, y, n, capacity, bucket, x``.

    One line per distinct row, capacity and bucket; ``n`` is how often the row occurs. Inverse document frequencies
    (``ln((rows + 1) / (rows with the bucket + 1))``) come from the training rows.
    """
    caps = sorted({int(c) for c in capacities})
    widest = math.lcm(*caps)
    if caps[0] < 1 or widest >= 2 ** 62:
        raise ValueError(f"capacities need a common multiple below 2^62: {caps}")
    tokens = F.col("tokens") if max_tokens is None else F.slice("tokens", 1, max_tokens)
    rows = _rows(examples).where("valid AND side IS NOT NULL").select(
        ((F.col("split") == train_split) & (F.col("side") == "clean")).alias("trains"),
        F.when(F.col("split") == test_split, F.col("side")).alias("test_side"), "y", F.array_join(tokens, " ").alias("words")).where("trains OR test_side IS NOT NULL")
    row = ["key", "trains", "test_side", "y"]
    keyed = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(
        "\n", F.col("trains").cast("string"), F.coalesce("test_side", F.lit("")), F.col("y").cast("string"), "words"))))
    spark = examples.sparkSession
    distinct = materialize(keyed.groupBy(*row).agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words")), "sweep-rows")
    tokens = F.filter(F.split("words", " "), lambda t: t != "")
    sizes = distinct.agg(F.sum(F.size(tokens) + 1).alias("features"), F.sum(F.when(F.col("trains"), F.col("n"))).alias("total")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.features or 0) * len(caps) // BUCKET_FEATURES))
    wide = F.explode(F.concat(F.array(F.lit(INTERCEPT).cast("long")), F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(widest))))).alias("wide")
    folded = F.when(F.col("wide") == INTERCEPT, F.col("wide")).otherwise(F.pmod(F.col("wide"), F.col("capacity")))
    tf = (
        distinct.repartition(parts, "key").select(*row, "n", wide)
        .withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in caps])))
        .groupBy(*row, "n", "capacity", folded.alias("bucket")).agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.where("trains").groupBy("capacity", "bucket").agg(F.sum("n").alias("df"))
    weighed = tf.join(_sized(df, caps), ["capacity", "bucket"], "left")
    idf = F.log(F.lit((sizes.total or 0) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    value = F.when(F.col("bucket") == INTERCEPT, F.lit(0.0)).otherwise(F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("key", "capacity")))
    out = weighed.withColumn("idf", idf).withColumn("v", value).withColumn("length", length).select(
        *row, "n", "capacity", "bucket",
        F.when(F.col("bucket") == INTERCEPT, F.lit(1.0)).when(F.col("length") > 0, F.col("v") / F.col("length")).otherwise(F.lit(0.0)).alias("x"))
    path = shared_path(spark, "sweep")
    name = "sweep_" + path.rsplit("-", 1)[1]
    out.repartition(parts, "key").write.option("path", path).bucketBy(parts, "key").sortBy("key", "capacity").saveAsTable(name)
    return spark.table(name)


def _held(df: DataFrame) -> DataFrame:
    """Adds ``rows``, the number of training rows: the count of a capacity's intercept (a window holds one capacity's buckets)."""
    return df.withColumn("rows", F.max(F.when(F.col("bucket") == INTERCEPT, F.col("df"))).over(Window.partitionBy("capacity")))


def _sized(weights: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """Broadcast weights whose number of rows, known from the capacities, is small."""
    return F.broadcast(weights) if sum(capacities) + len(capacities) <= BROADCAST_BUCKETS else weights


def _clock() -> Column:
    return F.java_method(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long")


def fit_weights(features: DataFrame, capacities: Sequence[int] = CAPACITIES, max_iter: int = 25, reg_param: float = 0.01) -> DataFrame:
    """Weights after ``max_iter`` accelerated steps: ``capacity, bucket, w0, w1, w2`` and ``started`` (clock, ms)."""
    trains = features.where("trains")
    zero = [F.lit(0.0).alias(f"{p}{k}") for p in "wp" for k in CLASSES]
    state = _held(trains.groupBy("capacity", "bucket").agg(F.sum("n").alias("df"))).select(
        "capacity", "bucket", F.col("rows").cast("double").alias("rows"), _clock().alias("started"), *zero)
    for t in range(max_iter):
        state = _step(trains, state, t / (t + 3.0), reg_param, capacities)
    return state.select("capacity", "bucket", *[f"w{k}" for k in CLASSES], "started")


def _step(trains: DataFrame, state: DataFrame, momentum: float, reg: float, capacities: Sequence[int]) -> DataFrame:
    ahead = state.select("capacity", "bucket", "rows", "started", *[f"w{k}" for k in CLASSES],
                         *[(F.col(f"w{k}") + momentum * (F.col(f"w{k}") - F.col(f"p{k}"))).alias(f"a{k}") for k in CLASSES])
    row = Window.partitionBy("key", "capacity")
    scored = trains.join(_sized(ahead, capacities), ["capacity", "bucket"]).withColumns(
        {f"m{k}": F.sum(F.col(f"a{k}") * F.col("x")).over(row) for k in CLASSES})
    scored = scored.withColumn("top", F.greatest(*[f"m{k}" for k in CLASSES]))
    odds = [F.exp(F.col(f"m{k}") - F.col("top")) for k in CLASSES]
    errors = scored.withColumns({f"r{k}": odds[k] / (odds[0] + odds[1] + odds[2]) - (F.col("y") == k).cast("double") for k in CLASSES})
    same = [F.max(c).alias(c) for c in ("rows", "started", *[f"{p}{k}" for p in "wa" for k in CLASSES])]  # equal in a group
    grads = errors.groupBy("capacity", "bucket").agg(*same, *[F.sum(F.col("n") * F.col("x") * F.col(f"r{k}")).alias(f"g{k}") for k in CLASSES])
    shrink = F.when(F.col("bucket") == INTERCEPT, F.lit(0.0)).otherwise(F.lit(float(reg)))
    moved = [(F.col(f"a{k}") - (F.col(f"g{k}") / F.col("rows") + shrink * F.col(f"a{k}")) / (1.0 + reg)).alias(f"w{k}") for k in CLASSES]
    return grads.select("capacity", "bucket", "rows", "started", *moved, *[F.col(f"w{k}").alias(f"p{k}") for k in CLASSES])


def sweep_accuracy(features: DataFrame, weights: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """Per capacity and test side: accuracy over all test rows, and the seconds from the first step to the last."""
    tests = features.where("test_side IS NOT NULL")
    ended = weights.select("*", (_clock() - F.col("started")).alias("ms")).drop("started")
    scores = tests.join(_sized(ended, capacities), ["capacity", "bucket"], "left").groupBy("key", "capacity", "test_side", "y", "n").agg(
        F.max("ms").alias("ms"), *[F.sum(F.coalesce(f"w{k}", F.lit(0.0)) * F.col("x")).alias(f"m{k}") for k in CLASSES])
    predicted = F.array_position(F.array(*[f"m{k}" for k in CLASSES]), F.greatest(*[f"m{k}" for k in CLASSES])) - 1
    hit = F.when(predicted == F.col("y"), F.col("n")).otherwise(F.lit(0))
    return scores.groupBy("capacity", "test_side").agg((F.sum(hit) / F.sum("n")).alias("accuracy"), (F.max("ms") / 1000.0).alias("seconds"))


def capacity_sweep(
    examples: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    seed: int = 42,
    train_split: str = "train",
    test_split: str = "test",
    max_iter: int = 25,
    reg_param: float = 0.01,
    max_tokens: int | None = None,
) -> DataFrame:
    """Train a classifier per capacity on clean training rows, score clean vs perturbed test rows.

    Output follows the scaling table (A16), one row per capacity; ``estimated_model_size`` is the parameter count in
    millions, ``train_time_s`` the time of the joint fit of all capacities. ``max_tokens`` (none by default) cuts a
    row's token list, as the encoders' ``max_length`` did. The features are written under the checkpoint folder;
    ``session.cleanup_materialized`` removes them.
    """
    features = sweep_features(examples, capacities, train_split, test_split, max_tokens)
    result = sweep_accuracy(features, fit_weights(features, capacities, max_iter, reg_param), capacities)
    side = {s: F.max(F.when(F.col("test_side") == s, F.col("accuracy"))).alias(s) for s in ("clean", "perturbed")}
    by_capacity = result.groupBy("capacity").agg(*side.values(), F.max("seconds").alias("train_time_s"))
    name = F.concat(F.lit("tfidf_"), F.col("capacity").cast("string"), F.lit("_logreg"))
    clean, perturbed = F.coalesce("clean", F.lit(0.0)), F.coalesce("perturbed", F.lit(0.0))
    return sweep_plan(examples, capacities, train_split, test_split).join(by_capacity, "capacity", "left").select(
        F.lit("nli").alias("task"), name.alias("model"), F.lit(int(seed)).alias("seed"), F.lit(train_split).alias("train_split"),
        F.lit(test_split).alias("test_split"), *COUNTS, clean.alias("clean_accuracy"), perturbed.alias("perturbed_accuracy"),
        (clean - perturbed).alias("robustness_gap_delta"), F.lit(float(max_iter)).alias("epochs"), "train_time_s", name.alias("model_name"),
        (F.col("n_parameters") / 1e6).alias("estimated_model_size"), perturbed.alias("switchmix_accuracy"), (clean - perturbed).alias("robustness_drop"),
        # training columns of the original; a full-batch solver has neither a learning rate nor a batch size
        F.lit(None).cast("double").alias("lr"), F.lit(None).cast("long").alias("batch_size"), F.lit(max_tokens).cast("long").alias("max_length"),
        F.lit(float(reg_param)).alias("reg_param"))
