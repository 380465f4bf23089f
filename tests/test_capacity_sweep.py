import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairshift.operators import sweep
from pairshift.sources import tables as tb

SF = "/root/testdata/sf0.001"
SCHEMA = "task string, split string, variant string, input string, prompt string, text_a string, text_b string, label string"
LABELS = ["entailment", "neutral", "contradiction"]


def _rows():
    """Small rows with their own words per label, copies, nulls and skipped labels."""
    words = [["oui", "bien", "vrai"], ["peut", "etre", "selon"], ["non", "faux", "jamais"]]
    out = []
    for i in range(60):
        y = i % 3
        a, b = f"{words[y][i % 3]} le chat {i % 7}", f"{words[(y + (i % 5 == 0)) % 3][(i + 1) % 3]} mot{i % 11} le"
        out.append(("nli", "train" if i % 4 else "test", "clean" if i % 4 or i % 8 else "perturbed", None, None, a, b, LABELS[y]))
    out += [out[1]] * 5 + [("nli", "train", "clean", None, None, "a", "b", "?"), ("nli", "test", "perturbed", None, None, None, "b", "neutral"),
                           ("qa", "train", "clean", None, None, "a", "b", "neutral"), ("nli", "train", "clean", None, None, "!", "?", "neutral"),
                           ("nli", "dev", "clean", None, None, "a", "b", "neutral"), ("nli", None, None, None, None, "a", "b", None)]
    return out


def _plain(rows, bucket_of, cap, steps, reg):
    """Dictionary and numpy version: weights by bucket, accuracies by side."""
    def feats(r):
        toks = [t for x in (r[5], r[6]) for t in re.findall(r"\w+|[^\w\s]", x.lower())]
        return Counter(bucket_of[t] % cap for t in toks)

    good = [r for r in rows if r[0] == "nli" and r[5] and r[6] and r[7] in LABELS]
    train = [(feats(r), LABELS.index(r[7])) for r in good if r[1] == "train" and r[2] == "clean"]
    df = Counter(b for f, _ in train for b in f)
    idf = lambda b: np.log((len(train) + 1) / (df[b] + 1))

    def vector(f):
        x = np.zeros(cap + 1)
        for b, n in f.items():
            x[b] = n * idf(b)
        x /= np.linalg.norm(x) or 1.0
        x[cap] = 1.0
        return x

    x, y = np.array([vector(f) for f, _ in train]), np.eye(3)[[c for _, c in train]]
    w = p = np.zeros((cap + 1, 3))
    shrink = np.full((cap + 1, 1), reg)
    shrink[cap] = 0.0
    for t in range(steps):
        a = w + t / (t + 3.0) * (w - p)
        z = np.exp(x @ a - (x @ a).max(axis=1, keepdims=True))
        g = x.T @ (z / z.sum(axis=1, keepdims=True) - y) / len(train) + shrink * a
        p, w = w, a - g / (1.0 + reg)
    acc = {}
    for side in ("clean", "perturbed"):
        hits = [int(np.argmax(vector(feats(r)) @ w)) == LABELS.index(r[7]) for r in good if r[1] == "test" and r[2] == side]
        acc[side] = float(np.mean(hits)) if hits else 0.0
    return w, acc, g


def test_weights_and_accuracies_equal_a_plain_solver(spark):
    rows, caps = _rows(), (8, 12, 64)  # 12 is no multiple of 8: both fold from 192
    ex = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    toks = sorted({t for r in rows for x in (r[5], r[6]) if x for t in re.findall(r"\w+|[^\w\s]", x.lower())})
    bucket_of = {r.t: r.b for r in spark.createDataFrame([(t,) for t in toks], "t string").selectExpr("t", "pmod(xxhash64(t), 192) AS b").collect()}
    features = sweep.sweep_features(ex, caps)
    got = sweep.fit_weights(features, caps, max_iter=6).collect()
    table = {int(r.model.split("_")[1]): r for r in sweep.capacity_sweep(ex, caps, max_iter=6).collect()}
    assert set(table) == set(caps)
    for cap in caps:
        w, acc, _ = _plain(rows, bucket_of, cap, 6, 0.01)
        found = np.zeros((cap + 1, 3))
        for r in got:
            if r.capacity == cap:
                found[r.bucket] = [r.w0, r.w1, r.w2]  # bucket -1 is the last row
        assert np.allclose(found, w, atol=1e-12)
        assert table[cap].clean_accuracy == pytest.approx(acc["clean"]) and table[cap].perturbed_accuracy == pytest.approx(acc["perturbed"])
        assert table[cap].train_time_s > 0 and table[cap].n_train == 51 and table[cap].train_skipped == 1 and table[cap].test_perturbed_skipped == 1


def test_steps_reach_the_optimum():
    """The step size and momentum converge: the gradient of the plain version, which equals Spark's, vanishes."""
    rows = _rows()
    bucket_of = {t: i for i, t in enumerate(sorted({t for r in rows for x in (r[5], r[6]) if x for t in re.findall(r"\w+|[^\w\s]", x.lower())}))}
    assert np.abs(_plain(rows, bucket_of, 64, 2000, 0.01)[2]).max() < 1e-6


def test_buckets_grow_with_the_features(spark, monkeypatch):
    ex = spark.createDataFrame(_rows(), SCHEMA)
    few = sweep.sweep_features(ex, (8, 64))
    monkeypatch.setattr(sweep, "BUCKET_FEATURES", 30)
    many = sweep.sweep_features(ex, (8, 64))
    names = ["sweep_" + re.search(r"pairshift-sweep-(\w+)/", df.inputFiles()[0]).group(1) for df in (few, many)]
    buckets = [int(spark.sql(f"DESCRIBE EXTENDED {n}").where("col_name = 'Num Buckets'").first().data_type) for n in names]
    assert buckets[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) and buckets[1] > 3 * buckets[0]
    rounded = [df.withColumn("x", F.round("x", 9)) for df in (few, many)]
    assert few.count() == many.count() and rounded[0].exceptAll(rounded[1]).count() == 0
    assert few.where("bucket = -1 AND capacity = 8").agg(F.sum("n")).first()[0] == few.where("bucket = -1 AND capacity = 64").agg(F.sum("n")).first()[0]


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], SCHEMA)
    r = sweep.capacity_sweep(none, (4,), max_iter=2).collect()
    assert len(r) == 1 and r[0].n_train == 0 and r[0].clean_accuracy == 0.0
    only = spark.createDataFrame([("nli", "test", "clean", None, None, "a", "b", lab) for lab in LABELS[:2]], SCHEMA)
    assert sweep.capacity_sweep(only, (4,), max_iter=2).first().clean_accuracy == 0.5  # class 0 for all
    with pytest.raises(ValueError):
        sweep.sweep_features(none, (0, 4))


def test_one_tokenization_no_exchange_of_features(spark):
    ex = tb.nli_examples(spark, SF)
    features = sweep.sweep_features(ex, (16, 64))
    plan = sweep.fit_weights(features, (16, 64), max_iter=3)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "xxhash64" not in plan  # the texts are not read again
    assert not re.search(r"hashpartitioning\(key", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan
    out = sweep.capacity_sweep(ex, (16, 64)).collect()
    assert len(out) == 2 and all(0 <= r.clean_accuracy <= 1 and 0 <= r.perturbed_accuracy <= 1 and r.n_train > 0 for r in out)
