"""Readers/writers, the streaming builder, and the model hooks."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.operators import build, ml
from pairshift.operators import tokens as tk
from pairshift.sources import io
from pairshift.sources import tables as tb
from pairshift.streaming.examples_stream import start_examples_stream

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="pairshift-test-")


def test_examples_roundtrip_jsonl_and_stats(spark):
    ex = tb.nli_examples(spark, SF)
    out = os.path.join(_tmp(), "nli.jsonl")
    io.write_examples(ex, out)
    back = io.read_examples(spark, out)
    assert back.count() == ex.count()
    a = tk.tokenizer_stats(ex, "whitespace").drop("data_path").collect()
    b = tk.tokenizer_stats(back, "whitespace", dataset_col="dataset").drop("data_path").collect()
    digits = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert digits(a) == digits(b)  # sums of doubles depend on their order in the last digits
    assert back.select("dataset").distinct().count() == 1
    got = back.where("variant = 'perturbed'").select("metadata.perturbation.a.code_switch.applied").collect()
    assert all(r.applied is not None for r in got)


def test_reference_shaped_json_array(spark):
    d = _tmp()
    path = os.path.join(d, "proto.json")
    rows = [
        {"uid": "nli_0001", "task": "nli", "split": "test", "variant": "clean", "prompt": "p1", "label": "entailment"},
        {"uid": "nli_0001", "task": "nli", "split": "test", "variant": "switchmix", "prompt": "p2", "label": "entailment"},
    ]
    pd.Series(rows).to_json(path, orient="records", force_ascii=False)
    df = io.read_examples(spark, path)
    assert {r.pair_id for r in df.collect()} == {"nli_0001"}


def _lines(path, rows):
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")


def test_each_path_has_its_own_format(spark):
    import json

    d = _tmp()
    rows = [{"id": f"p{i}__clean", "pair_id": f"p{i}", "variant": "clean", "input": f"t{i}"} for i in range(10)]
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump(rows, f)
    _lines(os.path.join(d, "b.jsonl"), rows)
    spark.createDataFrame([(r["id"], r["input"]) for r in rows], "id string, input string").write.parquet(os.path.join(d, "c"))
    df = io.read_examples(spark, [os.path.join(d, x) for x in ("a.json", "b.jsonl", "c")])
    got = {r.dataset.rsplit("/", 1)[-1]: r.n for r in df.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.json": 10, "b.jsonl": 10, "c": 10}
    assert io.read_examples(spark, os.path.join(d, "*.json*")).count() == 20


def test_many_files_are_listed_in_a_few_calls(spark, monkeypatch):
    """A folder, and a pattern, of 600 files (one with a space and a percent sign in its name): calls to the JVM do not grow with them."""
    from py4j.java_gateway import GatewayClient

    def calls(path):
        made = []
        send = GatewayClient.send_command
        with monkeypatch.context() as m:
            m.setattr(GatewayClient, "send_command", lambda self, command, *a, **k: (made.append(0), send(self, command, *a, **k))[1])
            named = io._named(spark, path, None)
        return named, len(made)

    counts = []
    for n in (6, 600):
        d = os.path.join(_tmp(), "x=1")
        os.makedirs(os.path.join(d, "deep", "er"))
        for i in range(n):
            _lines(os.path.join(d, *(["deep", "er"] if i % 2 else []), f"r 5%{i}.jsonl"), [{"id": f"{i}__clean", "pair_id": str(i), "variant": "clean"}])
        open(os.path.join(d, "_SUCCESS"), "w").close()
        (folder,), a = calls(d)
        (pattern,), b = calls(os.path.join(d, "*.jsonl"))
        assert folder[1:] == ("jsonl", True) and pattern[1:] == ("jsonl", False)
        assert io.read_examples(spark, os.path.join(d, "*.jsonl")).select("dataset").distinct().count() == n // 2
        counts.append((a, b))
    assert max(max(c) for c in counts) < 60  # py4j's own clean-up calls come and go


def test_patterns_over_folders_and_files(spark):
    """Each match is a dataset of its own: folders, files inside none of them, and formats that differ."""
    d = _tmp()
    for name in ("a.parquet", "b.parquet"):
        spark.range(4).selectExpr("concat(id, '__clean') AS id", "cast(id AS string) AS pair_id").repartition(2).write.parquet(os.path.join(d, name))
    _lines(os.path.join(d, "c.jsonl"), [{"id": "1__clean", "pair_id": "1"}])
    os.makedirs(os.path.join(d, "empty"))
    got = {r.dataset.rsplit("/", 1)[-1]: r.n for r in io.read_examples(spark, os.path.join(d, "[abc]*")).groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.parquet": 4, "b.parquet": 4, "c.jsonl": 1}
    with pytest.raises(ValueError, match="give fmt"):
        io.read_examples(spark, os.path.join(d, "*"))


def test_unclear_formats_are_refused(spark):
    import pytest

    d = _tmp()
    _lines(os.path.join(d, "rows.txt"), [{"id": "a"}])
    with pytest.raises(ValueError, match="give fmt"):
        io.read_examples(spark, os.path.join(d, "rows.txt"))
    assert io.read_examples(spark, os.path.join(d, "rows.txt"), fmt="jsonl").count() == 1
    with pytest.raises(FileNotFoundError):
        io.read_examples(spark, os.path.join(d, "none.jsonl"))


def test_written_dataset_reads_back_whole_and_pairs_meet(spark):
    from pairshift.operators import pairing

    ex = tb.nli_examples(spark, SF)
    n = ex.count()
    for fmt in ("jsonl", "parquet"):
        out = os.path.join(_tmp(), "set")
        io.write_dataset(ex.repartition(4, "id"), out, fmt=fmt)
        back = io.read_examples(spark, out)
        assert back.count() == n
        assert pairing.pair_rows(back, dataset_col="dataset").count() == n // 2


def test_file_order_decides_among_rows_with_one_id(spark):
    from pairshift.operators import pairing

    path = os.path.join(_tmp(), "x.jsonl")
    rows = [{"id": "p__clean", "pair_id": "p", "variant": "clean", "input": f"copy {(i * 7) % 10}"} for i in range(10)]
    _lines(path, [*rows, {"id": "p__x", "pair_id": "p", "variant": "perturbed", "input": "y"}])
    df = io.read_examples(spark, path)
    assert [r.clean_text for r in pairing.pair_rows(df, dataset_col="dataset").collect()] == ["copy 3"]
    assert [r.clean.text for r in pairing.inspector_pairs(df).collect()] == ["copy 0"]


def test_prototype_rows_without_id_keep_their_pair(spark):
    from pairshift.operators import pairing

    path = os.path.join(_tmp(), "proto.jsonl")
    _lines(path, [{"uid": "u1", "variant": "clean", "prompt": "a"}, {"uid": "u1", "variant": "switchmix", "prompt": "b"}])
    got = pairing.pair_rows(io.read_examples(spark, path), dataset_col="dataset").collect()
    assert [(r.pair_id, r.clean_text, r.perturbed_text) for r in got] == [("u1", "a", "b")]
    assert pairing.pair_rows(io.read_examples(spark, path).drop("row_order"), dataset_col="dataset").count() == 1


def test_metric_tables_language_pair(spark):
    d = _tmp()
    for name, drop in [("robustness_summary.csv", 0.1), ("robustness_summary_fr-es.csv", 0.2), ("other.csv", 0.3)]:
        with open(os.path.join(d, name), "w") as f:
            f.write(f"model,clean_score,switchmix_score,robustness_drop\nm,0.5,0.4,{drop}\n")
    df = io.read_metric_tables(spark, os.path.join(d, "*.csv"))
    got = {r.language_pair: r.robustness_drop for r in df.collect()}
    assert got == {"fr-en": 0.1, "fr-es": 0.2, None: 0.3}  # the rule is for the summaries' names only


def test_metric_tables_of_different_layouts_are_read_by_name(spark):
    d = _tmp()
    files = {"robustness_summary.csv": "model,clean_score,switchmix_score,robustness_drop\nm,0.5,0.4,0.1\n",
             "robustness_summary_fr-es.csv": "robustness_drop,model,clean_score,switchmix_score,task\n0.2,n,0.7,0.5,nli\n0.3,o,0.9,0.6,qa\n",
             "robustness_summary_fr-de.csv": "\nmodel,note.text,robustness_drop\np,\"a, b\",0.4\n", "robustness_summary_x.csv": ""}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    df = io.promote_columns(io.read_metric_tables(spark, os.path.join(d, "*.csv")), T.StructType([T.StructField("note.text", T.StringType())]))
    assert df.schema["robustness_drop"].dataType.typeName() == "double" and df.schema["note.text"].dataType.typeName() == "string"
    got = sorted((r["language_pair"], r["model"], r["task"], r["clean_score"], r["switchmix_score"], r["robustness_drop"], r["note.text"]) for r in df.collect())
    assert got == [("fr-de", "p", None, None, None, 0.4, "a, b"), ("fr-en", "m", None, 0.5, 0.4, 0.1, None), ("fr-es", "n", "nli", 0.7, 0.5, 0.2, None),
                   ("fr-es", "o", "qa", 0.9, 0.6, 0.3, None)]


def _files(d, files):
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)


def test_metric_tables_keep_their_own_language_pair_and_columns(spark):
    d = _tmp()
    _files(d, {"cross_language_robustness.csv": "language_pair,model,clean_accuracy\r\nfr-de,m,0.5\r\n,n,0.25\r\n",
               "robustness_summary_fr-es.csv": "model,source_file,x,x\no,mine,1,2\n"})
    df = io.read_metric_tables(spark, os.path.join(d, "*.csv"))
    got = {r["model"]: (r["language_pair"], r["clean_accuracy"], r["source_file"], r["extra"]) for r in df.collect()}
    assert got == {"m": ("fr-de", 0.5, "cross_language_robustness.csv", {}), "n": (None, 0.25, "cross_language_robustness.csv", {}),
                   "o": ("fr-es", None, "robustness_summary_fr-es.csv", {"source_file": "mine", "x": "1", "x.1": "2"})}
    assert sorted((r["name"], r["n_rows"]) for r in io.extra_names(df).collect()) == [("source_file", 1), ("x", 1), ("x.1", 1)]


def test_metric_tables_quotes_short_and_long_rows(spark):
    d = _tmp()
    _files(d, {"a.csv": 'model,note,task\n"a ""q"" b","x,y",""\nb\n"",z"z,t\n' + f'c,"{"w" * 50_000}, ""v""",t\n'})
    got = sorted(((r["model"], r["extra"].get("note"), r["task"]) for r in io.read_metric_tables(spark, d).collect()), key=str)
    assert got == sorted([('a "q" b', "x,y", None), ("b", None, None), (None, 'z"z', "t"), ("c", "w" * 50_000 + ', "v"', "t")], key=str)
    _files(d, {"b.csv": "model\na,b\n"})
    with pytest.raises(Exception, match="more fields than its header names"):
        io.read_metric_tables(spark, d).collect()


def test_metric_table_texts_round_trip(spark):
    d = os.path.join(_tmp(), "robustness_summary_fr-es.csv")
    rows = [('say "hi", then', "a\\b", 0.5), ("é,", None, None)]
    io.write_metric_table(spark.createDataFrame(rows, "model string, task string, robustness_drop double"), d)
    got = io.read_metric_tables(spark, d).select("model", "task", "robustness_drop", "language_pair", "source_file").collect()
    assert sorted(map(tuple, got)) == sorted((*r, "fr-es", "robustness_summary_fr-es.csv") for r in rows)


def test_metric_tables_plan_does_not_grow_with_files(spark):
    """400 files of 20 layouts: the same plan as for one, and no job before the result is asked for."""
    d, one = _tmp(), _tmp()
    _files(d, {f"t{i:03d}.csv": f"model,c{i % 20},robustness_drop\nm{i},{i},0.5\n" for i in range(400)})
    _files(one, {"t.csv": "model,robustness_drop\nm,0.5\n"})
    many, single = io.read_metric_tables(spark, os.path.join(d, "*.csv")), io.read_metric_tables(spark, one)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert size(many) == size(single) == 2
    rows = many.collect()
    assert len(rows) == 400 and all(r["extra"] == {f"c{int(r['model'][1:]) % 20}": r["model"][1:]} for r in rows)


def test_streaming_build_equals_batch(spark):
    d = _tmp()
    src, out = os.path.join(d, "src"), os.path.join(d, "out")
    pairs = tb.nli_pairs(spark, SF)
    pairs.write.parquet(src)
    q = start_examples_stream(spark, src, out, checkpoint_location=os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(out).select("id", "input", "label").collect()
    batch = build.build_examples(spark.read.parquet(src), "nli").select("id", "input", "label").collect()
    assert len(streamed) == 2 * pairs.count()
    assert sorted(streamed) == sorted(batch)


def test_predict_hook_and_subword_tokenizer(spark):
    ex = tb.nli_examples(spark, SF).limit(20)
    p = ml.predict(ex, lambda s: s.str.len().map(lambda n: "entailment" if n % 2 else "neutral"))
    rows = p.select("prompt", "prediction").collect()
    assert all(r.prediction == ("entailment" if len(r.prompt) % 2 else "neutral") for r in rows)

    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    texts = [r.text for r in tb.read_table(spark, SF, "documents").select("text").limit(50).collect()]
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=300, special_tokens=["[UNK]"]))
    path = os.path.join(_tmp(), "tok.json")
    tok.save(path)
    fn = ml.subword_tokenizer(path)
    got = tb.read_table(spark, SF, "documents").select("text", fn(F.col("text")).alias("ids")).limit(5).collect()
    for r in got:
        assert r.ids == [str(i) for i in tok.encode(r.text).ids]
    st = tk.tokenizer_stats(tb.nli_examples(spark, SF), fn, tokenizer_name="bpe300").collect()
    assert st and all(x.avg_clean_tokens > 0 for x in st)


def test_write_metric_table_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([("m", "fr-en", 0.5)], "model string, language_pair string, robustness_drop double")
    io.write_metric_table(df, os.path.join(d, "t"))
    back = spark.read.option("header", True).schema(df.schema).csv(os.path.join(d, "t"))
    assert back.collect() == df.collect()


def test_streaming_deltas_equal_batch_pairing(spark):
    from pairshift.operators import pairing
    from pairshift.streaming.examples_stream import start_deltas_stream

    d = _tmp()
    src, out = os.path.join(d, "src"), os.path.join(d, "out")
    tb.nli_pairs(spark, SF).write.parquet(src)
    q = start_deltas_stream(spark, src, out, dataset="d", checkpoint_location=os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    streamed = sorted(spark.read.parquet(out).collect())
    ex = build.build_examples(spark.read.parquet(src), "nli").withColumn("dataset", F.lit("d"))
    batch = sorted(tk.pair_token_deltas(pairing.pair_rows(ex, dataset_col="dataset"), "simple").collect())
    assert len(streamed) == len(batch) > 0
    assert streamed == batch


def test_reference_shaped_metadata_maps_to_a_b(spark):
    import json

    d = _tmp()
    path = os.path.join(d, "nli_test_fr-en.jsonl")
    meta = {"type": "switchmix+informal_noise",
            "premise": {"type": None, "code_switch": {"p_switch": 0.35, "seed": "1", "applied": True, "span_len": 2,
                                                       "insert_pos": 1, "insert_lang_span": "the cat"},
                        "noise": {"p": 0.15, "seed": "1", "dropped_tokens": 0, "abbreviations": 0, "punct_added": ""}},
            "hypothesis": None, "params": {"p_switch": 0.35, "noise_p": 0.15}}
    rows = [
        {"id": "p1__clean", "pair_id": "p1", "task": "nli", "split": "test", "variant": "clean", "input": "a",
         "prompt": "a", "label": "neutral", "metadata": {"pair_id": "p1", "task": "nli",
                                                        "languages": {"clean": "fr", "insert": "en"},
                                                        "perturbation": {"type": "none"}}},
        {"id": "p1__perturbed", "pair_id": "p1", "task": "nli", "split": "test", "variant": "perturbed", "input": "b",
         "prompt": "b", "label": "neutral", "metadata": {"pair_id": "p1", "task": "nli",
                                                        "languages": {"clean": "fr", "insert": "en"}, "perturbation": meta}},
    ]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    df = io.read_examples(spark, path)
    r = df.where("variant = 'perturbed'").collect()[0]
    assert r.metadata.perturbation.a.code_switch.insert_lang_span == "the cat"
    assert r.dataset.endswith("nli_test_fr-en.jsonl")


def test_write_dataset_partitions(spark):
    d = os.path.join(_tmp(), "ds")
    ex = tb.nli_examples(spark, SF)
    io.write_dataset(ex, d)
    assert sorted(os.listdir(os.path.join(d, "task=nli", "language_pair=fr-en"))) == ["split=test", "split=train"]
    assert io.read_examples(spark, d).count() == ex.count()


ODD = ["}", "{", "a}b{c", '"', '\\\\', '\\\\"}', "[{},{}]", "é}\u2028", "", ",", "]", "\n}\t{", "x" * 3000 + "}"]


@pytest.mark.parametrize("block", ["400", "1500", "128m"])
def test_json_array_read_by_many_tasks_equals_multiline(spark, block):
    """Braces, quotes and backslashes inside strings and keys, nested objects and arrays, cut at any byte."""
    import json

    d = _tmp()
    rows = [{"id": str(i), "text": ODD[i % len(ODD)] + ODD[i // len(ODD) % len(ODD)], "in": {"a}": [{"k": ODD[i % 7]}, {}], "b": None}} for i in range(180)]
    _files(d, {"a.json": json.dumps(rows[:120], ensure_ascii=False), "b.json": " [\n" + ",\n\n ".join(json.dumps(r, indent=1) for r in rows[120:]) + "\n] \n",
               "c.json": "[]", "d.json": ""})
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("in", T.StructType([
        T.StructField("a}", T.ArrayType(T.StructType([T.StructField("k", T.StringType())]))), T.StructField("b", T.StringType())]))])
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = io.read_json_arrays(spark, d, schema).collect()
        tasks = spark.read.option("lineSep", "}").text(d).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = spark.read.schema(schema).option("multiLine", True).json([os.path.join(d, f) for f in ("a.json", "b.json")]).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(str(tuple(r)) for r in want) and len(want) == 180
    assert [r["id"] for r in sorted(got, key=lambda r: (r["file"], r["record"]))] == [r["id"] for r in rows]
    assert tasks > 20 or block != "400"


def test_malformed_json_array_is_an_error(spark):
    d = _tmp()
    _files(d, {"a.json": '[{"id": "1"}, {"id": 2 "x"}]'})
    with pytest.raises(Exception):
        io.read_json_arrays(spark, d, T.StructType([T.StructField("id", T.StringType())])).collect()


def _data_files(folder):
    return [os.path.join(at, f) for at, _, files in os.walk(folder) for f in files if f.startswith("part-")]


def test_files_of_a_split_follow_its_bytes(spark):
    """24 tasks with rows of both splits: one file for each small split, several for a large one."""
    d = _tmp()
    rows = spark.range(0, 24_000, 1, 24).selectExpr(
        "concat('p', id) AS id", "'nli' AS task", "CASE WHEN id % 100 = 0 THEN 'test' ELSE 'train' END AS split", "'clean' AS variant", "repeat(sha2(string(id), 256), 8) AS input")
    io.write_dataset(rows, os.path.join(d, "whole"), fmt="parquet")
    assert len(_data_files(os.path.join(d, "whole"))) == 2
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        io.write_dataset(rows, os.path.join(d, "cut"), fmt="parquet")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = _data_files(os.path.join(d, "cut"))
    small, large = [len([f for f in files if f"split={s}" in f]) for s in ("test", "train")]
    assert small == 1 and 2 <= large < 24
    for name in ("whole", "cut"):
        assert io.read_examples(spark, os.path.join(d, name)).select("id", "split", "input").exceptAll(rows.select("id", "split", "input")).count() == 0
        assert io.read_examples(spark, os.path.join(d, name)).count() == 24_000
    io.write_examples(rows, os.path.join(d, "few"), "parquet", ("split",), max_records=5000)
    assert len(_data_files(os.path.join(d, "few"))) == 1 + 5


def test_pair_table_pairs_without_a_shuffle(spark):
    from pairshift.operators import pairing

    ex = tb.damaged_examples(tb.nli_examples(spark, SF)).withColumn("dataset", F.when(F.col("split") == "test", F.lit("d")))  # a null dataset too
    d = _tmp()
    table = io.write_pair_table(ex, "pair_table_test", os.path.join(d, "t"), 5, dataset_col="dataset")
    try:
        stored = pairing.pair_rows(table, dataset_col="dataset", order_col="stored_order", keyed=True)
        named = ex.withColumn("dataset", F.coalesce("dataset", F.lit("e"))).where("dataset = 'd'")
        stats = tk.tokenizer_stats(named, "simple", dataset_col="dataset")
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        want = pairing.pair_rows(ex, dataset_col="dataset")
        assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, stored.collect())) == sorted(map(str, want.collect())) and stored.count() > 10
        again = tk.tokenizer_stats(table.where("dataset = 'd'"), "simple", dataset_col="dataset", order_col="stored_order", keyed=True)
        close = lambda df: [[round(x, 9) if isinstance(x, float) else x for x in r] for r in df.collect()]
        assert close(again) == close(stats) and len(close(stats)) == 1
    finally:
        spark.sql("DROP TABLE pair_table_test")


def test_pair_table_keeps_the_readers_order(spark):
    from pairshift.operators import pairing

    d = _tmp()
    with open(os.path.join(d, "x.jsonl"), "w") as f:
        for i, text in enumerate(["z first", "a second", "m last"]):
            f.write('{"id": "p__clean", "variant": "clean", "task": "nli", "input": "%s"}\n' % text)
        f.write('{"id": "p__perturbed", "variant": "perturbed", "task": "nli", "input": "q"}\n')
    ex = io.read_examples(spark, os.path.join(d, "x.jsonl"))
    table = io.write_pair_table(ex, "pair_order_test", os.path.join(d, "t"), 3, dataset_col="dataset")
    try:
        got = pairing.pair_rows(table, dataset_col="dataset", order_col="stored_order", keyed=True).collect()
        assert [r["clean_text"] for r in got] == ["m last"] == [r["clean_text"] for r in pairing.pair_rows(ex, dataset_col="dataset").collect()]
    finally:
        spark.sql("DROP TABLE pair_order_test")


def test_cleanup_materialized(spark):
    from pairshift import session

    df = session.materialize(spark.range(10), "cleanup-test")
    assert df.count() == 10
    path = session.materialized_paths()[-1]
    assert os.path.exists(path.replace("file:", ""))
    assert session.cleanup_materialized(spark) >= 1
    assert not os.path.exists(path.replace("file:", "")) and session.materialized_paths() == []
