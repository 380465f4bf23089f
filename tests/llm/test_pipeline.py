import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brute import context_spans, pii_spans
from pairshift.llm import host_quality as hq
from test_jaccard_join import brute as near_brute


def mask(text):
    """Spans of all kinds, joined where they overlap, replaced by the first one's kind."""
    if text is None:
        return None
    spans = sorted((a, b, k) for k, found in {**pii_spans(text), **context_spans(text)}.items() for a, b in found)
    out, at, reach = [], 0, -1
    for a, b, k in spans:
        if a >= reach:
            out += [text[at:a], f"<{k.upper()}>"]
        reach = at = max(reach, b)
    return "".join(out) + text[at:]


def brute(rows):
    """doc_id -> token count of what the pipeline packs; one host only, which is not rejected."""
    stay = []
    for i, t in rows:
        n, _, _, _, repeats = hq.base_counts(t or "")
        if not (n < 10 or 100 * repeats > 20 * n):
            stay.append((i, t))
    best = {}
    for i, t in stay:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    stay = [(None if i == -1 else i, t) for t, i in best.items()]
    near = [eval(r) for r in near_brute(stay)]
    keep = [str(d) for d, _, c in near if d == c]
    out = []
    for i, t in stay:
        if str(i) in keep:
            out.append((i, mask(t)))
    return out


def documents(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7)))
    rows = [(0, None), (1, ""), (2, "short text"), (3, "same same same same same same same same same same same same")]
    for i in range(4, 60):
        rows.append((i, " ".join(word() for _ in range(r.randint(10, 120)))))
    for i in range(60, 90):
        _, t = r.choice(rows[4:60])
        w = t.split()
        if i % 2:
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(90, rows[5][1] + " write to a.b@example.com or +1 (555) 123-4567"), (91, "x " + rows[6][1] + " card 4111 1111 1111 1111 ip 10.1.2.3"),
             (92, " ".join(word() for _ in range(9000))), (93, rows[7][1]), (93, rows[7][1])]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in documents(1)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_against_a_single_machine_version(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    got = {}
    for r in rows:
        got[r[0]] = got.get(r[0], 0) + r[3]
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in brute(documents(1))}
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for members in bins.values():
        members.sort()
        assert [o for o, _ in members] == np.cumsum([0, *[n for _, n in members]])[:-1].tolist() and sum(n for _, n in members) <= 4096
    assert len(bins) <= -(-sum(want.values()) // 4096) + 1


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS kept", "1 AS id", "2 AS body")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, empty, folder).count() == 0


def test_nulls_in_every_column(spark, folder):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, None, None, None, None), (1, text, None, None, None), (None, text + " a@b.cc", None, "s", None), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
    assert sorted(str(tuple(r)) for r in docs.collect()) == [str((1, text, None, None, None))]
