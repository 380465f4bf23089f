"""Host-level quality rules: document rules, failure rates by host, an empirical beta prior, verdicts joined back.

Document rules (words are runs outside space, tab, LF, VT, FF, CR): a document fails with fewer than ``min_words``
words, or when more than ``max_repeat_pct`` percent of its words lie in five-word windows that occur twice or more
in it. Host rule: the failure rates of all hosts give a beta prior by the method of moments; a host's posterior is
Beta(a + failures, b + passes). A host is rejected when even its lower credible bound (mean - z * sd) exceeds
``max_host_rate``; a small host is drawn towards the mean of all hosts, so few documents never condemn one.

Edge cases: null text counts as empty and fails; a null host has no host verdict; repeated rows count as rows; an
empty table gives an empty table; other columns do not matter; a bound equal to the limit rejects no host; with one host, or hosts that differ no more than chance, the prior is so strong
that each host has the mean rate. Texts of over ``LONG`` words use arrays in place of tuples, with equal counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairshift.llm.common import SPACE, fresh, whole_text, without, written

N = 5
LONG = 100_000
ROWS = 512
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list) -> int:
    """Words inside n-word windows that occur at least twice, first occurrences included."""
    n_windows = len(words) - N + 1
    if n_windows < 2:
        return 0
    if len(words) > LONG:
        return _repeat_words_arrays(words)
    windows = list(zip(*(words[i:] for i in range(N)), strict=False))
    if len(set(windows)) == n_windows:
        return 0
    seen = Counter(windows)
    covered = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + N - max(i, end)
            end = i + N
    return covered


def _repeat_words_arrays(words: list) -> int:
    """The same count with whole-array steps: windows of 1, 2, 4 and 5 words get exact integer names in turn."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    one = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))

    def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        right = right[-len(left):] if len(right) >= len(left) else right
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

    two = named(one[:-1], one[1:])
    four = named(two[:-2], two[2:])
    five = named(four[:-1], one[4:])
    again = np.bincount(five)[five] > 1
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + N, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, SPACE.encode()))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            b = batch.slice(start, ROWS)
            counts = [base_counts(t) for t in b.column("body").to_pylist()]
            keep = [i for i, name in enumerate(b.schema.names) if name != "body"]
            arrays = [b.column(i) for i in keep] + [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(arrays, names=[b.schema.names[i] for i in keep] + list(COUNTS))


def document_rules(docs: DataFrame, id_col: str, text_col: str, host: Column, min_words: int, max_repeat_pct: int) -> DataFrame:
    """``id``, ``host``, ``text_key``, the five counts and ``base_failed`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), F.xxhash64(whole_text(text_col)).alias("text_key"), whole_text(text_col).alias("body"))
    schema = rows.drop("body").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return rows.mapInArrow(_count, schema).withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, max_host_rate: float, z: float) -> DataFrame:
    """``host``, ``rejected``: one row per host; the prior comes from one aggregate row over all hosts."""
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    total = hosts.agg(
        F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("f").alias("f"),
        F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")).first()
    n, f, ff = float(total["n"] or 0), float(total["f"] or 0), float(total["ff"] or 0)
    a, b = beta_prior(int(total["h"]), n, f, ff)
    pa_, pb = F.lit(a) + F.col("f"), F.lit(b) + F.col("n") - F.col("f")
    mean = pa_ / (pa_ + pb)
    sd = F.sqrt(mean * (1 - mean) / (pa_ + pb + 1))
    return hosts.select("host", (mean - z * sd > max_host_rate).alias("rejected"))


def beta_prior(hosts: int, n: float, f: float, ff: float) -> tuple[float, float]:
    """Method of moments: mean rate m, and the variance between hosts beyond the binomial share of it."""
    if n == 0:
        return 1.0, 1.0
    m = min(max(f / n, 1e-6), 1 - 1e-6)
    between = max(ff / n - (f / n) ** 2 - m * (1 - m) * hosts / n, 0.0)
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return m * strength, (1 - m) * strength


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
                 min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Per row: ``id``, ``host``, ``text_key``, the counts, ``base_failed``, ``host_rejected`` and ``kept``."""
    host = F.col("source") if host is None else host
    rows = written(document_rules(docs, id_col, text_col, host, min_words, max_repeat_pct), "quality")
    verdicts = host_verdicts(rows, max_host_rate, z).where("rejected").select(F.col("host").alias("bad_host"), "rejected")
    verdicts = written(verdicts, "verdicts")  # a plain join with them may be split on a hot host
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    return rows.join(verdicts, F.col("host") == F.col("bad_host"), "left").select(
        *rows.columns, rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, **rules) -> DataFrame:
    """The rows that pass, with all their columns."""
    host = F.col("source") if host is None else host
    name = fresh(docs, "host_of_row")
    rejected = host_quality(docs, id_col, text_col, host, **rules).where("NOT kept").select("id", "text_key", "host").distinct()
    keys = {"id": F.col(id_col), "text_key": F.xxhash64(whole_text(text_col)), "host": F.col(name)}
    return without(docs.withColumn(name, host.cast("string")), rejected, keys).select(*docs.columns)
