"""URL rules as a sort-merge range join.

A host is written with its labels reversed and each followed by a dot (``x.example.net`` becomes
``net.example.x.``), so a rule's host and all its subdomains are one interval of keys, and rule intervals nest or
are disjoint. Rules and urls are sorted together by key; the sweep carries the stack of rules that were open where
the last rule began. At a url, the entries that its key has already left are skipped, the others are tested against
the path, and the longest rule wins (host and path together; then the longer host, then the text of the rule).

The sweep runs in ranges of keys, whatever the number of rules: urls and rule stacks are dealt by range together (Spark
samples the cuts) and written once with the number of their range, so that all that follows sees the same cuts. Urls of
one host are ordered by a hash as well, so a hot host covers several ranges. A rule is in one range only; a range begins
with the stack that was open at the end of the ranges before it, of which there is one row per range. The number of
ranges grows with urls and rules up to ``spark.sql.shuffle.partitions``; the sweep itself is a running window, which holds
one stack.
Only DataFrame functions run.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. Edge cases: a null url, or one without ``://``, has empty host and path, no rule and the
default verdict; repeated rows are judged one by one; an empty table gives an empty table; of equal rules that
differ in verdict, block wins; no rules at all give every url the default verdict;
urls of any length are read whole; other columns do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairshift.llm.common import written

RANGE_ROWS = 4096
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: its key and the stack of rules open there, each with the key at which it closes.

    ``rules``: host, path, verdict. A closing key is the opening one with its last dot raised to the next character.
    """
    lists = (
        rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
        .select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")
        .groupBy("key").agg(F.collect_list(F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"), "path", "verdict",
            F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("closes"))).alias("rules"))
    )
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    opened = lists.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.concat_ws(".", F.slice(labels, F.lit(1), n)), F.lit(".")))).alias("open_key"))
    return opened.join(lists.select(F.col("key").alias("open_key"), "rules"), "open_key").groupBy("key").agg(
        F.flatten(F.collect_list("rules")).alias("stack"))


def in_ranges(urls: DataFrame, stacks: DataFrame, ranges: int) -> DataFrame:
    """Urls (``kind`` 1) and rule stacks (``kind`` 0) with the number of their range of keys, written once."""
    url_rows = urls.select(
        host_key(host_of(F.col("url"))).alias("key"), F.lit(1).alias("kind"), F.xxhash64("id", "url").alias("salt"),
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule_rows = stacks.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), "stack")
    rows = url_rows.unionByName(rule_rows, allowMissingColumns=True).repartitionByRange(ranges, "key", "kind", "salt")
    return written(rows.select(F.spark_partition_id().alias("range"), "key", "kind", "id", "host", "path", "stack"), "url-ranges")


def open_stacks(rows: DataFrame) -> DataFrame:
    """Per range the stack that is open where it begins, as a rule row before all keys; one row per range is ordered."""
    last = rows.groupBy("range").agg(F.expr("max_by(stack, key) FILTER (WHERE kind = 0)").alias("stack"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("range", F.lit("").alias("key"), F.lit(0).alias("kind"), F.last("stack", ignorenulls=True).over(before).alias("stack"))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: the id column, ``host``, ``path``, ``rule`` (null without one) and ``verdict``."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    stacks = rule_stacks(rules.select("host", "path", "verdict"))
    most = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(-(-(urls.count() + rules.count()) // RANGE_ROWS), most))
    rows = in_ranges(urls, stacks, ranges)
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(open_stacks(rows), allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("stack", lambda r: (F.col("key") < r["closes"]) & F.startswith(F.col("path"), r["path"]))
    return swept.select("id", "host", "path", F.array_max(fits).alias("won")).select(
        F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
