"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairshift.session import materialize, materialized_paths

#: The white space that separates words: space, tab, LF, VT, FF, CR. ``bytes.split()`` splits on exactly these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(text_col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back (survives lost executors)."""
    return materialize(df, name)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path, by which ``removed`` frees its space."""
    return written(df, name), materialized_paths()[-1]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``written_at`` that nothing reads any more: what came of them is written itself."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, rejected: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose key values do not occur in ``rejected`` (null equals null).

    ``keys`` maps a column of ``rejected`` to the expression over ``docs`` that must equal it. Only the keys of
    the rejected rows are joined, so the answer never depends on which columns the documents carry.
    """
    names = {k: fresh(docs, f"reject_{i}") for i, k in enumerate(keys)}
    right = rejected.select(*[F.col(k).alias(v) for k, v in names.items()])
    left = docs
    tagged = {}
    for k, e in keys.items():
        tagged[k] = fresh(left, "key_" + names[k])
        left = left.withColumn(tagged[k], e)
    cond = None
    for k in keys:
        c = F.col(tagged[k]).eqNullSafe(F.col(names[k]))
        cond = c if cond is None else cond & c
    return left.join(right, cond, "left_anti").select(*docs.columns)
