"""Readers and writers for example and metric tables (IO1-IO11).

Examples are read with an explicit schema (never inferred) and ``FAILFAST``, so
malformed input raises like the original loaders. Every row keeps the path it
was read by (``dataset``), because pairing never crosses datasets. Writers are plain
distributed writes: one JSON object per line, or Parquet partitioned by the
columns that the original wrote as separate files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.functions.perturb import FIELD_META_TYPE
from pairshift.operators.pairing import pair_key

S = T.StringType()

# On-disk perturbation metadata: NLI rows name the fields premise/hypothesis,
# QA rows context/question; the engine's own rows use a/b.
FILE_PERTURBATION_TYPE = T.StructType([
    T.StructField("type", S),
    *[T.StructField(n, FIELD_META_TYPE) for n in ("premise", "hypothesis", "context", "question", "a", "b")],
    T.StructField("params", T.StructType([T.StructField("p_switch", T.DoubleType()), T.StructField("noise_p", T.DoubleType())])),
])
EXAMPLE_FILE_SCHEMA = T.StructType([
    *[T.StructField(n, S) for n in ("id", "pair_id", "uid", "task", "split", "variant", "input", "prompt",
                                     "text_a", "text_b", "label", "target")],
    T.StructField("metadata", T.StructType([
        T.StructField("pair_id", S),
        T.StructField("task", S),
        T.StructField("languages", T.StructType([T.StructField("clean", S), T.StructField("insert", S)])),
        T.StructField("perturbation", FILE_PERTURBATION_TYPE),
    ])),
])


FORMATS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet"}


def _format_of(name: str, in_folder: bool) -> str | None:
    """Format by file name; a Spark part file that ends in ``.json`` holds one object per line."""
    parts = name.lower().split(".")
    if parts[-1] in ("gz", "bz2", "zst", "snappy", "deflate", "lz4"):
        parts.pop()
    fmt = FORMATS.get(parts[-1]) if len(parts) > 1 else None
    return "jsonl" if fmt == "json" and in_folder and name.startswith("part-") else fmt


def _joined(spark: SparkSession, items) -> list[str]:
    """The items of a Java array as strings, in one call however many there are."""
    return [x for x in spark.sparkContext._jvm.scala.Predef.genericWrapArray(items).mkString("\0").split("\0") if x]


def _plain(path: str) -> str:
    """A path without the empty authority that some of Spark's listings write (``file:///x`` is ``file:/x``)."""
    return re.sub(r"^(\w[\w+.-]*:)/+", r"\1/", path)


def _named(spark: SparkSession, path: str, fmt: str | None) -> list[tuple[str, str, bool]]:
    """(path, format, is a folder) of everything that ``path`` names; a pattern names each of its matches.

    A folder's format is that of its data files, which must agree; an unknown or missing suffix is an error
    unless ``fmt`` is given. Spark lists the files (on the executors when there are many folders) and the names come
    over in one call. A pattern that matches files of one format only stays as it is, for the scan to list.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or not len(found):
        raise FileNotFoundError(path)
    names = {_plain(x): x for x in _joined(spark, jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)._jdf.inputFiles()
    formats: dict[str, set] = {name: set() for name in names}
    files = set()
    for leaf in (_plain(unquote(x)) for x in _joined(spark, listed)):
        folder, _, file = leaf.rpartition("/")
        if leaf in formats:
            files.add(leaf)
            formats[leaf].add(fmt or _format_of(file, False))
            continue
        while folder and folder not in formats:
            folder = folder.rpartition("/")[0]
        if folder:
            formats[folder].add(fmt or _format_of(file, True))
    for name, kinds in formats.items():
        if fmt is None and (len(kinds) != 1 or None in kinds):
            raise ValueError(f"the format of {names[name]} is not clear from its files; give fmt")
    kind_of = {name: fmt or next(iter(kinds)) for name, kinds in formats.items()}
    if len(files) == len(names) > 1 and len(set(kind_of.values())) == 1:
        return [(path, next(iter(kind_of.values())), False)]
    return [(names[name], kind, name not in files) for name, kind in kind_of.items()]


def read_examples(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str | None = None,
    schema: T.StructType = EXAMPLE_FILE_SCHEMA,
) -> DataFrame:
    """IO1/IO2/IO3/IO7/U2: read example shards, tagging rows with their dataset and their place.

    ``jsonl``: one object per line (blank lines are skipped); ``json``: one document holding an array of rows;
    ``parquet``. Each path has its own format, by suffix (a folder: by its files) unless ``fmt`` is given.
    ``dataset`` is the file or folder that was named (each match of a pattern), so the part files of a folder are
    one dataset. ``row_order`` is the place in file order: file, split, row; pairing uses it by default. ``uid``
    (prototype files) fills a missing ``pair_id``; on-disk field names are mapped onto the engine's ``a``/``b``.
    """
    named = [x for p in ([paths] if isinstance(paths, str) else paths) for x in _named(spark, p, fmt)]
    scans = []
    for f in sorted({x[1] for x in named}):
        files = [name for name, kind, folder in named if kind == f and not folder]
        if files:
            scans.append(_scan(spark, f, files, schema).withColumn("dataset", F.col("_metadata.file_path")))
        scans += [_scan(spark, f, [name], schema).withColumn("dataset", F.lit(name)) for name, kind, folder in named if kind == f and folder]
    tagged = [df.withColumn("row_order", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")))
        .select(*schema.names, "dataset", "row_order") for df in scans]
    return canonical_examples(reduce(DataFrame.unionByName, tagged))


def _scan(spark: SparkSession, fmt: str, paths: list[str], schema: T.StructType) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(*paths)
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    return (r.option("multiLine", True) if fmt == "json" else r).json(paths)


def _running(df: DataFrame, value: Column, out: str, before: bool) -> DataFrame:
    """``out``: the sum of ``value`` over a file's pieces up to each one (or ``before`` it): inside a split, then over splits."""
    df = df.withColumn(f"{out}_v", value)
    here = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = df.groupBy("file", "split").agg(F.sum(f"{out}_v").alias("n")).select(
        F.col("file").alias("of"), F.col("split").alias("at"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    df = df.withColumn(out, F.coalesce(F.sum(f"{out}_v").over(here), F.lit(0)))
    return df.join(splits, (F.col("file") == F.col("of")) & (F.col("split") == F.col("at"))).withColumn(
        out, F.col(out) + F.col("base")).drop("of", "at", "base", f"{out}_v")


def read_json_arrays(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = EXAMPLE_FILE_SCHEMA) -> DataFrame:
    """IO1 for large documents: the objects of JSON arrays, one array per file, each file read by many tasks.

    A file is cut at closing braces, which Spark's text reader can do from any byte on. A piece carries how it changes the
    state of the scan: the parity of its quotes, and the braces it opens if it starts outside or inside a string. Running
    sums over pieces (inside a split, then over splits) give each piece's state, and an object ends where the depth is
    zero again; the pieces of an object, a few, meet by its number. Columns: those of ``schema``, ``file`` and ``record``
    (0-based place in the document). A malformed object is an error; elements that are not objects are not supported.
    """
    pieces = spark.read.option("lineSep", "}").text([paths] if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    opened = lambda odd: F.aggregate(F.transform(parts, lambda x, i: F.when(i % 2 == odd, F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))).otherwise(0)),
                                     F.lit(0), lambda a, x: a + x)
    pieces = pieces.select("*", (F.size(parts) - 1).cast("long").alias("quotes"), opened(0).alias("open_0"), opened(1).alias("open_1"))
    pieces = _running(pieces, F.col("quotes"), "quotes_before", True)
    outside = F.col("quotes_before") % 2 == 0
    ends_outside = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("close", ends_outside.cast("long"))
    pieces = _running(pieces, F.when(outside, F.col("open_0")).otherwise(F.col("open_1")).cast("long") - F.col("close"), "depth", False)
    pieces = pieces.withColumn("last", ((F.col("depth") == 0) & (F.col("close") == 1)).cast("long"))
    pieces = _running(pieces, F.col("last"), "record", True)
    whole = pieces.groupBy("file", "record").agg(
        F.max("last").alias("last"), F.concat_ws("}", F.transform(F.sort_array(F.collect_list(F.struct("split", "row", "value"))), lambda x: x["value"])).alias("text"))
    text = F.concat(F.regexp_replace("text", r"^[\s,\[]+", ""), F.lit("}"))
    rows = whole.where("last = 1").select("file", "record", F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*", "file", "record")


def read_in_file_order(spark: SparkSession, paths: str | Sequence[str], out: str = "idx") -> DataFrame:
    """The rows of Parquet files with ``out``, their 0-based position: files by path, rows by their place in the file.

    A row's place is in the file's metadata, so nothing is sorted and rows do not move: a position is the file's first
    one plus the place. First positions come from the files' row counts (read from the footers); that table has one
    row per file, of which the driver lists all for the scan anyway, and is the only thing broadcast.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*names)
    file, at, start = F.col("_metadata.file_path"), F.col("_metadata.row_index"), f"{out}_start"
    sizes = spark.read.parquet(*names).select(file.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias(f"{out}_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    tagged = df.select("*", file.alias(f"{out}_file"), at.alias(f"{out}_row"))
    placed = tagged.join(F.broadcast(starts), F.col(f"{out}_file") == F.col(f"{out}_of"))
    return placed.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns], (F.col(start) + F.col(f"{out}_row")).alias(out))


def canonical_examples(df: DataFrame) -> DataFrame:
    """Map file field names onto the engine schema (``perturbation.a/b``, ``pair_id``)."""
    pert = "metadata.perturbation"
    a = F.coalesce(F.col(f"{pert}.a"), F.col(f"{pert}.premise"), F.col(f"{pert}.context"))
    b = F.coalesce(F.col(f"{pert}.b"), F.col(f"{pert}.hypothesis"), F.col(f"{pert}.question"))
    meta = F.struct(
        F.col("metadata.pair_id").alias("pair_id"),
        F.col("metadata.task").alias("task"),
        F.col("metadata.languages").alias("languages"),
        F.struct(F.col(f"{pert}.type").alias("type"), a.alias("a"), b.alias("b"), F.col(f"{pert}.params").alias("params")).alias("perturbation"),
    )
    return df.withColumns({
        "pair_id": F.coalesce(F.col("pair_id"), F.col("uid")),
        "metadata": F.when(F.col("metadata").isNotNull(), meta),
    }).drop("uid")


def write_examples(df: DataFrame, path: str, fmt: str = "jsonl", partition_by: Sequence[str] = (), mode: str = "overwrite",
                   max_records: int = 0) -> None:
    """IO4/IO5/IO6: distributed write, one JSON object per line (UTF-8, unescaped) or Parquet.

    ``partition_by=("task", "split")`` gives one folder per split, the equivalent of the original one-file-per-split
    layout. Rows are first rebalanced by these columns: adaptive execution puts small splits together and cuts a hot one
    at ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so a split's files follow its bytes and not the number of
    tasks; ``max_records`` bounds a file's rows as well. Inside a file rows are ordered by ``id``, ``variant``.
    """
    df = df.drop("row_order")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df = df.sortWithinPartitions(*partition_by, *[c for c in ("id", "variant") if c in df.columns])
    w = df.write.mode(mode)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("ignoreNullFields", False).json(path)


def write_pair_table(examples: DataFrame, table: str, path: str, buckets: int, dataset_col: str | None = None, legacy_suffix: bool = False) -> DataFrame:
    """J1 as a stored layout: example rows as a table bucketed and sorted by (``dataset``, ``pair_id``), read back.

    ``pair_id`` holds the pair key and ``dataset`` the dataset of every row, so ``pair_rows(..., keyed=True)`` and all that
    builds on it finds the rows of a pair in one bucket and shuffles nothing on the pair key. Rows are dealt to the
    buckets before they are written (one file each); the readers' ``row_order`` is kept as ``stored_order``, which decides
    which row comes last.
    """
    order = F.col("row_order") if "row_order" in examples.columns else F.col("id").cast("string")
    keyed = examples.withColumns({
        "stored_order": order, "dataset": F.col(dataset_col) if dataset_col else F.lit(""),
        "pair_id": pair_key(legacy_suffix=legacy_suffix)}).drop("row_order")
    dealt = keyed.repartition(buckets, "dataset", "pair_id")
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, "dataset", "pair_id").sortBy("dataset", "pair_id").saveAsTable(table)
    return examples.sparkSession.table(table)


def language_pair_from_path(file_name: Column) -> Column:
    """IO11: ``robustness_summary.csv`` -> ``fr-en``; ``robustness_summary_<pair>.csv`` -> ``<pair>``;
    anything else -> the name without its last four characters."""
    name = F.element_at(F.split(file_name, "/"), -1)
    tagged = F.regexp_extract(name, r"^robustness_summary_(.*)\.csv$", 1)
    return (
        F.when(name == F.lit("robustness_summary.csv"), F.lit("fr-en"))
        .when(name.rlike(r"^robustness_summary_.*\.csv$"), tagged)
        .otherwise(name.substr(F.lit(1), F.length(name) - 4))
    )


# Column types of the robustness tables (the summary, with the cross-language table's own columns).
METRIC_SCHEMA = T.StructType(
    [T.StructField(n, S) for n in ("model", "task")]
    + [T.StructField(n, T.DoubleType()) for n in ("clean_score", "switchmix_score", "clean_accuracy", "switchmix_accuracy", "robustness_drop")])


#: One CSV field after its comma (the line gets one in front): quoted (a doubled quote inside stands for one), or plain up to the next comma.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def _fields(line: Column) -> Column:
    """The fields of one CSV line, unquoted; an empty one is null."""
    def plain(x: Column) -> Column:
        quoted = F.replace(F.regexp_extract(x, r'(?s)^"(.*)"[^"]*$', 1), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(x.startswith('"'), quoted).otherwise(x), F.lit(""))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), 1), plain)


def _names(header: Column) -> Column:
    """Column names of a header line; a repeated name gets ``.1``, ``.2``, ... and an empty one its place."""
    given = F.transform(_fields(header), lambda x, i: F.coalesce(x, F.concat(F.lit("Unnamed: "), i.cast("string"))))

    def distinct(items: Column) -> Column:
        def name(x: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x))
            return F.when(before == 0, x).otherwise(F.concat(x, F.lit("."), before.cast("string")))

        return F.transform(items, name)

    return F.element_at(F.transform(F.array(given), distinct), 1)


def _table_name(path: Column) -> Column:
    """The file's name, or its folder's for the part files of one written table."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.url_decode(F.when(name.startswith("part-"), F.element_at(F.split(path, "/"), -2)).otherwise(name))


def metric_cells(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """``source_file`` and ``cells``: every data row of the CSV files as a map from its file's column names to texts.

    The header is data: the first line of a file that is not blank (looked for in the file's first split) is one row
    of a narrow table, which meets the file's other lines on the path. So one scan, whose plan depends neither on the
    number of files nor on their layouts, reads tables of any layout; no job runs while it is built. A short row lacks
    its last columns; a row with more fields than its header is an error, as is a line that splits a quoted field.
    """
    paths = [pattern] if isinstance(pattern, str) else list(pattern)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    lines = lines.where(F.trim("value") != "")
    first = lines.where("split = 0").groupBy("file").agg(F.min(F.struct("row", "value")).alias("first"))
    headers = first.select(F.col("file").alias("of_file"), F.col("first.row").alias("header_row"), _names(F.col("first.value")).alias("names"))
    rows = lines.join(headers, F.col("file") == F.col("of_file")).where("row <> header_row").select("file", "names", _fields(F.col("value")).alias("fields"))
    size, width = F.size("fields"), F.size("names")
    message = F.concat(F.lit("more fields than its header names: "), F.col("file"))
    padded = F.when(size > width, F.raise_error(message).cast("array<string>")).otherwise(
        F.concat("fields", F.array_repeat(F.lit(None).cast("string"), width - size)))
    return rows.select(_table_name(F.col("file")).alias("source_file"), F.map_from_arrays("names", padded).alias("cells"))


def read_metric_tables(spark: SparkSession, pattern: str | Sequence[str], schema: T.StructType = METRIC_SCHEMA) -> DataFrame:
    """IO8/IO10/IO11: the rows of all CSV files (header row) that match, whatever their layouts.

    Columns: those of ``schema``, read by name and cast (a column that a file lacks is null in its rows); ``extra``,
    a map of the file's other columns as text (``promote_columns`` makes columns of it); ``source_file``, the file or,
    for part files, their folder; and ``language_pair``: the file's own column where it has one, else the pair in the
    name of a ``robustness_summary*`` file, else null. Nothing is inferred and no job runs while this is built.
    """
    cells = metric_cells(spark, pattern)
    own = [f.name for f in schema.fields if f.name not in ("source_file", "language_pair", "extra")]
    named = F.when(F.col("source_file").startswith("robustness_summary"), language_pair_from_path(F.col("source_file")))
    known = F.array(*[F.lit(n) for n in [*own, "language_pair"]])
    return cells.select(
        *[F.col("cells")[n].cast(schema[n].dataType).alias(n) for n in own],
        F.map_filter("cells", lambda k, _: ~F.array_contains(known, k)).alias("extra"), "source_file",
        F.when(F.map_contains_key("cells", "language_pair"), F.col("cells")["language_pair"]).otherwise(named).alias("language_pair"))


def promote_columns(tables: DataFrame, columns: T.StructType) -> DataFrame:
    """Columns (names and types given) out of ``extra``, which keeps the others: a concatenation that keeps all columns."""
    names = F.array(*[F.lit(f.name) for f in columns.fields])
    rest = F.map_filter("extra", lambda k, _: ~F.array_contains(names, k))
    old = [F.col(f"`{c.replace('`', '``')}`") if c != "extra" else rest.alias("extra") for c in tables.columns]
    return tables.select(*[F.col("extra")[f.name].cast(f.dataType).alias(f.name) for f in columns.fields], *old)


def extra_names(tables: DataFrame) -> DataFrame:
    """``name``, ``n_rows``: what ``extra`` holds, to choose from for ``promote_columns``."""
    return tables.select(F.explode(F.map_keys("extra")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def write_metric_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """IO9: write a (small, aggregated) metric table with a header row, or as Parquet."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("escape", '"').csv(path)


def write_dataset(examples: DataFrame, out_dir: str, clean_lang: str = "fr", insert_lang: str = "en",
                  fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """IO6: the built dataset as one folder per ``task / language_pair / split``
    (the original wrote one ``{task}_{split}_{clean}-{insert}.jsonl`` file per split)."""
    df = examples.withColumn("language_pair", F.lit(f"{clean_lang}-{insert_lang}"))
    write_examples(df, out_dir, fmt=fmt, partition_by=("task", "language_pair", "split"), mode=mode)
