"""Exact deduplication by Grace hash partitioning with open-addressing tables.

Texts are equal when they are identical; null counts as the empty text. Of equal texts the row with the
largest id stays.

Method. (1) Every task folds its own rows into an open-addressing table first, so a text that fills a third of
the corpus leaves a task once per flush, not once per row. (2) The folded records are dealt to buckets by a hash
of the content; Spark's exchange files are the spill files. (3) A task reads its bucket into an open-addressing
table that compares complete contents. If the bucket outgrows ``table_bytes``, sub-buckets (the next hash digits)
leave the table and are written, folded so far, to a Parquet table in the shared folder; they are dealt again
with the next digits, level after level, until each bucket fits. (4) The narrow rows (id, digest) are joined with
the narrow classes on the digest; AQE may split a hot digest. Different contents are only told apart by their
content inside a bucket; the last join relies on SHA-256 together with xxhash64 and the byte length.

Edge cases: null and empty texts form one group; a null id loses to any other; a row repeated with the same id
and text counts in ``group_size`` and exactly one copy of it is kept; an empty table gives an empty table;
texts of any length are compared whole; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import fresh, partitions, whole_text, written

TABLE_BYTES = 48 << 20
FAN_OUT = 16
FLUSH_ROWS = 2048
LAST_LEVEL = 12


class ContentTable:
    """Open addressing with linear probing; an entry is found by hash and then by complete content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.ids: list[Any] = []
        self.counts: list[int] = []
        self.payloads: list[Any] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.hashes)

    def add(self, h: int, text: str, id_: Any, n: int, payload: Any, size: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                self.counts[e] += n
                if id_ is not None and (self.ids[e] is None or id_ > self.ids[e]):
                    self.ids[e], self.payloads[e] = id_, payload
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        for column, value in ((self.hashes, h), (self.texts, text), (self.ids, id_), (self.counts, n), (self.payloads, payload), (self.sizes, size)):
            column.append(value)
        self.bytes += size
        if 10 * len(self.hashes) > 7 * len(self.slots):
            self._rehash(2 * len(self.slots))

    def _rehash(self, n_slots: int) -> None:
        self.slots, mask = [-1] * n_slots, n_slots - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e

    def remove(self, leaves: Any) -> list[int]:
        """Entries for which ``leaves(hash)`` holds; the caller reads them and then calls ``drop``."""
        return [e for e, h in enumerate(self.hashes) if leaves(h)]

    def drop(self, entries: list[int]) -> None:
        gone = set(entries)
        stay = [e for e in range(len(self)) if e not in gone]
        self.bytes -= sum(self.sizes[e] for e in entries)
        for name in ("hashes", "texts", "ids", "counts", "payloads", "sizes"):
            column = getattr(self, name)
            setattr(self, name, [column[e] for e in stay])
        self._rehash(len(self.slots))


def sub_bucket(h: int, level: int) -> int:
    """The hash digit that splits a bucket of this level; independent of the digits Spark has dealt by."""
    x = ((h & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 + (level + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = (x * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (x >> 40) % FAN_OUT


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for start in range(0, b.num_rows, FLUSH_ROWS):
            part = b.slice(start, FLUSH_ROWS)
            yield from zip(*[part.column(c).to_pylist() for c in ("h", "body", "id", "n", "payload", "size")], strict=True)


def _fold(table_bytes: int, schema: pa.Schema):
    """Map side: equal texts of a task become one record; the table is emptied when it is full."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ContentTable()
        for row in _rows(batches):
            t.add(*row)
            if t.bytes > table_bytes:
                yield from _emit(t, range(len(t)), schema, None)
                t = ContentTable()
        yield from _emit(t, range(len(t)), schema, None)

    return fold


def _build(level: int, table_bytes: int, schema: pa.Schema):
    """Reduce side: the table of one bucket; sub-buckets that do not fit leave as unfinished records."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, resident = ContentTable(), FAN_OUT
        late = ContentTable()
        for row in _rows(batches):
            if resident < FAN_OUT and sub_bucket(row[0], level) >= resident:
                late.add(*row)
                if late.bytes > table_bytes // 4:
                    yield from _emit(late, range(len(late)), schema, False)
                    late = ContentTable()
                continue
            t.add(*row)
            while t.bytes > table_bytes and resident > 1 and level < LAST_LEVEL:
                resident -= 1
                out = t.remove(lambda h, r=resident: sub_bucket(h, level) >= r)
                yield from _emit(t, out, schema, False)
                t.drop(out)
        yield from _emit(late, range(len(late)), schema, False)
        yield from _emit(t, range(len(t)), schema, True)

    return build


def _emit(t: ContentTable, entries: Any, schema: pa.Schema, done: bool | None) -> Iterator[pa.RecordBatch]:
    entries = list(entries)
    for start in range(0, len(entries), FLUSH_ROWS):
        part = entries[start : start + FLUSH_ROWS]
        columns = {
            "h": [t.hashes[e] for e in part],
            "body": [t.texts[e] for e in part],
            "id": [t.ids[e] for e in part],
            "n": [t.counts[e] for e in part],
            "payload": [t.payloads[e] for e in part],
            "size": [t.sizes[e] for e in part],
            "done": [done] * len(part),
        }
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def content_classes(docs: DataFrame, id_col: str, text_col: str, payload: Column | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: ``h``, ``body``, ``id`` (the largest), ``n``, ``payload`` of the row with that id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    text = whole_text(text_col)
    records = docs.select(
        F.xxhash64(text).alias("h"), text.alias("body"), F.col(id_col).alias("id"), F.lit(1).cast("long").alias("n"),
        (F.lit(None).cast("int") if payload is None else payload).alias("payload"), (F.octet_length(text) + 64).cast("long").alias("size"),
    )
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in records.schema] + [T.StructField("done", T.BooleanType())])
    arrow = to_arrow_schema(out)
    records = records.mapInArrow(_fold(table_bytes, arrow), out)
    finished, level = [], 0
    while True:
        dealt = records.repartition(partitions(docs.sparkSession), F.xxhash64(F.lit(level), F.col("h")))
        stored = written(dealt.mapInArrow(_build(level, table_bytes, arrow), out), f"grace{level}")
        finished.append(stored.where("done"))
        records = stored.where("NOT done")
        if records.limit(1).count() == 0:
            break
        level += 1
    classes = finished[0]
    for more in finished[1:]:
        classes = classes.unionByName(more)
    return classes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    text = whole_text(text_col)
    classes = content_classes(docs, id_col, text_col, table_bytes=table_bytes).select(
        F.sha2("body", 256).alias("class_sha"), F.col("h").alias("class_h"), F.octet_length("body").alias("class_len"),
        F.col("id").alias("keep_id"), F.col("n").alias("group_size"),
    )
    rows = (
        docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("len"))
        .groupBy("id", "text_sha256", "h", "len").agg(F.count(F.lit(1)).alias("copies"))
    )
    joined = rows.join(classes, (F.col("text_sha256") == F.col("class_sha")) & (F.col("h") == F.col("class_h")) & (F.col("len") == F.col("class_len")))
    return joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns: the winning row travels through the tables as a payload."""
    others = [c for c in docs.columns if c != text_col]
    null_text = fresh(docs, "text_is_null")
    payload = F.struct(*[F.col(c) for c in others], F.col(text_col).isNull().alias(null_text))
    kept = content_classes(docs, id_col, text_col, payload, table_bytes)
    body = F.when(F.col(f"payload.{null_text}"), F.lit(None)).otherwise(F.col("body"))
    return kept.select(*[body.cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("payload").getField(c).alias(c) for c in docs.columns])
