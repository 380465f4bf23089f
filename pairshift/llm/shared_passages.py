"""Passages of at least so many words that stand in more than one document.

Words are runs outside space, tab, LF, VT, FF, CR. A window is ``words`` neighbouring words of one text; its anchor is the
least fingerprint of ``gram`` neighbouring words in it. Equal windows have equal anchors, so rows that share a passage of
``words`` words share an anchor, and rows that share an anchor share ``gram`` words in a row. A row's figure is the number
of its different anchors that another row has too.

1. Anchors with the number of rows that have them, folded per lot; those of two rows or more set bits in a map of fixed
   size, the only thing broadcast. It drops anchors that no other row can have, and never one that another has.
2. The other anchors are counted again by rows, exactly, and meet their rows.

Equality rests on 64-bit fingerprints. Edge cases: null and empty texts, and those with fewer words, have no window;
repeated rows count as rows, so they share all they hold; a null id is a value like any other; texts are read whole in
any length; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.collocations import in_map, key_map
from pairshift.llm.common import SPACE, whole_text, written
from pairshift.llm.suffix_dedup import _POWERS, Fingerprints, _mix, sliding_least

GRAM = 40
MAP_BITS = 25
LOT = 1 << 20
_BLANK = np.isin(np.arange(256), list(SPACE.encode()))


def _of_neighbours(h: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of each place with the ``n - 1`` next ones."""
    up, down = _POWERS.get(len(h) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
    return _mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def anchors(texts: list[bytes], words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of a text and one of its anchors, each pair once."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)]))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    least = sliding_least(_of_neighbours(Fingerprints(data).of(starts, ends - starts), gram), words - gram + 1)
    whole = owner[words - 1 :] == owner[: len(owner) - words + 1]
    whole[1:] &= (least[1:] != least[:-1]) | (owner[1 : len(whole)] != owner[: len(whole) - 1]) | ~whole[:-1]
    owner, least = owner[: len(whole)][whole], least[whole]
    once = np.unique(_mix(least ^ _mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return owner[once], least[once]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        start, size, texts = 0, 0, []
        for i, text in enumerate(b.column("body")):
            texts.append(text.as_py().encode())
            size += len(texts[-1])
            if size >= LOT or i + 1 == b.num_rows:
                yield b.slice(start, len(texts)), texts
                start, size, texts = i + 1, 0, []


def shared_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51, gram: int = GRAM, map_bits: int = MAP_BITS) -> DataFrame:
    """``id``, ``text_key``, ``n_shared`` of the rows that share an anchor with another row."""
    if not 1 <= gram <= words:
        raise ValueError("a gram has from 1 word to those of the window")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text_key"), whole_text(text_col).alias("body"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _lots(batches):
            key, n = np.unique(anchors(texts, words, gram)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    often = rows.select("body").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(key_map(often.select("key"), map_bits))
    found = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("text_key", "key")]])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(shared.value, dtype=np.uint8)
        for b, texts in _lots(batches):
            owner, key = anchors(texts, words, gram)
            may = in_map(mask, key, map_bits)
            at = pa.array(owner[may])
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("text_key").take(at), pa.array(key[may].view(np.int64))], names=found.names)

    held = written(rows.mapInArrow(candidates, found), "anchors")
    twice = held.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("key").alias("shared_key"))
    return held.join(twice, F.col("key") == F.col("shared_key")).groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n_shared"))
