"""Language identification by prediction by partial matching over bytes.

Per language a context tree of up to ``ORDER`` bytes is frozen from all training rows: Spark counts the strings of
``order + 1`` bytes, and lower orders are marginal sums of those. A symbol s after a context c costs
``-log2 p(s | c)`` bits with escape method C and exact exclusion: with T occurrences and D different symbols after c,
``p(s | c) = n(c, s) / (T + D)`` for a symbol that the tree has there; the rest of the mass escapes to the context
without its first byte, shared among the symbols that c does not have; below order 0 all 256 bytes are alike. That is
a proper distribution at every context, so the sum over a text is its exact code length. The language with the
shortest code wins; the score is its posterior probability, all languages being equally likely beforehand.

*Frozen size.* A tree keeps a string when it makes up at least ``languages / nodes`` of its language's bytes, so no
order keeps more than ``nodes`` strings, however much was counted; what is not kept adds to the escape. Those strings
are all that is collected and broadcast (``nodes`` rows of one float per language and order at most).

Edge cases: ``und`` with score 0 for null text, text without a letter, and where there is nothing to learn from; rows
without language or id are not learned from; ties go to the smallest language; a null id is in no fold
(``held_out`` false) and is predicted; repeated rows count each; texts are read whole in any length (in lots, with
the context carried over a cut); the bytes before a text count as line feeds; empty tables give empty tables; other
columns do not matter, and language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import whole_text, written

ORDER = 3
NODES = 1 << 18
LOT = 1 << 20
HELD = 1 << 20
_HASH = np.uint32(0x9E3779B1)


def grams(parts: list[tuple[bytes, bytes]], order: int) -> np.ndarray:
    """Each byte of the parts with the ``order`` bytes before it, packed; a part is (bytes before, bytes)."""
    data = np.frombuffer(b"".join(x for part in parts for x in part), dtype=np.uint8)
    size = np.array([len(x) for _, x in parts])
    packed = data.astype(np.uint32)
    for j in range(1, order + 1):
        packed[j:] |= data[:-j].astype(np.uint32) << np.uint32(8 * j)
    start = np.cumsum(size + order) - size
    return packed[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def _pieces(texts: list[str], order: int, lot: int) -> Iterator[list[tuple[int, tuple[bytes, bytes]]]]:
    """(row, (bytes before, bytes)) in lots of about ``lot`` bytes."""
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = b"\n" * order + text.encode()
        for at in range(order, len(raw), lot):
            held.append((row, (raw[at - order : at], raw[at : at + lot])))
            size += len(held[-1][1][1])
            if size >= lot:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (key, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for b in batches:
            langs = np.array(b.column("lang").to_pylist())
            for lang in np.unique(langs).tolist():
                texts = b.column("body").take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
                for lot in _pieces(texts, order, LOT):
                    key, n = np.unique(grams([x for _, x in lot], order), return_counts=True)
                    if lang in held:
                        key, at = np.unique(np.concatenate([held[lang][0], key]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = key, n
                if sum(len(key) for key, _ in held.values()) > HELD:
                    yield from rows()
                    held.clear()
        yield from rows()

    return run


def frozen_counts(docs: DataFrame, lang_col: str, text_col: str, order: int, nodes: int) -> DataFrame:
    """``lang``, ``k`` (order), ``gram`` (context and symbol, packed), ``n``, and the context's ``total`` and ``symbols``: what the trees keep."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("body"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    top = written(rows.mapInArrow(_count(order), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = top.groupBy("lang").agg(F.sum("n").alias("bytes")).withColumn("langs", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    levels = None
    for k in range(order, -1, -1):
        level = top.groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n")).withColumn("k", F.lit(k))
        levels = level if levels is None else levels.unionByName(level)
    context = Window.partitionBy("lang", "k", F.shiftright("gram", 8))  # at most 256 symbols
    levels = levels.withColumn("total", F.sum("n").over(context)).withColumn("symbols", F.count(F.lit(1)).over(context))
    return levels.join(written(sizes, "sizes"), "lang").where(F.col("n") * nodes >= F.col("bytes") * F.col("langs")).select("lang", "k", "gram", "n", "total", "symbols")


class Places:
    """From packed strings to row numbers: an open-addressing table, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.at, self.keys, self.probes = np.full(1 << bits, len(keys), dtype=np.int32), np.r_[keys.astype(np.uint32), np.uint32(0)], 0
        left = np.arange(len(keys))
        while len(left):
            slot = (self._slot(self.keys[left]) + self.probes) & self.mask
            free = self.at[slot] == len(keys)
            self.at[slot[free]] = left[free]  # of several for one slot, the last stays
            left = left[self.at[slot] != left]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; the number of rows where there is none."""
        n = len(self.keys) - 1
        if not n or not len(keys):
            return np.full(len(keys), n, dtype=np.int64)
        slot = self._slot(keys)
        row = self.at[slot].astype(np.int64)
        todo = np.flatnonzero((self.keys[row] != keys) & (row < n))
        out = np.where((row < n) & (self.keys[row] == keys), row, n)
        for step in range(1, self.probes):
            if not len(todo):
                break
            row = self.at[(slot[todo] + step) & self.mask]
            hit = (row < n) & (self.keys[row] == keys[todo])
            out[todo[hit]] = row[hit]
            todo = todo[~hit & (row < n)]
        return out


class Model:
    """Frozen trees of all languages: bits of a symbol per language, with the escapes down to it."""

    def __init__(self, order: int, rows: list[tuple[str, int, int, int, int, int]]) -> None:
        self.order, self.langs = order, sorted({r[0] for r in rows})
        index = {lang: i for i, lang in enumerate(self.langs)}
        lang, k, gram, n, total, symbols = (np.array([index[r[0]] for r in rows], dtype=np.int64), *[np.array([r[i] for r in rows], dtype=np.int64) for i in range(1, 6)])
        width = len(self.langs)
        self.levels: list[tuple[Places, np.ndarray, Places, np.ndarray]] = []
        for level in range(order + 1):
            here = k == level
            key, at = np.unique(gram[here], return_inverse=True)
            context, parent = np.unique(key >> 8, return_inverse=True)
            p = np.zeros((len(key), width))
            p[at, lang[here]] = n[here] / (total[here] + symbols[here])
            lower = 2.0 ** -self._bits(key & ((1 << 8 * level) - 1), level - 1)
            has = p > 0
            used, below = np.zeros((len(context), width)), np.zeros((len(context), width))
            np.add.at(used, parent, p)
            np.add.at(below, parent, np.where(has, lower, 0))
            known = used > 0  # a tree without the context goes on below at no cost
            escape = np.where(known, np.log2(np.maximum(1 - below, 1e-12)) - np.log2(np.maximum(1 - used, 1e-12)), 0)
            bits = np.where(has, -np.log2(np.where(has, p, 1)), escape[parent] - np.log2(lower))
            none = np.zeros((1, width))
            self.levels.append((Places(key), np.r_[bits, none].astype(np.float32), Places(context), np.r_[escape, none].astype(np.float32)))

    def _bits(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Bits per language of packed strings of ``level + 1`` bytes."""
        if level < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        places, bits, contexts, escape = self.levels[level]
        at = places.find(keys.astype(np.uint32))
        out = bits[at]
        missed = np.flatnonzero(at == len(bits) - 1)
        if len(missed):
            rest = keys[missed]
            step = escape[contexts.find((rest >> 8).astype(np.uint32))]
            out[missed] = step + self._bits(rest & ((1 << 8 * level) - 1), level - 1)
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for lot in _pieces(texts, self.order, max(1024, LOT * 4 // max(4, len(self.langs)))):
            size = np.array([len(x[1]) for _, x in lot])
            bits = self._bits(grams([x for _, x in lot], self.order), self.order)
            np.add.at(out, [row for row, _ in lot], np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        length = self.code_lengths(texts)
        best = length.argmin(axis=1)
        odds = np.exp2(np.maximum(length[np.arange(len(texts)), best][:, None] - length, -1000.0))
        return [self.langs[i] for i in best], 1 / odds.sum(axis=1)


def fold(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", order: int = ORDER, nodes: int = NODES) -> Model:
    """Trees of all languages, from the rows whose fold is not 2."""
    if not 0 <= order <= 3:
        raise ValueError("strings of order + 1 bytes are packed in 32 bits")
    kept = frozen_counts(docs.where(fold(F.col(id_col)) != 2), lang_col, text_col, order, nodes)
    return Model(order, [tuple(r) for r in kept.collect()])  # at most ``nodes`` rows an order


def predicted_languages(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", order: int = ORDER, nodes: int = NODES) -> DataFrame:
    """Per row: the id column, ``held_out``, ``lang_pred`` and ``score``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, lang_col, text_col, order, nodes))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                lang, score = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows)
                at = np.flatnonzero(b.column("letters").to_numpy(zero_copy_only=False)) if trees.langs else []
                if len(at):
                    lang[at], score[at] = trees.predict(b.column("body").take(pa.array(at)).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(F.col(id_col).alias("id"), letters.alias("letters"), whole_text(text_col).alias("body")).mapInArrow(run, out)
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
