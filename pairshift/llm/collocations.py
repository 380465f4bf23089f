"""Phrase collocations by top-order marginalisation: only the longest windows are counted, ROLLUP gives all shorter ones.

Every word position yields one window: the word and its leading words up to ``max_words``, padded with null after the
end of its piece. A phrase occurs where it is a prefix of a window, so ``GROUP BY lang, ROLLUP (w1, ..., w5)`` over the
counted windows sums all phrases of all lengths at once, single words and the language's total included; no order is
exploded on its own.

1. *Padding at rare grams.* A phrase is no more frequent than any pair or triple of neighbours in it. Pairs, and then
   the triples made of frequent pairs, are counted by 64-bit fingerprint; the frequent ones set bits in a map of fixed
   size each (``map_bits``; the maps are all that is broadcast), and a window is padded from the first pair or triple
   on whose bit is not set. A map has no false negatives, so counts of frequent phrases stay exact whatever its fill;
   a fuller map only pads less.
2. *Windows.* Tasks fold equal windows (compared as words, not as fingerprints) before the shuffle. A window padded
   after its first word counts that word and nothing longer, so those join ROLLUP's single words afterwards.
3. *Scores.* ``floor(1000 * a * n / (l * r))`` in exact decimals for each cut; the lowest cut counts. Both parts of a
   cut are at least as frequent as the phrase, so the table of frequent phrases has them.
4. *Nested phrases.* Each candidate offers its count to all phrases inside it; a candidate that a longer one reaches
   with ``100 * f(longer) >= nested_percent * a`` goes.

Words are compared after lower-casing A-Z only. Edge cases: null and empty texts have no words; a null language is
``und``, together with rows whose language is ``und``; repeated rows count each; ties in score go by count, then by
the phrase's bytes; a text of any length is read whole, in lots cut at piece ends (one piece stays in one lot); an
empty table gives an empty table; ids and other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import whole_text, written
from pairshift.llm.suffix_dedup import Fingerprints

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
MAP_BITS = 25
PAD_ORDERS = (2, 3)
LOT = 1 << 20
HELD = 1 << 18
STRIPS = 64
_BLOCK = 16
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: 0: part of a word, 1: blank between words, 2: end of a piece.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


def _lots(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, bytes) in lots of about ``LOT``; documents are joined by a line feed, which ends a piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for i in range(batch.num_rows):
        lang, raw = batch.column("lang")[i].as_py(), batch.column("body")[i].as_py().encode().lower()
        at = 0
        while at < len(raw):
            end = at + LOT
            if end < len(raw):  # on to the end of a piece
                stop = _END.search(raw, end)
                end = stop.start() if stop else len(raw)
            held.setdefault(lang, []).append(raw[at:end])
            size[lang] = size.get(lang, 0) + min(end, len(raw)) - at
            at = end
            if size[lang] >= LOT:
                yield lang, b"\n".join(held.pop(lang))
                size[lang] = 0
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


class Words:
    """The words of a lot: ``code`` of each, whether the next one ``follows`` in the same piece, and the ``names`` of codes."""

    def __init__(self, raw: bytes) -> None:
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = _CLASS[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)]))
        starts, ends = edges[::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else starts
        self.follows = np.r_[piece[1:] == piece[:-1], np.zeros(min(len(piece), 1), dtype=bool)]
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())).dictionary_encode()
        self.code, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def grams(self, lang: str, order: int) -> np.ndarray:
        """A fingerprint of each word with the ``order - 1`` next ones; meaningless where the piece ends before."""
        if not len(self.code):
            return np.zeros(0, dtype=np.uint64)
        offsets, data = (np.frombuffer(b, dtype=t) for b, t in zip(self.names.buffers()[1:], (np.int32, np.uint8), strict=True))
        at = offsets[: len(self.names) + 1].astype(np.int64)
        word = Fingerprints(data[: at[-1]]).of(at[:-1], np.diff(at))[self.code]
        x = np.full(len(word), crc32(lang.encode()) + (order << 32), dtype=np.uint64) * _M[1]
        for j in range(order):
            x = (x ^ _shift(word, j)) * _M[j % 2]
            x ^= x >> np.uint64(29)
        return x


def _shift(a: np.ndarray, k: int) -> np.ndarray:
    """Each place gets the value ``k`` places on; zero beyond the end."""
    return np.r_[a[k:], np.zeros(min(k, len(a)), dtype=a.dtype)] if k else a


def lengths(words: Words, lang: str, maps: list[tuple[int, np.ndarray]], max_words: int, map_bits: int) -> np.ndarray:
    """Words of the window at each place: up to the end of the piece, or to the first gram that no map has."""
    known = {}
    for order, mask in maps:
        known[order] = in_map(mask, words.grams(lang, order), map_bits)
    on, length = np.ones(len(words.code), dtype=bool), np.ones(len(words.code), dtype=np.int64)
    for m in range(2, max_words + 1):
        on = on & _shift(words.follows, m - 2)
        for order, ok in known.items():
            if order <= m:
                on &= _shift(ok, m - order)
        length += on
    return length


def _gram_counts(order: int, maps: list, map_bits: int):
    """Fingerprints of the grams whose shorter parts are all in the maps, with their counts, folded over lots."""
    def rows(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(k, np.frombuffer(m.value, dtype=np.uint8)) for k, m in maps]
        keys: list[np.ndarray] = []
        for b in batches:
            for lang, raw in _lots(b):
                words = Words(raw)
                keys.append(words.grams(lang, order)[lengths(words, lang, masks, order, map_bits) == order])
                if sum(map(len, keys)) > 4 * HELD:
                    yield rows(keys)
                    keys = []
        if keys:
            yield rows(keys)

    return run


def key_map(keys: DataFrame, map_bits: int) -> bytes:
    """A map of ``1 << map_bits`` bits, set by the upper bits of the 64-bit fingerprints in column ``key``."""
    slot = F.shiftrightunsigned("key", 64 - map_bits)
    blocks = keys.select(F.shiftright(slot, _BLOCK).cast("int").alias("block"), slot.bitwiseAND((1 << _BLOCK) - 1).cast("int").alias("at"))
    found = blocks.groupBy("block").agg(F.collect_set("at").alias("at"))  # at most 2**16 places each

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column("at"):
                mark = np.zeros(1 << _BLOCK, dtype=np.uint8)
                mark[places.values.to_numpy()] = 1
                out.append(np.packbits(mark, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], names=["block", "bits"])

    whole = np.zeros((1 << map_bits - _BLOCK, (1 << _BLOCK) // 8), dtype=np.uint8)
    for r in found.mapInArrow(bits, "block int, bits binary").collect():  # at most 1 << map_bits bits
        whole[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return whole.tobytes()


def in_map(mask: np.ndarray, keys: np.ndarray, map_bits: int) -> np.ndarray:
    slot = (keys >> np.uint64(64 - map_bits)).astype(np.int64)
    return ((mask[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def frequent_grams(texts: DataFrame, order: int, maps: list, min_count: int, map_bits: int) -> bytes:
    """The map of all grams of so many words that occur ``min_count`` times."""
    grams = texts.mapInArrow(_gram_counts(order, maps, map_bits), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return key_map(grams.where(F.col("n") >= min_count).select(F.col("gram").alias("key")), map_bits)


def window_counts(words: Words, length: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Distinct windows (joined by a space) with their counts; ``length``: the words of each window."""
    names = words.names.to_pylist()
    n = np.bincount(words.code[length == 1], minlength=len(names))
    at = np.flatnonzero(n)
    yield [names[i] for i in at], n[at]
    start = np.flatnonzero(length > 1)
    if not len(start):
        return
    name, size = words.code[start], length[start]
    for j in range(1, int(size.max())):
        lead = np.where(size > j, words.code[np.minimum(start + j, len(length) - 1)] + 1, 0)
        _, first, name, n = np.unique(name * (len(names) + 1) + lead, return_index=True, return_inverse=True, return_counts=True)
    code = words.code.tolist()
    yield [" ".join([names[c] for c in code[i : i + k]]) for i, k in zip(start[first].tolist(), size[first].tolist(), strict=True)], n


def _windows(maps: list, max_words: int, map_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(k, np.frombuffer(m.value, dtype=np.uint8)) for k, m in maps]
        held: dict[str, dict[str, int]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "words", "n"])

        for b in batches:
            for lang, raw in _lots(b):
                words = Words(raw)
                mine = held.setdefault(lang, {})
                for names, n in window_counts(words, lengths(words, lang, masks, max_words, map_bits)):
                    for k, v in zip(names, n.tolist(), strict=True):
                        mine[k] = mine.get(k, 0) + v
                if sum(map(len, held.values())) > HELD:
                    yield from rows()
                    held.clear()
        yield from rows()

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  map_bits: int = MAP_BITS) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f``: all phrases of 1 to ``max_words`` words with ``f >= min_count``, and each language's total as ``k = 0``."""
    if not (2 <= max_words and 16 <= map_bits <= 36 and min_count >= 1):
        raise ValueError("max_words from 2, map_bits from 16 to 36, min_count from 1")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("body"))
    maps: list = []
    for order in PAD_ORDERS:
        if order <= max_words:
            maps.append((order, spark.sparkContext.broadcast(frequent_grams(texts, order, maps, min_count, map_bits))))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.StringType()), T.StructField("n", T.LongType())])
    windows = written(texts.mapInArrow(_windows(maps, max_words, map_bits), schema), "windows")
    alone = F.instr("words", " ") == 0  # padded after its first word: a count of that word and of nothing longer
    names = [f"w{i + 1}" for i in range(max_words)]
    leads = windows.where(~alone).select("lang", "n", F.split("words", " ").alias("ws")).select(
        "lang", "n", *[F.get("ws", F.lit(i)).alias(w) for i, w in enumerate(names)])
    rolled = spark.sql(f"SELECT lang, {', '.join(names)}, {max_words} - bit_count(grouping_id()) AS k, sum(n) AS f "
                       f"FROM {{leads}} GROUP BY lang, ROLLUP ({', '.join(names)})", leads=leads)
    last = F.get(F.array(*names), (F.col("k") - 1).cast("int"))  # a padded place ends no phrase
    rolled = rolled.where((F.col("k") == 1) | ((F.col("k") >= 2) & last.isNotNull() & (F.col("f") >= min_count)))
    rolled = written(rolled.select("lang", F.col("k").cast("int").alias("k"), F.concat_ws(" ", *names).alias("phrase"), "f"), "rolled")
    ones = rolled.where("k = 1").select("lang", "phrase", "f").unionByName(windows.where(alone).select("lang", F.col("words").alias("phrase"), F.col("n").alias("f")))
    ones = ones.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    totals = windows.groupBy("lang").agg(F.sum("n").alias("f"))
    return rolled.where("k >= 2").unionByName(ones.withColumn("k", F.lit(1))).unionByName(
        totals.withColumn("k", F.lit(0)).withColumn("phrase", F.lit("")))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int = TOP, nested_percent: int = 100, map_bits: int = MAP_BITS) -> DataFrame:
    """Per language the first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``cut``."""
    counts = written(phrase_counts(docs, lang_col, text_col, min_count, max_words, map_bits), "phrases")
    totals = written(counts.where("k = 0").select(F.col("lang").alias("total_lang"), F.col("f").alias("n")), "totals")
    found = counts.where("k >= 2")
    words = F.split("phrase", " ")
    part = lambda start, size: F.concat_ws(" ", F.slice("ws", start, size))

    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> concat_ws(' ', slice(ws, s, m)))))")
    longer = found.where("k >= 3").withColumn("ws", words).select("lang", "f", F.explode(inner).alias("inside"))
    longer = longer.groupBy(F.col("lang").alias("in_lang"), "inside").agg(F.max("f").alias("longer"))
    left_out = found.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inside"))).where(
        F.col("longer").cast("decimal(38,0)") * 100 >= F.col("f").cast("decimal(38,0)") * nested_percent).select("lang", "phrase")
    kept = found.join(left_out, ["lang", "phrase"], "left_anti")

    cuts = kept.withColumn("ws", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = counts.where("k >= 1")
    one = known.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    two = known.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    cuts = cuts.join(one, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase")))
    cuts = cuts.join(two, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    cuts = cuts.join(totals, F.col("lang") == F.col("total_lang"))
    exact = "cast(1000 AS decimal(4,0)) * cast(a AS decimal(17,0)) * cast(n AS decimal(17,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    scored = lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score", F.col("m.cut").alias("cut"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    strip = F.pmod(F.xxhash64("phrase"), F.lit(STRIPS))
    first = scored.withColumn("strip", strip).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "strip").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
