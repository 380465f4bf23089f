"""Token packing by best-two-fit.

Documents become token ids (vocabulary file given as a parameter) followed by one separator id; only longer ones
are cut, into pieces of ``capacity`` ids. The narrow piece rows are written once, dealt evenly to packing groups of
about ``group_pieces`` pieces, and each group is packed on its own: a bin is filled greedily with the longest piece
that fits; then its smallest piece is replaced by the two unpacked pieces whose sum fits the expanded gap most
tightly, as long as that leaves less room. A group wastes at most a small part of its last bins.

Tokenising works on runs between ASCII white space, which this kind of vocabulary never joins; the ids of a run are
remembered in a bounded table, so a word is encoded once per worker as long as it stays there.

Edge cases: null and empty texts are one piece that holds the separator alone; repeated rows and null ids are packed
like any other row; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import whole_text, written

CAPACITY = 4096
SEPARATOR = 1
GROUP_PIECES = 20_000
KNOWN_RUNS = 600_000
STOPS = ".,;:!?"
LATIN_END = "\u0180"  # the letters before it are in composed form already, and fall to small letters one by one
DOTTED_I = "\u0130"  # but for this one
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order.
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
ROWS = 256

_encoders: dict[str, RunEncoder] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class RunEncoder:
    """Text to little-endian unsigned 32-bit ids, through bounded tables of runs and of stems.

    The vocabulary's rules cut between a letter and the stop signs after it and do not tell capitals from small
    letters, so a run of plain Latin letters is its small-letter stem and its stops, and only new stems are encoded.
    Such a stem is one word to the rules already, so the merges alone are run on it; other runs go the whole way.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.runs: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    @staticmethod
    def parts(run: bytes) -> tuple[bytes, bytes]:
        """Stem and stops; runs to which the rule does not apply are a stem as they are."""
        text = run.decode()
        stem = text.rstrip(STOPS)
        if stem.isalpha() and max(stem) < LATIN_END and DOTTED_I not in stem:
            return stem.lower().encode(), text[len(stem) :].encode()
        return run, b""

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            runs = text.encode().split()
            found = list(map(self.runs.get, runs))
            if None in found:
                missing = [i for i, ids in enumerate(found) if ids is None]
                new = list({runs[i] for i in missing})
                if len(self.runs) + len(new) > KNOWN_RUNS:
                    self.runs.clear()
                self._learn(new)
                for i in missing:
                    found[i] = self.runs[runs[i]]
            yield b"".join(found)

    def _learn(self, runs: list[bytes]) -> None:
        for start in range(0, len(runs), 4096):
            split = [self.parts(r) for r in runs[start : start + 4096]]
            stems = list({p for two in split for p in two if p}.difference(self.stems))
            if len(self.stems) + len(stems) > KNOWN_RUNS:
                self.stems.clear()
                stems = list({p for two in split for p in two if p})
            words, others = [], []
            for stem in stems:
                text = stem.decode()
                (words if text.isalpha() and text == text.lower() and max(text) < LATIN_END else others).append(stem)
            merges = self.tokenizer.model.tokenize
            self.stems.update((w, _packed([t.id for t in merges(w.decode("latin-1").translate(BYTE_SIGNS))])) for w in words)
            if others:
                encoded = self.tokenizer.encode_batch_fast([o.decode() for o in others], add_special_tokens=False)
                self.stems.update((o, _packed(e.ids)) for o, e in zip(others, encoded, strict=True))
            known = self.stems
            known[b""] = b""
            self.runs.update((r, known[a] + known[b]) for r, (a, b) in zip(runs[start : start + 4096], split, strict=True))


def encoder(vocabulary: str) -> RunEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = RunEncoder(vocabulary)
    return _encoders[vocabulary]


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece; with ``keep_ids`` also ``ids`` (binary)."""
    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        out = out.add("ids", "binary")
    end = _packed([separator])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                b = batch.slice(first, ROWS)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(enc.encode(b.column("body").to_pylist())):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                arrays = [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                          pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.binary())] if keep_ids else []), names=out.names)

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).mapInArrow(cut, out)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers; every length is between 1 and ``capacity``."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        waiting[int(lengths[i])].append(i)
    left = np.zeros(capacity + 1, dtype=np.int64)
    present = 0
    for size, rows in waiting.items():
        left[size] = len(rows)
        present |= 1 << size
    bins = []

    def take(size: int) -> int:
        nonlocal present
        left[size] -= 1
        if not left[size]:
            present &= ~(1 << size)
        return waiting[size].pop()

    def put_back(size: int, row: int) -> None:
        nonlocal present
        left[size] += 1
        present |= 1 << size
        waiting[size].append(row)

    while present:
        room, inside = capacity, []
        while fits := present & ((1 << (room + 1)) - 1):
            size = fits.bit_length() - 1
            inside.append((size, take(size)))
            room -= size
        while room and len(inside) > 1:
            size, row = inside[-1]  # the smallest: sizes only fall
            pair = _two(left, room + size, size)
            if pair is None:
                break
            inside.pop()
            put_back(size, row)
            inside.extend((s, take(s)) for s in pair)
            inside.sort(reverse=True)
            room += size - sum(pair)
        bins.append([row for _, row in inside])
    return bins


def _two(left: np.ndarray, gap: int, smallest: int) -> tuple[int, int] | None:
    """The two waiting sizes with the largest sum over ``smallest`` and up to ``gap``; None where there are none."""
    sizes = np.flatnonzero(left[: gap + 1])
    if not len(sizes):
        return None
    most = np.minimum(gap - sizes, np.where(left[sizes] > 1, sizes, sizes - 1))  # the second is no larger than the first
    second = np.searchsorted(sizes, most, side="right") - 1
    sums = np.where(second >= 0, sizes + sizes[second], 0)
    best = int(sums.argmax())
    return (int(sizes[best]), int(sizes[second[best]])) if sums[best] > smallest else None


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``length``, and no column is read besides."""
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        lengths = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        base = TaskContext.get().partitionId() << 32
        for k, members in enumerate(best_two_fit(lengths, capacity)):
            sequence[members] = base + k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    groups = max(1, -(-pieces.count() // group_pieces))
    return pieces.repartition(groups).mapInArrow(run, out)


def best_fit_packing(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, separator: int = SEPARATOR, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece: the id column, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = written(token_pieces(docs, vocabulary, id_col, text_col, capacity, separator), "pieces")
    packed = pack(pieces, capacity, group_pieces)
    return packed.select(F.col("id").alias(id_col), *[c for c in packed.columns if c != "id"])
