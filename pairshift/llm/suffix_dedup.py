"""Suffix-array deduplication by prefix doubling over sampled positions.

Every byte covered by a string of ``length`` bytes that also starts anywhere else (same document included) goes.

A suffix array of all positions would be sorted nine times; instead the positions that matter are reached through
anchors. The anchor of a position p is the least 32-byte gram among the ``window`` positions from p on, so it
depends on the string at p alone, equal strings have their anchors at the same place, and neighbouring positions
share one. Positions with one anchor form a range.

1. *Doubling.* A range's first rank is that of the ``gram`` bytes at its anchor. In each round its rank is paired
   with that of as many next bytes (the last time: up to all that its strings surely share), Spark counts and sorts
   the pairs, ranges whose pair is unique leave, and the pair's name is the rank of the next round. Ranks only have to
   be equal or not, so a name is a 64-bit fingerprint, not a place. The last round pairs the rank with that of the whole
   stretch that the range's strings cover: a range with an equal one elsewhere is repeated throughout. Pairs are
   counted in each task first and the rounds' joins may be split, equal stretches of one batch are folded before all
   rounds, and a rank that very many ranges share is dealt by its stretches in the last one.
2. *The rest.* Ranges that share the anchor's bytes but not the whole stretch sit at the edges of copied passages.
   They fetch their bytes, meet by rank, and are ranked position by position over the full ``length``. A rank that
   very many ranges share is dealt anew by the full-length fingerprint of each position, folded per batch first.
3. Repeated ranges are gathered per document and cut from its text.

Equality rests on 64-bit fingerprints. Edge cases: null and empty texts have no bytes; texts shorter than
``length`` lose nothing; repeated rows count as separate documents, so both lose what they share, all of it when
long enough; a null id is a value like any other; very long texts are handled in segments; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import partitions, removed, whole_text, written, written_at

LENGTH = 400
WINDOW = 256
GRAM = 32
SEGMENT = 1 << 20
HOT_RANK = 4096
ROWS = 512
#: A range in one long: its first position, then its anchor's and its last position's distance from it.
SPLIT = 1 << 10

_RNG = np.random.default_rng(0x5EED)
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 62)) * 2 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            steps = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)], dtype=np.uint64)
            self.up, self.down = steps(_BASE), steps(pow(_BASE, -1, 1 << 64))
        return self.up, self.down


_POWERS = Powers()


class Fingerprints:
    """64-bit fingerprints of any substring of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least key of each w neighbours."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, window: int, gram: int) -> dict[str, np.ndarray]:
    """Positions that begin a string of ``length`` bytes, as ranges [lo, hi] that share an anchor.

    ``data`` holds pieces [starts, ends) back to back, none shorter than ``length``.
    """
    prints = Fingerprints(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    keys = (prints.of(at, gram) & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    anchor = (sliding_least(keys, window) & np.uint64(0xFFFFFF)).astype(np.int64)
    counts = ends - starts - length + 1
    piece = np.repeat(np.arange(len(starts)), counts)
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[piece]
    a = anchor[p]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    return {"prints": prints, "piece": piece[first], "anchor": a[first], "lo": p[first], "hi": p[last]}


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in lots of about a segment; a long text is cut so that every position is in one piece."""
    lot, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            lot.append((row, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def doubling_steps(length: int, window: int, gram: int) -> list[int]:
    """Bytes at an anchor that the ranks cover round by round, from 0 to all that the strings of a range surely share."""
    sure, steps = length - window + 1, [0, gram]
    while steps[-1] < sure:
        steps.append(min(2 * steps[-1], sure))
    return steps if len(steps) > 2 else [0, gram // 2, gram]


def _rank(length: int, window: int, gram: int, names: list[str]):
    """Per range: the ranks of its steps, the document, the packed range and its state.

    State 0: to be judged; 1: known to be repeated; 2: known to be repeated, and stands for its equals in this batch.
    """
    steps = doubling_steps(length, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lots = []
            for lot in _pieces([t.encode() for t in b.column("body").to_pylist()], length):
                size = np.array([len(x[2]) for x in lot])
                ends = np.cumsum(size)
                starts = ends - size
                g = anchored_ranges(np.frombuffer(b"".join(x[2] for x in lot), dtype=np.uint8), starts, ends, length, window, gram)
                prints, a, lo, hi, piece = g["prints"], g["anchor"], g["lo"], g["hi"], g["piece"]
                shift = np.array([x[1] for x in lot])[piece] - starts[piece]
                whole = prints.of(lo, hi + length - lo) ^ _mix(((a - lo) * SPLIT + hi - lo).astype(np.uint64))
                lots.append((*[prints.of(a + x, y - x) for x, y in zip(steps, steps[1:])], whole, np.array([x[0] for x in lot])[piece],
                             ((lo + shift) * SPLIT + a - lo) * SPLIT + hi - lo))
            if not lots:
                continue
            *ranks, whole, row, packed = (np.concatenate(x) for x in zip(*lots, strict=True))
            _, first, which, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            state = np.where(times[which] > 1, 1, 0).astype(np.int8)
            state[first[times > 1]] = 2
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                *[pa.array(x.view(np.int64)) for x in (*ranks, whole)], pa.array(state),
                b.column("id").take(at), b.column("text_key").take(at), pa.array(packed)], names=names)

    return run


def _judge(names: list[str]):
    """Over rows sorted by rank and whole stretch: repeated ranges (weight 0), and the ranges that need single positions.

    Of those, an open range has weight 1, and one or two ranges of each repeated stretch with the same rank weight 2. A
    row looks at its neighbours only; the stretches of a hot rank lie in many tasks, and it is known to be shared.
    """
    def judged(t: pa.Table, before: tuple | None, after: tuple | None) -> Iterator[pa.RecordBatch]:
        rank, whole, state, hot = (t.column(c).to_numpy() for c in ("rank", "whole", "state", "hot"))
        prev_rank = np.r_[before is not None and before[0] == rank[0], rank[1:] == rank[:-1]]
        prev_whole = prev_rank & np.r_[before is not None and before[1] == whole[0], whole[1:] == whole[:-1]]
        next_rank = np.r_[rank[1:] == rank[:-1], after is not None and after[0] == rank[-1]]
        next_whole = next_rank & np.r_[whole[1:] == whole[:-1], after is not None and after[1] == whole[-1]]
        repeated = prev_whole | next_whole | (state == 2)
        stands = repeated & (((prev_rank | hot) & ~prev_whole) | ((next_rank | hot) & ~next_whole))
        is_open = ~repeated & (prev_rank | next_rank | hot)
        for rows, weight in ((repeated, 0), (is_open, 1), (stands, 2)):
            picked = t.filter(pa.array(rows)).select(["rank", "id", "text_key", "packed"])
            for b in picked.append_column("weight", pa.array(np.full(picked.num_rows, weight, dtype=np.int8))).rename_columns(names).to_batches():
                yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        ends = lambda x, i: (x.column("rank")[i].as_py(), x.column("whole")[i].as_py())
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                yield from judged(held, before, ends(t, 0))
                before = ends(held, held.num_rows - 1)
            held = t
        if held is not None:
            yield from judged(held, before, None)

    return run


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = packed // (SPLIT * SPLIT)
    return lo, lo + packed % SPLIT


def _positions(slices: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position of every slice: the slice's number, the place in it, the full-length fingerprint."""
    size = np.array([len(s) for s in slices])
    starts = np.cumsum(size) - size
    n = size - length + 1
    which = np.repeat(np.arange(len(slices)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, place, Fingerprints(np.frombuffer(b"".join(slices), dtype=np.uint8)).of(starts[which] + place, length)


def _runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring places of one row: row, first place, last place."""
    if not len(row):
        return row, place, place
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.r_[first[1:], len(row)] - 1
    return row[first], place[first], place[last]


def _single(length: int, names: list[str]):
    """Repeated positions of open ranges (kind 0), and positions of ranges with a hot rank (kind 1).

    Rows with one cold rank arrive together. Hot rows come in any order; equal strings of a lot are folded, so that
    one row with their total weight goes on, and ``open`` says whether its own position waits for the answer.
    """
    def rows(t: pa.Table, row: np.ndarray, kind: int, key: np.ndarray, total: np.ndarray, waits: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        picked = t.select(["id", "text_key"]).take(pa.array(row))
        out = pa.table([pa.array(np.full(len(row), kind, dtype=np.int8)), pa.array(key.view(np.int64)), pa.array(total.astype(np.int64)), pa.array(waits),
                        picked.column(0), picked.column(1), pa.array(lo), pa.array(hi)], names=names)
        return iter(out.combine_chunks().to_batches())

    def solved(t: pa.Table, hot: bool) -> Iterator[pa.RecordBatch]:
        rank, weight, lo = t.column("rank").to_numpy(), t.column("weight").to_numpy(), t.column("lo").to_numpy()
        which, place, key = _positions(t.column("bytes").to_pylist(), length)
        if not hot:
            key = key ^ _mix(rank.view(np.uint64)[which])
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=weight[which])
        often, mine = total[at] > 1, weight[which] == 1
        row, begin, end = _runs(*(x[often & mine] for x in (which, place)))
        blank = np.zeros(len(row), dtype=np.uint64)
        yield from rows(t, row, 0, blank, blank, blank > 0, lo[row] + begin, lo[row] + end)
        if hot:
            row, here = which[first], lo[which[first]] + place[first]
            yield from rows(t, row, 1, key[first], total, (mine & ~often)[first], here, here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            hot, t = t.filter(t.column("hot")), t.filter(pc.invert(t.column("hot")))
            for start in range(0, hot.num_rows, HOT_RANK):
                yield from solved(hot.slice(start, HOT_RANK), True)
            if not t.num_rows:
                continue
            held = t if held is None else pa.concat_tables([held, t])
            rank = held.column("rank").to_numpy()
            whole = int(np.flatnonzero(rank != rank[-1])[-1]) + 1 if rank[0] != rank[-1] else 0
            for part in _lots(held, rank, whole):
                yield from solved(part, False)
            held = held.slice(whole)
        if held is not None and held.num_rows:
            for part in _lots(held, held.column("rank").to_numpy(), held.num_rows):
                yield from solved(part, False)

    return run


def _lots(t: pa.Table, rank: np.ndarray, n: int) -> Iterator[pa.Table]:
    """The first n rows in lots of about ``2 * HOT_RANK`` rows that keep ranks whole."""
    start = 0
    while start < n:
        end = min(start + HOT_RANK, n)
        while end < n and rank[end] == rank[end - 1]:
            end += 1
        yield t.slice(start, end - start)
        start = end


def doubled(ranges: DataFrame, steps: int, path: str) -> tuple[DataFrame, str]:
    """The doubling rounds: of ``ranges``, those whose bytes up to the last step begin another range too, and their table's path.

    ``rank`` names these bytes and ``n`` is the number of ranges with that rank. Each round is a written table, so a lost
    executor repeats one round at most; a round's tables, at first ``path``, go when the next round is whole.
    """
    live = ranges.withColumnRenamed("step_0", "rank")
    for step in range(1, steps):
        later = [f"step_{i}" for i in range(step + 1, steps)]
        kept = [*later, "whole", "state", "id", "text_key", "packed"]
        paired = live.select(F.xxhash64("rank", f"step_{step}").alias("rank"), *kept)
        shared = paired.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("rank", "shared")
        shared, counts = written_at(shared, "shared")  # a plain join with it may be split on a hot rank
        done = path
        live, path = written_at(paired.join(shared, F.col("rank") == F.col("shared")).select("rank", "n", *kept), "ranks")
        removed(ranges.sparkSession, counts, done)
    return live, path


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, length: int, window: int, gram: int) -> DataFrame:
    """``id``, ``text_key``, ``lo``, ``hi``: positions at which a repeated string of ``length`` bytes starts."""
    parts = partitions(docs.sparkSession)
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    byte = lambda name: T.StructField(name, T.ByteType())
    texts = _texts(docs, id_col, text_col)

    steps = len(doubling_steps(length, window, gram)) - 1
    ranked = T.StructType([*long(*[f"step_{i}" for i in range(steps)], "whole"), byte("state"), id_field, *long("text_key", "packed")])
    ranges, path = written_at(texts.where(F.octet_length("body") >= length).mapInArrow(_rank(length, window, gram, ranked.names), ranked), "first_ranks")
    known = written(ranges.where("state > 0").select("id", "text_key", "packed"), "known")
    live, path = doubled(ranges.where("state <> 1"), steps, path)
    live = live.select("rank", "whole", "state", (F.col("n") > HOT_RANK).alias("hot"), "id", "text_key", "packed")
    dealt = live.repartition(parts, F.when(F.col("hot"), F.xxhash64("rank", "whole")).otherwise(F.col("rank"))).sortWithinPartitions("rank", "whole")
    told = T.StructType([*long("rank"), id_field, *long("text_key", "packed"), byte("weight")])
    judged = written(dealt.mapInArrow(_judge(told.names), told), "ranges")
    removed(docs.sparkSession, path)
    low = F.shiftright("packed", 20)  # SPLIT * SPLIT
    place = [low.alias("lo"), (low + F.col("packed").bitwiseAND(SPLIT - 1)).alias("hi")]
    judged = judged.select("rank", "id", "text_key", "weight", *place)
    repeated = judged.where("weight = 0").select("id", "text_key", "lo", "hi").unionByName(known.select("id", "text_key", *place))

    waiting = judged.where("weight > 0")
    hot = waiting.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_RANK).select(F.col("rank").alias("hot_rank"))
    hot = written(hot, "hot")  # a plain join with it may be split on a hot rank
    wanted = waiting.join(hot, F.col("rank") == F.col("hot_rank"), "left").select(
        "rank", F.col("hot_rank").isNotNull().alias("hot"), F.col("id").alias("of"), F.col("text_key").alias("of_key"), "weight", "lo", "hi")
    stretch = F.expr(f"substring(cast(body AS binary), cast(lo + 1 AS int), cast(hi - lo + {length} AS int))")
    cut = wanted.join(texts, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_key") == F.col("text_key"))).select(
        "rank", "hot", "id", "text_key", "weight", "lo", stretch.alias("bytes"))
    cut = cut.repartition(parts, F.when(F.col("hot"), F.xxhash64("id", "text_key", "lo")).otherwise(F.col("rank"))).sortWithinPartitions("hot", "rank")
    found = T.StructType([byte("kind"), *long("key", "total"), T.StructField("open", T.BooleanType()), id_field, *long("text_key", "lo", "hi")])
    single = written(cut.mapInArrow(_single(length, found.names), found), "positions")
    often = single.where("kind = 1").groupBy("key").agg(F.sum("total").alias("total")).where("total > 1").select(F.col("key").alias("often"))
    late = single.where("kind = 1 AND open").join(often, F.col("key") == F.col("often"), "left_semi")
    columns = ["id", "text_key", "lo", "hi"]
    return repeated.unionByName(single.where("kind = 0").select(columns)).unionByName(late.select(columns))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text_key"), whole_text(text_col).alias("body"))


def merged_spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs from packed (lo, hi) ranges of string starts."""
    spans: list[list[int]] = []
    for x in sorted(starts):
        lo = x >> 21
        end = lo + (x & ((1 << 21) - 1)) + length
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([lo, end])
    return [(a, b) for a, b in spans]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW,
                 gram: int = GRAM, with_bytes: bool = False, shared: DataFrame | None = None) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``with_bytes`` also ``spans`` and ``kept``.

    ``shared`` (``id``, ``text_key``, ``n_shared``, from ``shared_passages``) adds ``n_shared``: anchors of passages that other
    documents hold as well, also where they are too short in bytes to be removed.
    """
    if not gram + window <= length + 1:
        raise ValueError("window and gram must fit into the length")
    ranges = repeated_ranges(docs, id_col, text_col, length, window, gram).select(
        "id", "text_key", (F.shiftleft("lo", 21) + F.col("hi") - F.col("lo")).alias("start"), F.lit(0).cast("long").alias("n_shared"))
    if shared is not None:
        ranges = ranges.unionByName(shared.select("id", "text_key", F.lit(None).cast("long").alias("start"), F.col("n_shared").alias("n_shared")))
    spans = ranges.groupBy("id", "text_key").agg(F.collect_set("start").alias("starts"), F.max("n_shared").alias("n_shared"))
    texts = _texts(docs, id_col, text_col).join(
        spans.select(F.col("id").alias("of"), F.col("text_key").alias("of_key"), "starts", "n_shared"),
        F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left").select(
            "id", "body", "starts", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
                        T.StructField("kept_sha256", T.StringType())])
    with_shared = shared is not None
    if with_shared:
        out = out.add("n_shared", "long")
    if with_bytes:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        out = out.add("spans", T.ArrayType(span)).add("kept", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                rows = []
                for text, starts in zip(b.column("body").to_pylist(), b.column("starts").to_pylist(), strict=True):
                    raw, gone = text.encode(), merged_spans(starts or [], length)
                    edges = [0, *[x for span in gone for x in span], len(raw)]
                    kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    rows.append((len(raw), len(raw) - len(kept), len(gone), sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in gone], kept))
                columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])]
                if with_shared:
                    columns.append(b.column("n_shared"))
                if with_bytes:
                    columns += [pa.array([r[4] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r[5] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=out.names)

    return texts.mapInArrow(cut, out)
