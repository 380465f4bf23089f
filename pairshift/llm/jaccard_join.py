"""N-gram Jaccard self-join with signature trees.

A document's set holds the 64-bit hashes of its distinct five-word shingles (A-Z lower-cased; with fewer words the
whole sequence is one shingle). Documents with equal sets fall into one class first. Classes link when
``100 * |intersection| >= percent * |union|``.

1. *Partition.* Under the order of the hashes, two linked sets have a common shingle among the first
   ``n - ceil(percent * n / 100) + 1`` of each (prefix filter); a class sends the first ``longest_prefix`` of them at
   most. The first L shingles of a linked pair's union all miss the intersection with probability
   ``(1 - percent / 100) ** L``, as a random order makes of it; L is the least that keeps this at or below ``MISS``
   whatever ``percent`` is. Shorter prefixes are whole and lose nothing. Shingles that only one class sends are dropped.
2. *Signature tree.* The classes that share a shingle form a group (split into block pairs when large). Leaves hold
   token bitmaps of at least two bits a token and set sizes, inner nodes the OR of the bitmaps and the ranges of size
   and bit count. A
   dual traversal prunes a pair of nodes when even the largest possible overlap is too small. A group yields a
   forest of candidate edges, not all pairs.
3. *Verification.* Candidate edges give coarse components, which no link leaves. In each one, every member is
   compared exactly with a pivot (the class with most candidate edges); members without that link are compared with
   all members in blocks, again through bitmaps first, and never twice within one verified component.
4. Verified links give the components.

No step gathers a component or a shingle's documents in one task beyond a block; joins on hot keys are plain
sort-merge joins that AQE may split, after counts that are pre-aggregated.

Edge cases: null, empty and word-less texts have the empty set, ``n_shingles`` 0, and are linked with nothing
(``component_id`` is their own id); repeated rows share a class; a null id is ignored by the minimum unless a
component has no other; texts of any length are read whole; an empty table gives an empty table; other columns do not
matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.llm.common import partitions, whole_text, without, written
from pairshift.llm.components import components

N = 5
PERCENT = 75
MISS = 4e-15
LEAST_BITS = 256
FEW = 6
FAN_OUT = 8
BLOCK = 1024
VERIFY_ROWS = 256
VERIFY_TOKENS = 1 << 20
FRONTIER = 1 << 16
ROWS = 512
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    words = text.encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(N, len(w))
    total = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += _mix(w[i : len(w) - k + 1 + i] * _M[i])
    return np.unique(_mix(total))


def width(n: int) -> int:
    """Bits of the bitmap of n tokens: a power of two of at least 2 n, so about a third of them is set at most."""
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length()) if n else LEAST_BITS


def bitmap(tokens: np.ndarray, bits: int = 0) -> bytes:
    bits = bits or width(len(tokens))
    held = np.zeros(bits, dtype=np.uint8)
    held[(tokens >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def folded(held: bytes, bits: int) -> np.ndarray:
    """The bitmap of the same tokens at a smaller width: halves are laid over each other."""
    return np.bitwise_or.reduce(np.frombuffer(held, dtype=np.uint64).reshape(-1, bits // 64), axis=0)


def longest_prefix(percent: int) -> int | None:
    """The least length with a miss of at most ``MISS``; none is enough at 0 percent, one at 100."""
    if percent <= 0:
        return None
    return 1 if percent >= 100 else math.ceil(math.log(MISS) / math.log(1 - percent / 100))


#: At the production threshold.
PREFIX = longest_prefix(PERCENT)


def prefix_length(n: int, percent: int) -> int:
    whole, longest = n + (-percent * n // 100) + 1, longest_prefix(percent)
    return whole if longest is None else min(whole, longest)


def _sketch(percent: int, out: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                sets = [shingles(t) for t in b.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[: prefix_length(len(s), percent)].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([bitmap(s) for s in sets], pa.binary())], names=out.names)

    return run


def _possible(a: dict, b: dict, common: np.ndarray, percent: int) -> np.ndarray:
    """Whether any two sets below two nodes can link; a leaf is a node with equal bounds."""
    missing_a, missing_b = np.maximum(0, a["pop"] - common), np.maximum(0, b["pop"] - common)
    return (100 * a["high"] - (100 + percent) * missing_a >= percent * b["low"]) & (100 * b["high"] - (100 + percent) * missing_b >= percent * a["low"])


class SignatureTree:
    """OR-combined bitmaps with ranges of set size, the least bit count and the star (or -1) of the sets below."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, stars: np.ndarray) -> None:
        pop = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [{"bits": bits, "low": sizes, "high": sizes, "pop": pop, "star": stars}]
        while len(self.levels[-1]["low"]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below["low"]), FAN_OUT)
            same = np.minimum.reduceat(below["star"], at)
            self.levels.append({
                "bits": np.bitwise_or.reduceat(below["bits"], at, axis=0), "low": np.minimum.reduceat(below["low"], at),
                "high": np.maximum.reduceat(below["high"], at), "pop": np.minimum.reduceat(below["pop"], at),
                "star": np.where(same == np.maximum.reduceat(below["star"], at), same, -1)})

    def _keep(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        nodes = self.levels[level]
        common = np.bitwise_count(nodes["bits"][a] & nodes["bits"][b]).sum(axis=1, dtype=np.int64)
        side = lambda i: {k: nodes[k][i] for k in ("low", "high", "pop")}
        apart = (nodes["star"][a] != nodes["star"][b]) | (nodes["star"][a] < 0)
        return apart & ((a == b) | _possible(side(a), side(b), common, percent))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf pairs (i < j) that survive the dual traversal, piece by piece."""
        work = [(len(self.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while work:
            level, a, b = work.pop()
            if len(a) > FRONTIER:
                work.extend((level, a[s : s + FRONTIER], b[s : s + FRONTIER]) for s in range(0, len(a), FRONTIER))
                continue
            keep = self._keep(level, a, b, percent)
            a, b = a[keep], b[keep]
            if not level:
                if (apart := a < b).any():
                    yield a[apart], b[apart]
            elif len(a):
                n = len(self.levels[level - 1]["low"])
                i = np.repeat(a * FAN_OUT, FAN_OUT**2) + np.tile(np.repeat(np.arange(FAN_OUT), FAN_OUT), len(a))
                j = np.repeat(b * FAN_OUT, FAN_OUT**2) + np.tile(np.arange(FAN_OUT), FAN_OUT * len(b))
                real = (i < n) & (j < n) & (i <= j)
                work.append((level - 1, i[real], j[real]))


def candidate_forest(sizes: list[int], bitmaps: list[bytes], lowest: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Edges that connect whatever the bitmaps cannot tell apart. Rows are sorted by their lowest shingle.

    Linked sets have widths of the same power of two or of neighbouring ones (below 50 percent: of more), so each
    width has a tree of its own sets and of those with the next widths, folded.
    """
    if len(sizes) <= FEW:
        yield from _few(sizes, bitmaps, percent)
        return
    n, w = np.array(sizes, dtype=np.int64), np.array([8 * len(b) for b in bitmaps])
    low = np.array(lowest, dtype=np.int64)
    for bits in np.unique(w).tolist():
        reach = max((100 * int(n[w == bits].max())) // percent, 1)
        at = np.flatnonzero((w == bits) | ((w > bits) & (n <= reach)))
        if len(at) > 1:
            held = np.stack([folded(bitmaps[i], bits) for i in at.tolist()])
            yield from ((int(at[i]), int(at[j])) for i, j in _forest(n[at], held, low[at], percent))


def _few(sizes: list[int], bitmaps: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """All pairs of a handful of sets, skipping those that are connected already."""
    held = [int.from_bytes(b, "little") for b in bitmaps]
    star = list(range(len(sizes)))
    for j in range(1, len(sizes)):
        for i in range(j):
            if star[i] == star[j]:
                continue
            x, y, wx, wy = held[i], held[j], 8 * len(bitmaps[i]), 8 * len(bitmaps[j])
            while wx > wy:
                wx //= 2
                x = (x >> wx) | (x & ((1 << wx) - 1))
            while wy > wx:
                wy //= 2
                y = (y >> wy) | (y & ((1 << wy) - 1))
            common = (x & y).bit_count()
            most = min(sizes[i] - max(0, x.bit_count() - common), sizes[j] - max(0, y.bit_count() - common))
            if (100 + percent) * most >= percent * (sizes[i] + sizes[j]):
                old, new = star[j], star[i]
                star = [new if s == old else s for s in star]
                yield i, j


def _forest(sizes: np.ndarray, bits: np.ndarray, lowest: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Sets with the same lowest shingle are tried against the first of them and hang on it as a star; of the
    possible pairs that the dual traversal leaves, those that join two parts are the edges: a forest, so never more
    edges than sets."""
    stars = np.arange(len(sizes))
    heads = np.flatnonzero(np.r_[True, lowest[1:] != lowest[:-1]])
    pop = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for first, end in zip(heads, np.r_[heads[1:], len(sizes)], strict=True):
        if end - first > 1:
            run = np.arange(first + 1, end)
            common = np.bitwise_count(bits[run] & bits[first]).sum(axis=1, dtype=np.int64)
            side = lambda i: {"low": sizes[i], "high": sizes[i], "pop": pop[i]}
            hung = run[_possible(side(run), side(first), common, percent)]
            stars[hung] = first
            yield from ((int(first), int(i)) for i in hung)
    if len(np.unique(stars)) == 1:
        return
    order = np.lexsort((sizes, stars))
    tree = SignatureTree(sizes[order], bits[order], stars[order])
    parts = stars.copy()  # of each star's first set: the part of the forest it is in so far
    for a, b in tree.pairs(percent):
        i, j = order[a], order[b]
        p, q = parts[stars[i]], parts[stars[j]]
        new = np.flatnonzero(p != q)
        if len(new):
            _, first = np.unique(np.minimum(p[new], q[new]) * len(sizes) + np.maximum(p[new], q[new]), return_index=True)
            for at in new[first].tolist():
                x, y = parts[stars[i[at]]], parts[stars[j[at]]]
                if x != y:
                    parts[parts == y] = x
                    yield int(i[at]), int(j[at])


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            part = b.slice(start, ROWS)
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["u", "v"])


def _batched(edges: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[bytes, bytes]] = []
    for e in edges:
        held.append(e)
        if len(held) >= 8192:
            yield _edges(held)
            held = []
    yield _edges(held)


def _group_candidates(percent: int):
    """Candidate edges of each (shingle, block pair); the rows arrive sorted by it and by the lowest shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[bytes, bytes]]:
            rows = _rows(batches, ["token", "i", "j", "lowest", "n", "set_id", "bits"])
            for _, members in groupby(rows, key=lambda r: r[:3]):
                held = list(members)
                yield from ((held[a][5], held[b][5]) for a, b in candidate_forest(*([r[i] for r in held] for i in (4, 6, 3)), percent))

        yield from _batched(edges())

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _with_pivot(percent: int):
    """Each member against the pivot of its coarse component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[bytes, bytes]]:
            now, tokens = None, None
            for set_id, body, pivot_id, pivot_body in _rows(batches, ["set_id", "body", "pivot_id", "pivot_body"]):
                if pivot_id != now:
                    now, tokens = pivot_id, shingles(pivot_body)
                if linked(shingles(body), tokens, percent):
                    yield pivot_id, set_id

        yield from _batched(edges())

    return run


def _among_rest(percent: int):
    """Members that the pivot left over (role 0) against all members (role 1), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple[bytes, bytes]]:
            for _, members in groupby(_rows(batches, ["coarse", "i", "j", "role", "set_id", "body", "part"]), key=lambda r: r[:3]):
                yield from _verify(list(members), percent)

        yield from _batched(edges())

    return run


def _verify(held: list[tuple], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """A forest of exact links between rows of role 0 and rows of role 1; ``part`` tells what is linked already."""
    sets: dict[bytes, np.ndarray] = {}
    parent: dict[bytes, bytes] = {}
    for _, _, _, _, set_id, body, part in held:
        if set_id not in sets:
            sets[set_id] = shingles(body)
            parent[set_id] = part
            parent.setdefault(part, part)

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = [r[4] for r in held if r[3] == 1]
    sizes = np.array([len(sets[x]) for x in ids], dtype=np.int64)
    if not ids:
        return
    bits_ = width(int(sizes.max()))
    bits = np.frombuffer(b"".join(bitmap(sets[x], bits_) for x in ids), dtype=np.uint64).reshape(len(ids), -1)
    all_ = {"low": sizes, "high": sizes, "pop": np.bitwise_count(bits).sum(axis=1, dtype=np.int64)}
    for x in (r[4] for r in held if r[3] == 0):
        own = np.frombuffer(bitmap(sets[x], bits_), dtype=np.uint64)
        one = {"low": len(sets[x]), "high": len(sets[x]), "pop": int(np.bitwise_count(own).sum())}
        common = np.bitwise_count(bits & own).sum(axis=1, dtype=np.int64)
        for at in np.flatnonzero(_possible(all_, one, common, percent)):
            y = ids[at]
            if (rx := root(x)) != (ry := root(y)) and linked(sets[x], sets[y], percent):
                parent[max(rx, ry)] = min(rx, ry)
                yield x, y


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``id``, ``text_key`` (hash of the text), ``n_shingles``, ``component_id``."""
    parts = partitions(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    out = T.StructType([
        T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("set_id", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text_key"), whole_text(text_col).alias("body"))
    rows = written(texts.mapInArrow(_sketch(percent, out), out), "sketches")
    classes = written(rows.where("n > 0").groupBy("set_id").agg(
        F.min(F.struct("id", "text_key")).alias("first"), F.min("id").alias("least_id"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "classes")

    # 1. shingles that two classes send
    sent = classes.select("set_id", F.explode("prefix").alias("token"))
    shared = sent.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("token").alias("shared"), "df")
    met = sent.join(shared, F.col("token") == F.col("shared")).select("token", "set_id", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).select(
        "token", F.col("set_id").alias("of"), "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))

    # 2. trees
    leaves = classes.select("set_id", "n", "bits", F.element_at("prefix", 1).alias("lowest"))
    grouped = met.join(leaves, F.col("of") == F.col("set_id")).select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "lowest", "n", "set_id", "bits")
    grouped = grouped.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "lowest", "n", "set_id")
    candidates = written(grouped.mapInArrow(_group_candidates(percent), "u binary, v binary").distinct(), "candidates")

    # 3. exact links
    coarse = components(candidates)
    degree = candidates.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("degree"))
    known = coarse.join(classes.select("set_id", "first", "n"), F.col("node") == F.col("set_id")).join(degree, F.col("set_id") == F.col("x"))
    known = known.select(F.col("root").alias("coarse"), "set_id", "n", "degree", "first")
    want = known.select("coarse", "set_id", "n", "degree", F.col("first.id").alias("want_id"), F.col("first.text_key").alias("want_key"))
    members = written(texts.join(want, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("text_key") == F.col("want_key")))
                      .groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("coarse", "n", "degree", "body")]), "members")
    # tables of one row per component are written, so the joins with them are plain and a hot component can be split
    best = members.groupBy("coarse").agg(F.max(F.struct("degree", "set_id")).alias("best"))
    best = written(best.select(F.col("coarse").alias("at"), F.col("best.set_id").alias("pivot_id")), "best")
    pivots = members.join(best, (F.col("coarse") == F.col("at")) & (F.col("set_id") == F.col("pivot_id"))).select("at", "pivot_id", F.col("body").alias("pivot_body"))
    pivots = written(pivots, "pivots")
    tried = members.join(pivots, (F.col("coarse") == F.col("at")) & (F.col("set_id") != F.col("pivot_id"))).select("set_id", "body", "pivot_id", "pivot_body")
    first_links = written(tried.mapInArrow(_with_pivot(percent), "u binary, v binary"), "links")
    status = members.select("coarse", "set_id", "n").join(best, F.col("coarse") == F.col("at")).join(first_links.select(F.col("v").alias("done"), "u"), F.col("set_id") == F.col("done"), "left")
    status = status.select("coarse", "set_id", "n", F.coalesce("u", "set_id").alias("part"), (F.col("u").isNull() & (F.col("set_id") != F.col("pivot_id"))).alias("rest"))
    volume = lambda which, name: F.ceil(F.greatest(F.count(which) / VERIFY_ROWS, F.sum(F.when(which.isNotNull(), F.col("n"))) / VERIFY_TOKENS)).cast("int").alias(name)
    blocks = status.groupBy("coarse").agg(volume(F.when(F.col("rest"), F.lit(1)), "rest_blocks"), volume(F.lit(1), "all_blocks")).where("rest_blocks > 0").withColumnRenamed("coarse", "at")
    blocks = written(blocks, "blocks")
    dealt = status.join(blocks, F.col("coarse") == F.col("at"))
    own = lambda n, salt: F.pmod(F.xxhash64("set_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("rest").select("coarse", "set_id", "part", own("rest_blocks", 1).alias("i"), every("all_blocks").alias("j"), F.lit(0).alias("role"))
    right = dealt.select("coarse", "set_id", "part", own("all_blocks", 2).alias("j"), every("rest_blocks").alias("i"), F.lit(1).alias("role"))
    checks = left.unionByName(right).withColumnRenamed("set_id", "of").join(members.select("set_id", "body"), F.col("of") == F.col("set_id"))
    checks = checks.select("coarse", "i", "j", "role", "set_id", "body", "part").repartition(parts, "coarse", "i", "j").sortWithinPartitions("coarse", "i", "j", "role", "set_id")
    links = first_links.unionByName(checks.mapInArrow(_among_rest(percent), "u binary, v binary"))

    # 4. components of verified links, with the smallest id of all their rows
    final = components(links)
    named = final.join(classes.select("set_id", "least_id"), F.col("node") == F.col("set_id"))
    lowest = named.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "r")
    grouped_ids = classes.select(F.col("set_id").alias("class"), "least_id").join(
        named.select("node", "root").join(lowest, F.col("root") == F.col("r")).select("node", "component_id"), F.col("class") == F.col("node"), "left")
    answers = grouped_ids.select("class", F.coalesce("component_id", "least_id").alias("component_id"))
    answers = written(answers, "answers")
    joined = rows.select("id", "text_key", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(answers, F.col("set_id") == F.col("class"), "left")
    return joined.select("id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component (rows with the empty set all stay)."""
    found = jaccard_components(docs, id_col, text_col, percent).where("NOT (id <=> component_id)").select("id", "text_key").distinct()
    return without(docs, found, {"id": F.col(id_col), "text_key": F.xxhash64(whole_text(text_col))})
