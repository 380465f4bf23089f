"""Conversation prefix trie by composable fingerprints: rebuilt conversations are hashed, never written out.

A rebuilt conversation is a head of another one (its base) followed by its own turns after that head. The fingerprint
of a sequence of turns e0, e1, ... is sum(e_i * B**i), in ``LANES`` residue fields, with the number of turns n; such pairs
(value, n) form a monoid: (v, n) * (w, m) = (v + B**n * w, n + m). So every prefix of a rebuilt conversation is the
product of a head's value and a part of the conversation's own running value, and only turn references travel.

1. *Turns.* A turn is a 64-bit key of role and text plus its stored reference (conversation, turn). Positions and
   running values come in blocks of ``1 << BLOCK_BITS`` turn numbers, whose products are composed in a second step,
   so a conversation with a third of all turns is spread over tasks.
2. *Nodes.* Members (conversation, depth) meet by depth and value. Equality is verified: all members of a node must
   have one key for the last turn (the parent's value is the value less the last term, so equality goes on to all
   earlier turns), and all stored turns of a key must have the role and text of its reference. A difference stops the
   job with an error that asks for another ``seed``; it never gives a wrong node.
3. *Subtrees.* A node's own figures are put on the path of its smallest member, where suffix sums give each place the
   figures below it; a node's subtree is the sum over its members. That is linear in the turns for any depth.
4. *Ends.* Ids of conversations that end at a node are joined in blocks of ``1 << END_BITS`` ids and hashed in order by a
   pass over sorted blocks that holds one block at a time.

Edge cases: rows without a conversation id belong to no conversation and are left out; a null turn number comes first;
equal turn numbers are ordered by the key of role and text; a repeated row is a further turn; null role or text is
empty; a base that does not exist gives an empty head; conversations without rebuilt turns are members of the root
only; an empty table has no nodes; texts of any length are only hashed, counted and compared; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairshift.llm.common import partitions, written

PRIME = (1 << 31) - 1
LANES = 3
BASES = (1_103_515_245, 1_664_525, 22_695_477)
BLOCK_BITS = 8
END_BITS = 8
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
VALUE = [f"v{i}" for i in range(LANES)]


def _power(lane: int, exponent: Column) -> Column:
    """``B ** exponent`` in the lane's field, for exponents from -255 to 2**32 - 1: one table lookup per byte of the exponent."""
    def at(step: int, place: Column) -> Column:
        return F.get(F.expr(f"array({', '.join(f'{pow(BASES[lane], i * step, PRIME)}L' for i in range(256))})"), place.cast("int"))

    up = at(1, exponent.bitwiseAND(255))
    for byte in range(1, 4):
        place = F.shiftright(exponent, 8 * byte).bitwiseAND(255)
        up = F.when(place == 0, up).otherwise(F.pmod(up * at(256**byte, place), F.lit(PRIME)))
    inverse = pow(BASES[lane], -1, PRIME)
    down = F.get(F.expr(f"array({', '.join(f'{pow(inverse, i, PRIME)}L' for i in range(256))})"), (-exponent).cast("int"))
    return F.when(exponent < 0, down).otherwise(up)


def _field(x: Column) -> Column:
    return F.pmod(x, F.lit(PRIME))


def _terms(seed: int, key: str = "key") -> list[Column]:
    """A turn's value in every lane, from its key."""
    return [_field(F.xxhash64(F.lit(seed + i), F.col(key))) for i in range(LANES)]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, seed: int) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"),
                                empty(text_col).alias("text")).where("c IS NOT NULL").withColumn("key", F.xxhash64(F.lit(seed), "role", "text"))


def running_values(turns: DataFrame, seed: int) -> DataFrame:
    """``c``, ``i``, ``turn``, ``key``, ``words`` and the value of the conversation's first ``i + 1`` turns."""
    rows = turns.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    inside = Window.partitionBy("c", "block").orderBy(F.asc_nulls_first("turn"), "key")
    rows = rows.withColumn("local", F.row_number().over(inside).cast("long") - 1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    terms = _terms(seed)
    rows = rows.withColumns({f"t{i}": _field(terms[i] * _power(i, F.col("local"))) for i in range(LANES)})
    rows = rows.withColumns({v: _field(F.sum(f"t{i}").over(upto)) for i, v in enumerate(VALUE)}).drop(*[f"t{i}" for i in range(LANES)])

    blocks = rows.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"), *[F.max_by(v, "local").alias(f"b{i}") for i, v in enumerate(VALUE)])
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.withColumns({f"b{i}": _field(F.col(f"b{i}") * _power(i, F.col("start"))) for i in range(LANES)})
    blocks = blocks.select("c", "block", "start", *[_field(F.coalesce(F.sum(f"b{i}").over(before), F.lit(0))).alias(f"b{i}") for i in range(LANES)])
    whole = [_field(F.col(f"b{i}") + _power(i, F.col("start")) * F.col(v)).alias(v) for i, v in enumerate(VALUE)]
    return rows.join(blocks, ["c", "block"]).select("c", (F.col("start") + F.col("local")).alias("i"), "turn", "key", "words", *whole)


def rebuilt_members(turns: DataFrame, most: int, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations: ``c``, ``n``) and (members: ``c``, ``depth``, the prefix's value, its last turn's ``key``, ``words`` and reference).

    ``base`` and ``head`` are expressions over ``c``: whose head is taken, and how many turns, ``most`` at most.
    """
    first = F.sort_array(F.collect_list(F.when(F.col("i") < most, F.struct("i", *VALUE, "key", "words", "turn"))))  # ``most`` of them
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own"), first.alias("first")).withColumn("h", head.cast("int")).withColumn("base", base)
    bases = convs.select(F.col("c").alias("base_c"), F.col("first").alias("heads"))
    convs = convs.join(bases, F.col("base") == F.col("base_c"), "left")
    convs = convs.withColumn("hb", F.least("h", F.coalesce(F.size("heads"), F.lit(0))))
    convs = convs.withColumn("n", F.col("hb") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    value = lambda items, n: [F.coalesce(F.get(items, n - 1)[v], F.lit(0)) for v in VALUE]
    pick = lambda x, n, name: [e.alias(f"{name}{i}") for i, e in enumerate(value(F.col(x), F.col(n)))]
    heads = convs.where("hb > 0").select("c", F.col("base").alias("of_c"), F.explode(F.slice("heads", 1, F.col("hb"))).alias("t")).select(
        "c", (F.col("t.i") + 1).alias("depth"), *[F.col(f"t.{v}") for v in VALUE], "t.key", "t.words", "of_c", F.col("t.turn").alias("of_turn"))
    joint = convs.where("own > h").select(F.col("c").alias("whose"), "h", "hb", *pick("heads", "hb", "front"), *pick("first", "h", "cut"))
    moved = (F.col("hb") - F.col("h")).cast("long")
    tail = turns.join(joint, F.col("c") == F.col("whose")).where("i >= h").select(
        "c", (F.col("i") + 1 + moved).alias("depth"),
        *[_field(F.col(f"front{i}") + _power(i, moved) * _field(F.col(v) - F.col(f"cut{i}"))).alias(v) for i, v in enumerate(VALUE)],
        "key", "words", F.col("c").alias("of_c"), F.col("turn").alias("of_turn"))
    return convs.select("c", "n"), heads.unionByName(tail)


def _packed(values: list[Column]) -> list[Column]:
    """Three lanes in two columns."""
    return [(F.shiftleft(values[0], 31) + values[1]).alias("x"), values[2].alias("y")]


def _checked(ok: Column, what: str) -> Column:
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean"))


def below(members: DataFrame, figures: DataFrame, names: list[str]) -> DataFrame:
    """``members`` with, for each name, the sum of ``figures`` (by ``c``, ``depth``) from their depth on along their path."""
    rows = members.join(figures, ["c", "depth"], "left").withColumn("block", F.shiftright("depth", BLOCK_BITS))
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    sums = rows.groupBy("c", "block").agg(*[F.sum(n).alias(f"all_{n}") for n in names])
    after = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "block", *[F.coalesce(F.sum(f"all_{n}").over(after), F.lit(0)).alias(f"all_{n}") for n in names])
    on = Window.partitionBy("c", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(n).over(on) for n in names}).join(sums, ["c", "block"])
    return rows.withColumns({n: F.col(n) + F.col(f"all_{n}") for n in names}).drop("block", *[f"all_{n}" for n in names])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks sorted by node and place: one row per node, with the hash of its joined ids. Holds one node's hash state."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([state.hexdigest()])], names=["depth", "x", "y", "ends_sha256"])

    for b in batches:
        for *here, ids in zip(*[b.column(c).to_pylist() for c in ("depth", "x", "y", "ids")], strict=True):
            if here != node:
                if node is not None:
                    yield row()
                node, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield row()


def end_hashes(ends: DataFrame) -> DataFrame:
    """``depth``, ``x``, ``y``, ``ends_sha256``: SHA-256 of the ids ``c`` that end at the node, ascending, comma-joined."""
    blocks = ends.groupBy("depth", "x", "y", F.shiftright("c", END_BITS).alias("block")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("c")).cast("array<string>")).alias("ids"))  # at most 1 << END_BITS ids
    blocks = blocks.repartition(partitions(ends.sparkSession), "depth", "x", "y").sortWithinPartitions("depth", "x", "y", "block")
    return blocks.mapInArrow(_hash_ends, "depth long, x long, y long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, most: int = 3, conv_col: str = "conv_id",
                      turn_col: str = "turn", role_col: str = "role", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``base`` and ``head`` are expressions over the conversation id ``c``; by default the base is ``c - c % 20`` and the
    head has ``crc32(c) % 4`` turns. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the stored turn that holds the last role and
    text: ``last_conv_id``, ``last_turn`` (null at the root).
    """
    base = F.col("c") - F.col("c") % 20 if base is None else base
    head = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1) if head is None else head
    stored = _turns(conversations, conv_col, turn_col, role_col, text_col, seed)
    same = (F.min("role") == F.max("role")) & (F.min("text") == F.max("text"))
    refs = stored.groupBy("key").agg(same.alias("same"), F.min(F.struct("c", "turn")).alias("ref"))
    counted = stored.select("c", "turn", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = written(running_values(counted, seed), "turns")
    convs, members = rebuilt_members(turns, most, base, head)
    terms = _terms(seed)
    parent = _packed([_field(F.col(v) - terms[i] * _power(i, F.col("depth") - 1)) for i, v in enumerate(VALUE)])
    value = _packed([F.col(v) for v in VALUE])
    members = written(members.select("c", "depth", *value, parent[0].alias("px"), parent[1].alias("py"), "key", "words"), "members")
    convs = written(convs.select("c", "n"), "conversations")

    grouped = members.groupBy("depth", "x", "y").agg(
        F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.max("words").alias("words"),
        F.min("key").alias("key"), F.max("key").alias("other_key"))
    clash = "two different prefixes share a fingerprint: pass another seed"
    grouped = grouped.where(_checked(F.col("key") == F.col("other_key"), clash)).drop("other_key")
    root = convs.agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "rep", "n_convs",
        *[F.lit(None).cast("long").alias(c) for c in ("px", "py")], F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("key"))
    nodes = written(grouped.unionByName(root), "nodes")

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    with_kids = written(nodes.join(kids, ["depth", "x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    own = with_kids.select(F.col("rep").alias("c"), "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    figures = ["n_leaves", "saved_tokens"]
    sums = below(members.select("c", "depth", "x", "y"), own.where("depth > 0"), figures).groupBy("depth", "x", "y").agg(*[F.sum(n).alias(n) for n in figures])
    total = own.agg(*[F.sum(n).alias(n) for n in figures]).where("n_leaves > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y")], *figures)
    ends = members.join(convs, ["c"]).where("depth = n").select("c", "depth", "x", "y").unionByName(
        convs.where("n = 0").select("c", *[F.lit(0).cast("long").alias(n) for n in ("depth", "x", "y")]))
    above = with_kids.select((F.col("depth") + 1).alias("under"), F.col("x").alias("at_x"), F.col("y").alias("at_y"), F.col("rep").alias("parent_conv_id"))
    refs = refs.select(F.col("key").alias("ref_key"), _checked(F.col("same"), "two different turns share a key: pass another seed").alias("same"),
                       F.col("ref.c").alias("last_conv_id"), F.col("ref.turn").alias("last_turn"))
    out = with_kids.join(sums.unionByName(total), ["depth", "x", "y"]).join(end_hashes(ends), ["depth", "x", "y"], "left")
    out = out.join(above, (F.col("depth") == F.col("under")) & (F.col("px") == F.col("at_x")) & (F.col("py") == F.col("at_y")), "left")
    out = out.join(refs, F.col("key") == F.col("ref_key"), "left").where("same OR depth = 0")
    return out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *figures,
                      F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "last_conv_id", "last_turn")
