"""A trie of conversation prefixes in tables of minimal perfect hashing.

Conversations share their beginnings. Every distinct sequence of first turns is a node; it has members
(the conversations that begin with it), children, and sums over its subtree.

*Digests.* A prefix has the digest D(d) = D(d - 1) * BASE + turn (mod 2^127 - 1), where a turn counts as the first half
of the SHA-256 of its role and text. Such digests can be joined: turns are sorted by range, so a conversation may lie in many
partitions, each of which digests its own run, and the runs are put together by the one digest each partition ends with.
The second half of the SHA-256 and the parent's digest are kept beside a node's digest and grouped with it: two
different prefixes with one digest would give two rows for it, which the slot tables reject. By induction over the depth, nodes are
right as long as SHA-256 is.

*Rebuilding.* A conversation may take its first turns from another one; its digests are shifted by the difference of
the two beginnings, without looking at its turns again.

*Slots.* Nodes are dealt to shards by subtree. Each shard enumerates its digests, gives each a slot by minimal perfect
hashing (level by level, a digest alone in its cell takes it), verifies the slot against the digest it holds, scatters the counts into
flat arrays and adds them up through an array of parent slots, the deepest nodes first. A subtree is dealt as a
whole when the turns of its members are at most SUBTREE_TURNS. The nodes above, the trunk, are far fewer; they
receive the sums of the subtrees below them and are dealt the same way, until they fit one shard.

A conversation, a prefix or an end that a third of all conversations share is one key only in sums that are made before
the shuffle, in joins with a unique side, and in the digest of a node's members: that is sequential by
definition, so ids are joined to long runs in parallel first, and one task passes the runs through.

Defined results: turns are ordered by number, null first, and turns of one number by the digest of their role and text; null roles and
texts count as empty; rows without a conversation id belong to none; rows that repeat are turns of their own; an empty table
has no nodes, not even a root. Further columns are ignored. Lengths count code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, rows_of
from topicgauge.sources.storage import materialize

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:16], "big") % PRIME
WIDTH = 16
#: Turns below a node from which its subtree is not dealt as a whole, and nodes per shard, more or less.
SUBTREE_TURNS = 1 << 14
SHARD_NODES = 1 << 15
#: Bytes of joined ids in one row.
RUN_BYTES = 1 << 16
#: Levels of a slot table; with two cells per digest, fewer than 20 are needed for any number of distinct digests.
MAX_LEVELS = 64

RUNS = "conv_id long, part int, place long, before binary, digest binary, half binary, chars long, edge boolean"
PREFIXES = "conv_id long, place long, before binary, digest binary, half binary, chars long"
STEPS = "conv_id long, depth long, parent binary, node binary, half binary, chars long, total long"
SUMS = (
    "node binary, parent binary, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, "
    "is_top boolean"
)


def _bytes(digest: int) -> bytes:
    return digest.to_bytes(WIDTH, "big")


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big")


def node_key(depth: int, digest: int) -> bytes:
    return depth.to_bytes(4, "big") + _bytes(digest)


ROOT = node_key(0, 0)
NOTHING = bytes(WIDTH)


def turns_of(conversations: DataFrame) -> DataFrame:
    """Slim turns: the SHA-256 of role and text, and the text's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(told, 256)).alias("sha"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"),
    )


def digest_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation's run in this partition, whose rows are in order. The last row of the first and of the
    last run is marked: nothing else is needed to join runs across partitions."""
    out, part = Rows(arrow_schema(RUNS)), TaskContext.get().partitionId()
    held, first, place, digest = None, True, 0, 0
    for conv_id, sha, chars in rows_of(batches):
        if held is not None:
            ends = conv_id != held[0]
            yield from out.add((*held, first and ends), 80)
            if ends:
                first, place, digest = False, 0, 0
        before, digest = digest, (digest * BASE + _number(sha[:WIDTH])) % PRIME
        place += 1
        held = (conv_id, part, place, _bytes(before), _bytes(digest), sha[WIDTH:], chars)
    if held is not None:
        yield from out.add((*held, True), 80)
    yield from out.flush()


def carried(edges: list[tuple[int, int, int, bytes]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(part, conv_id) -> turns and digest of the conversation in earlier partitions; ``edges`` are at most two per partition."""
    state: dict[int, tuple[int, int]] = {}
    out = {}
    for part, conv_id, place, digest in sorted(edges):
        n, before = state.get(conv_id, (0, 0))
        if n:
            out[part, conv_id] = n, before
        state[conv_id] = n + place, (before * pow(BASE, place, PRIME) + _number(digest)) % PRIME
    return out


def prefixes_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, before, digest, half, chars``: every turn with its place from 1 and the digests before and after it."""
    turns = materialize(turns_of(conversations))
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("sha"), F.col("row")]
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    runs = materialize(dealt.select("conv_id", "sha", "chars").mapInArrow(digest_runs, RUNS))
    # two rows per partition of the line above at most
    edges = runs.filter("edge").select("part", "conv_id", "place", "digest").collect()
    shared = spark.sparkContext.broadcast(carried([tuple(r) for r in edges]))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, carry = Rows(arrow_schema(PREFIXES)), shared.value
        for conv_id, part, place, before, digest, half, chars in rows_of(batches):
            if found := carry.get((part, conv_id)):
                power = pow(BASE, place - 1, PRIME)
                before = _bytes((found[1] * power + _number(before)) % PRIME)
                digest = _bytes((found[1] * power * BASE + _number(digest)) % PRIME)
                place += found[0]
            yield from out.add((conv_id, place, before, digest, half, chars), 80)
        yield from out.flush()

    return materialize(runs.drop("edge").mapInArrow(join, PREFIXES))


def shared_turns(conv_id: Column, most: int = 6) -> Column:
    """How many first turns a conversation takes from the one that begins its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % most).cast("long")


def begun_by(conv_id: Column, hundred: int = 100) -> Column:
    return conv_id - conv_id % hundred


def rebuilt(prefixes: DataFrame, shared: Column, base: Column) -> DataFrame:
    """STEPS: every conversation once per depth, the root included, when its first ``shared`` turns are those of ``base``.

    ``shared`` and ``base`` are columns over ``conv_id``; a conversation's own turns follow after its first ``shared`` ones.
    """
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("n"))
    asked = sizes.select("conv_id", "n", shared.alias("h"), base.alias("base"))
    at = prefixes.select(F.col("conv_id").alias("at_id"), F.col("place").alias("at_place"), F.col("digest").alias("at_digest"))
    none = F.lit(NOTHING)

    def digest_at(rows: DataFrame, conv: str, place: str, name: str) -> DataFrame:
        found = rows.join(at, (F.col(conv) == F.col("at_id")) & (F.col(place) == F.col("at_place")), "left")
        return found.withColumn(name, F.coalesce("at_digest", none)).drop("at_id", "at_place", "at_digest")

    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    facts = asked.join(of_base, "base", "left").withColumn("base_h", F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))).drop("base_n")
    facts = digest_at(digest_at(facts, "conv_id", "h", "own_digest"), "base", "base_h", "base_digest")
    facts = materialize(facts.withColumn("total", F.col("base_h") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    def shift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(STEPS))
        for conv_id, place, before, digest, half, chars, h, base_h, own, base_digest, total in rows_of(batches):
            depth = base_h + place - h
            parent, node = _number(before), _number(digest)
            if delta := (_number(base_digest) - _number(own)) % PRIME:
                power = delta * pow(BASE, place - h - 1, PRIME) % PRIME
                parent, node = (parent + power) % PRIME, (node + power * BASE) % PRIME
            yield from out.add((conv_id, depth, node_key(depth - 1, parent), node_key(depth, node), half, chars, total), 80)
        yield from out.flush()

    own = prefixes.join(facts.select("conv_id", "h", "base_h", "own_digest", "base_digest", "total"), "conv_id").filter("place > h")
    own = own.select(*PREFIXES.replace(" long", "").replace(" binary", "").split(", "), "h", "base_h", "own_digest", "base_digest", "total").mapInArrow(shift, STEPS)
    taken = prefixes.withColumnRenamed("conv_id", "base").join(facts.select("conv_id", "base", "base_h", "total").filter("base_h > 0"), "base").filter("place <= base_h")
    depth_bytes = lambda d: F.unhex(F.lpad(F.hex(d), 8, "0"))
    first = taken.select(
        "conv_id", F.col("place").alias("depth"), F.concat(depth_bytes(F.col("place") - 1), "before").alias("parent"),
        F.concat(depth_bytes(F.col("place")), "digest").alias("node"), "half", "chars", "total",
    )
    zero = F.lit(0).cast("long")
    roots = facts.select("conv_id", zero.alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(ROOT).alias("node"), none.alias("half"), zero.alias("chars"), "total")
    return own.unionByName(first).unionByName(roots)


class SlotTable:
    """Slots 0 to n - 1 for n distinct keys, each key (columns of whole numbers) verified at its slot."""

    def __init__(self, *columns: np.ndarray):
        n = len(columns[0])
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # is a cell taken, and by which slot
        self.slots = np.full(n, -1, np.int64)
        left, given = np.arange(n), 0
        while len(left):
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("two prefixes share a digest")
            cells = self._cells([c[left] for c in columns], len(self.levels), 2 * len(left))
            alone = np.bincount(cells, minlength=2 * len(left)) == 1
            slot_of = given + np.cumsum(alone) - 1
            self.levels.append((alone, slot_of))
            placed = alone[cells]
            self.slots[left[placed]] = slot_of[cells[placed]]
            given += int(alone.sum())
            left = left[~placed]
        self.columns = []
        for column in columns:
            held = np.empty_like(column)
            held[self.slots] = column
            self.columns.append(held)

    @staticmethod
    def _cells(columns: list[np.ndarray], level: int, size: int) -> np.ndarray:
        h = np.full(len(columns[0]), 0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64), np.uint64)
        for column in columns:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return (h % np.uint64(size)).astype(np.int64)

    def find(self, *columns: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for those that are not here."""
        out = np.full(len(columns[0]), -1, np.int64)
        left = np.arange(len(out))
        for level, (alone, slot_of) in enumerate(self.levels):
            cells = self._cells([c[left] for c in columns], level, len(alone))
            hit = alone[cells]
            slots, rows = slot_of[cells[hit]], left[hit]
            right = np.ones(len(rows), bool)
            for held, column in zip(self.columns, columns):
                right &= held[slots] == column[rows]
            out[rows[right]] = slots[right]
            left = left[~hit]
        return out


def _columns(keys: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth and the two halves of the digest of node keys; a null key, the root's parent, becomes depth -1."""
    raw = np.frombuffer(b"".join(b"\xff" * 20 if k is None else k for k in keys.to_pylist()), "u1").reshape(-1, 20)
    words = [np.ascontiguousarray(raw[:, a:b]).view(kind).ravel() for a, b, kind in ((0, 4, ">u4"), (4, 12, ">u8"), (12, 20, ">u8"))]
    return words[0].astype(np.int64), words[1].astype(np.uint64), words[2].astype(np.uint64)


def add_up(group: pa.Table) -> pa.Table:
    """SUMS of one shard: whole subtrees, whose tops have their parent elsewhere.

    ``children, leaves, saved`` are what a node has received from subtrees in other shards.
    """
    group = group.combine_chunks()
    keys, parents = _columns(group["node"]), _columns(group["parent"])
    slots = SlotTable(*keys)
    parent_of = slots.find(*parents)
    n = group.num_rows
    mine = slots.slots

    def scattered(name: str) -> np.ndarray:
        flat = np.zeros(n, np.int64)
        flat[mine] = group[name].to_numpy()
        return flat

    n_convs, chars, conv_id, depth = (scattered(c) for c in ("n_convs", "chars", "conv_id", "depth"))
    children, leaves, saved = (scattered(c) for c in ("children", "leaves", "saved"))
    parent_slot = np.full(n, -1, np.int64)
    parent_slot[mine] = parent_of
    inside = parent_slot >= 0
    children += np.bincount(parent_slot[inside], minlength=n)
    leaves += children == 0
    saved += (n_convs - 1) * chars
    order = np.argsort(depth, kind="stable")
    for level in reversed(np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)):
        level = level[inside[level]]
        np.add.at(leaves, parent_slot[level], leaves[level])
        np.add.at(saved, parent_slot[level], saved[level])
    parent_conv = pa.array(conv_id[np.maximum(parent_slot, 0)], pa.int64(), mask=~inside)
    return pa.table({
        "node": group["node"], "parent": group["parent"], "depth": depth[mine], "conv_id": conv_id[mine], "n_convs": n_convs[mine],
        "parent_conv_id": parent_conv.take(pa.array(mine)), "n_children": children[mine], "n_leaves": leaves[mine], "saved_tokens": saved[mine],
        "is_top": ~inside[mine],
    })


def node_table(steps: DataFrame) -> DataFrame:
    """One row per node (more than one would be a collision) with the turns of its members from there on."""
    grouped = steps.groupBy("node", "parent", "half", "depth").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.sum("total").alias("_totals")
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    below = F.col("_totals") - F.col("n_convs") * (F.col("depth") - 1)
    return grouped.select("node", "parent", "depth", "n_convs", "conv_id", "chars", below.alias("turns"), *zero)


def subtree_sums(nodes: DataFrame, steps: DataFrame, subtree_turns: int = SUBTREE_TURNS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """SUMS of all nodes.

    ``nodes`` are those of :func:`node_table`, ``steps`` the paths (``conv_id, depth, node``) of conversations that cover them.
    Each round deals the subtrees that are small enough and leaves the trunk, with what it received, to the next.
    """
    done = None
    nodes = nodes.withColumn("path", F.col("conv_id"))
    while True:
        n = nodes.count()
        large = nodes.filter(F.col("turns") > subtree_turns)
        trunk_size = large.count() if n > shard_nodes else 0
        if trunk_size == n > 0:
            # as many members at every node: only the distinct paths count from here on
            nodes, steps = next_round(nodes, steps)
            continue
        if trunk_size == 0:
            dealt = nodes.withColumn("shard", F.lit(0))
        else:
            # where each path leaves the trunk: the node below its deepest node of the trunk
            leaves_at = steps.join(large.select("node"), "node").groupBy("conv_id").agg((F.max("depth") + 1).alias("top_depth"))
            tops = steps.join(leaves_at, "conv_id").filter(F.col("depth") == F.col("top_depth"))
            shard = F.pmod(F.xxhash64("node"), F.lit(-(-n // shard_nodes))).cast("int")
            tops = tops.select(F.col("conv_id").alias("path"), shard.alias("shard"))
            dealt = nodes.filter(F.col("turns") <= subtree_turns).join(tops, "path")
        columns = ("node", "parent", "depth", "conv_id", "n_convs", "chars", "children", "leaves", "saved")
        sums = materialize(dealt.select("shard", *columns).groupBy("shard").applyInArrow(add_up, SUMS))
        done = sums if done is None else done.unionByName(sums)
        if trunk_size == 0:
            return with_parents(done).drop("is_top")
        received = sums.filter("is_top").groupBy("parent").agg(
            F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s")
        )
        received = received.withColumnRenamed("parent", "node")
        add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0).cast("long"))).alias(c)
        left = large.join(received, "node", "left").select(
            "node", "parent", "depth", "n_convs", "conv_id", "path", "chars", add("children", "_c"), add("leaves", "_l"), add("saved", "_s")
        )
        nodes, steps = next_round(materialize(left), steps)


def next_round(trunk: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trunk as nodes with their turns, and one path to each of its last nodes; these cover it.

    A path is the smallest through one last node only, so it stands for that node.
    """
    inner = trunk.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    last = trunk.join(inner, "node", "left_anti").select(F.col("path").alias("conv_id"), F.col("depth").alias("last"))
    paths = materialize(steps.select("conv_id", "depth", "node").join(last, "conv_id").filter("depth <= last"))
    turns = paths.groupBy("node").agg(F.sum(F.col("last") - F.col("depth") + 1).alias("turns"), F.min("conv_id").alias("path"))
    return materialize(trunk.drop("turns", "path").join(turns, "node")), paths.drop("last")


def with_parents(sums: DataFrame) -> DataFrame:
    """Tops of subtrees get the smallest member of their parent, which was dealt in a later round."""
    tops = sums.filter(F.col("is_top") & F.col("parent").isNotNull())
    above = sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    filled = tops.join(above, "parent").withColumn("parent_conv_id", F.col("_above")).drop("_above")
    return sums.filter(~F.col("is_top") | F.col("parent").isNull()).unionByName(filled)


def end_digests(steps: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes where conversations end: the SHA-256 of their ids in order, joined by commas."""
    spark = steps.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = steps.filter(F.col("depth") == F.col("total")).select("node", "conv_id")
    schema = "node binary, first long, ids binary"

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        node, first, ids, size = None, 0, [], 0
        for key, conv_id in rows_of(batches):
            if key != node or size >= RUN_BYTES:
                if ids:
                    yield from out.add((node, first, b",".join(ids)), size)
                node, first, ids, size = key, conv_id, [], 0
            ids.append(b"%d" % conv_id)
            size += len(ids[-1]) + 1
        if ids:
            yield from out.add((node, first, b",".join(ids)), size)
        yield from out.flush()

    digests = "node binary, ends_sha256 string"

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(digests))
        node, state = None, None
        for key, ids in rows_of(batches):
            if key != node:
                if state:
                    yield from out.add((node, state.hexdigest()), 80)
                node, state = key, hashlib.sha256(ids)
            else:
                state.update(b",")
                state.update(ids)
        if state:
            yield from out.add((node, state.hexdigest()), 80)
        yield from out.flush()

    runs = ends.repartitionByRange(partitions, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, schema)
    runs = runs.repartition(partitions, "node").sortWithinPartitions("node", "first")
    return runs.select("node", "ids").mapInArrow(digest, digests)


def prefix_trie(
    conversations: DataFrame, shared: Column | None = None, base: Column | None = None, subtree_turns: int = SUBTREE_TURNS, shard_nodes: int = SHARD_NODES
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node, with its ``node`` key.

    ``shared`` and ``base`` say how conversations are rebuilt (see :func:`rebuilt`); without them they stay as they are.
    """
    shared = F.lit(0).cast("long") if shared is None else shared
    base = F.col("conv_id") if base is None else base
    steps = materialize(rebuilt(prefixes_of(conversations), shared, base))
    nodes = materialize(node_table(steps))
    sums = subtree_sums(nodes, steps.select("conv_id", "depth", "node"), subtree_turns, shard_nodes)
    found = sums.join(end_digests(steps), "node", "left")
    return found.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
