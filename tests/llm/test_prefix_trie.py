import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicgauge.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def told(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, shared=lambda c: zlib.crc32(str(c).encode()) % 6, base=lambda c: c - (c % 100 if c >= 0 else -(-c % 100))):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, told(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    full = {c: tuple(own.get(base(c), [])[: shared(c)] + ts[shared(c) :]) for c, ts in own.items()}
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        below = [p for p in out if len(p) == len(path) + 1 and p[:-1] == path] if len(members) < 3000 else None
        out[path] = [below, 0, 0]
        children = below
        leaves = sum(out[p][1] for p in children) if children else 1
        saved = sum(out[p][2] for p in children) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        out[path] = [children, leaves, saved]
    result = []
    for path, (children, leaves, saved) in out.items():
        ends = sorted(c for c in members[path] if len(full[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        result.append((min(members[path]), len(path), parent, len(members[path]), len(children), leaves, saved, digest))
    return sorted(result, key=repr)


def found(spark, rows, rebuild=True, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS node", "2 AS row", "3 AS total")
    c = F.col("conv_id")
    how = {"shared": P.shared_turns(c), "base": P.begun_by(c)} if rebuild else {}
    return sorted((tuple(r) for r in P.prefix_trie(df, **how, **options).select(*COLUMNS).collect()), key=repr)


def random_rows(seed, convs, depth, words):
    """Few distinct turns, so that prefixes are shared; ids of several hundreds, with gaps."""
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.randrange(0, 4) * 100 + rng.randrange(0, 60)
        rows += [(c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user", rng.choice(words)) for k in range(rng.randrange(1, depth))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"subtree_turns": 12, "shard_nodes": 20}, {"subtree_turns": 1, "shard_nodes": 1}, {"subtree_turns": 3, "shard_nodes": 50}])
def test_random_conversations(spark, limits):
    rows = random_rows(3, 60, 5, ["a", "bb", "", "日本"])
    assert found(spark, rows, **limits) == brute(rows)


def test_edge_cases(spark):
    rows = [
        (100, 0, "user", "hi"), (100, 1, None, None), (100, None, "system", "first"), (101, 0, "user", "hi"), (101, 0, "user", "hi"), (101, 0, "bot", ""),
        (102, None, None, "x"), (102, None, None, "x"), (None, 0, "user", "nobody's"), (-7, 1, "user", "🙂 two"), (-107, 0, "user", "🙂"), (-100, 3, "user", "🙂"),
        (205, 0, "user", "y" * 20_000), (206, 0, "user", "y" * 20_000), (2**62, 5, "u", "z"), (7, 0, "ab", "c"), (8, 0, "a", "bc"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, rebuild=False) == brute(rows, shared=lambda c: 0)
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_one_long_conversation_over_many_partitions(spark):
    """A third of all turns in one conversation, which others copy and leave at different depths."""
    rng = random.Random(8)
    long_one = [("user", rng.choice("abc")) for _ in range(300)]
    rows = [(0, k, *t) for k, t in enumerate(long_one)]
    for c in range(1, 12):
        kept = rng.randrange(20, 60)
        rows += [(c, k, *t) for k, t in enumerate(long_one[:kept])] + [(c, kept, "user", f"own {c}")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = found(spark, rows, subtree_turns=25, shard_nodes=40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_many_copies_of_a_conversation(spark, monkeypatch):
    """Ends of one node that fill many runs; every node of the trunk has all members."""
    monkeypatch.setattr(P, "RUN_BYTES", 64)
    rows = [(c, k, "user", f"turn {k}") for c in range(1000, 1200) for k in range(3)]
    assert found(spark, rows, rebuild=False, subtree_turns=10, shard_nodes=2) == brute(rows, shared=lambda c: 0)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 1 << 62, (2, 2 * n), dtype=np.int64)
        table = P.SlotTable(keys[0, :n], keys[1, :n])
        assert sorted(table.slots.tolist()) == list(range(n)) and len(table.levels) < 40
        assert (table.find(keys[0, :n], keys[1, :n]) == table.slots).all()
        assert (table.find(keys[0, n:], keys[1, n:]) == -1).all()
    with pytest.raises(ValueError, match="share a digest"):
        P.SlotTable(np.array([5, 6, 5]), np.array([1, 1, 1]))


def test_a_collision_of_digests_fails(spark):
    """Two turns with one digest but different second halves, and two parents of one node."""
    node = P.node_key(1, 77)
    root = [(c, 0, None, P.ROOT, P.NOTHING, 0, 1) for c in (1, 2)]
    for other in ((2, 1, P.ROOT, node, b"b" * 16, 5, 1), (2, 1, P.node_key(0, 9), node, b"a" * 16, 5, 1)):
        steps = spark.createDataFrame([*root, (1, 1, P.ROOT, node, b"a" * 16, 5, 1), other], P.STEPS)
        with pytest.raises(Exception, match="share a digest"):
            P.subtree_sums(P.node_table(steps), steps.select("conv_id", "depth", "node"))


def test_registered_query_matches_sql(spark):
    from check_oracle import connect, difference
    from topicgauge.llm import queries

    sf = "/root/testdata/sf0.01"
    expected = connect(sf).execute(queries.ORACLES["op13_prefix_trie"]).df()
    assert difference(queries.QUERIES["op13_prefix_trie"](spark, sf), expected) is None
