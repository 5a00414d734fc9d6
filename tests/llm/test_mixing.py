import math
import re
from collections import defaultdict

import pytest

from check_oracle import connect
from tests.llm.data import documents, edge_rows
from topicgauge.llm import mixing as M
from topicgauge.llm import sql as Q


def filled(sizes, weights, share, limit):
    """Targets by resharing the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = share * sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] >= limit * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: limit * sizes[s] for s in above}
        free -= above


def sizes_of(rows):
    out = defaultdict(int)
    for _, text, _, source in rows:
        out[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return dict(out)


def rows_with_sources(n=400):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 50)), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(n)]
    return rows + [(i, t, "en", [None, "", "s1"][k % 3]) for k, (i, t) in enumerate(edge_rows()) if len(t or "") < 10_000]


def test_targets_and_words_taken(spark):
    rows = rows_with_sources()
    mix = M.mixture(documents(spark, rows, ("hash", "size", "bucket"))).collect()
    again = M.mixture(documents(spark, rows[::-1])).collect()
    sizes = sizes_of(rows)
    want = filled(sizes, M.WEIGHTS, M.SHARE, M.LIMIT)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert len(mix) == len(rows) and sorted(map(repr, mix)) == sorted(map(repr, again))
    taken, largest = defaultdict(int), max(r.size for r in mix)
    for r in mix:
        source = order[r.source_no - 1]
        assert r.source_size == sizes[source] and math.isclose(r.target, want[source], abs_tol=1e-6)
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies
        assert all(0 < p <= 1 for p in r.positions)
        taken[source] += r.taken
    for source in sizes:
        assert want[source] - largest < taken[source] <= want[source] + 1e-6
    assert sum(abs(taken[s] - want[s]) for s in sizes) < 0.02 * sum(want.values())


def test_matches_sql_on_the_tables(spark):
    con = connect("/root/testdata/sf0.001")
    want = con.execute(Q.mixing(M.WEIGHTS, M.SHARE, M.LIMIT, M.CURRICULUM, M.FILLS)).df()
    got = M.mixture(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    key = ["doc_id", "size", "copies", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


@pytest.mark.parametrize("knots", [*M.CURRICULUM, ((0, 0), (0.25, 2), (0.5, 0), (0.75, 0), (1, 1))])
def test_due_inverts_the_integral(spark, knots):
    def demand(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            u = min(max(t - t0, 0), t1 - t0)
            total += w0 * u + (w1 - w0) / (t1 - t0) * u * u / 2
        return total

    rows = spark.range(1, 100).select((M.F.col("id") / 100).alias("x"))
    for r in rows.select("x", M.due(M.F.col("x"), M.schedule([knots], M.F.lit(1))).alias("t")).collect():
        assert math.isclose(demand(r.t) / demand(1), r.x, abs_tol=1e-9)


def test_training_order_repeats_whole_rows(spark):
    rows = rows_with_sources(60) + [(1, "other text here", "fr", "s1")]
    docs = documents(spark, rows, ("position", "row"))
    mix = {(r.doc_id, r.source_no, r.size): 0 for r in M.mixture(docs).collect()}
    ordered = M.training_order(docs).collect()
    assert sum(len(r.text.encode().split()) for r in ordered) == sum(r.taken for r in M.mixture(docs).collect()) and len(mix) > 0
    assert {(r.doc_id, r.text, r.lang, r.source) for r in ordered} <= {(i, t, la, s) for i, t, la, s in rows}
    rising = [k for k, r in enumerate(ordered) if r.source == ""]  # the first source's weight rises
    assert not rising or sum(rising) / len(rising) > len(ordered) / 2


def test_empty_and_wordless(spark):
    assert M.mixture(documents(spark, [])).collect() == []
    only = M.mixture(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken, r.positions) for r in only] == [(0, 0.0, 0, [])] * 2
