import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicgauge.llm import topk_search as K


def brute(rows, is_query, k):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v, key=lambda x: (x,))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, step, k=5, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS dim")
    return sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") % step == 0, k, **options).collect())


def test_edge_cases(spark):
    rows = [
        (0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (10, [0.0, 0.0]), (12, [-3.0, 1.0]), (12, [-3.0, 1.0]), (14, [1.0, 2.0, 3.0]), (16, [1000.0, 2.0]), (18, [1.0, 0.001]),
    ]
    assert found(spark, rows, 2) == brute(rows, lambda i: i % 2 == 0, 5)


@pytest.mark.parametrize("from_cosine", [0.0, 0.5, 0.9, 2.0])
def test_pruning_loses_nothing(spark, monkeypatch, from_cosine):
    """Lengths from very short to very long, clusters of near directions, many ties; both prunings."""
    monkeypatch.setattr(K, "COORDINATE_FROM", from_cosine)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    v = (centres[rng.integers(0, 6, 600)] + 0.05 * rng.normal(size=(600, 8))) * rng.lognormal(0, 1.5, size=(600, 1))
    v[100:160] = v[100]
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    assert found(spark, rows, 7, 5, bucket_rows=40, query_rows=16) == brute(rows, lambda i: i % 7 == 0, 5)


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(9)
    rows = [(i, np.float32(rng.normal(size=4) * 1e6).tolist()) for i in range(40)]
    assert found(spark, rows, 4) == brute(rows, lambda i: i % 4 == 0, 5)


def test_large_components_and_empty(spark):
    """Every finite component takes part; only a score beyond 64 bits is an error."""
    rows = [(0, [1e8, 0.0]), (1, [1.0, 2.0]), (2, [-3.0, 0.5]), (3, [1e6, 1.0]), (4, [0.0, 1.0])]
    assert found(spark, rows, 1) == brute([(i, np.float32(v).tolist()) for i, v in rows], lambda i: True, 5)
    with pytest.raises(Exception, match="does not fit a long"):
        found(spark, [(0, [1e10]), (1, [1e10])], 1)
    with pytest.raises(Exception, match="does not fit a long"):
        found(spark, [(0, [1e30]), (1, [1.0])], 1)
    assert found(spark, [], 1) == [] and found(spark, [(0, [1.0])], 1) == []


def test_short_vectors_do_not_travel(spark, monkeypatch):
    """With lengths far apart, most pairs of blocks are dropped before their vectors are joined."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(800, 6)) * np.repeat([100.0, 10.0, 1.0, 0.1], 200)[:, None]
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(v)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    joined = []
    real = K.shipped
    monkeypatch.setattr(K, "shipped", lambda pairs: joined.append((pairs.count(), pairs.select("block").distinct().count())) or real(pairs))
    got = sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") % 7 == 0, 5, bucket_rows=50, query_rows=20).collect())
    assert got == brute(rows, lambda i: i % 7 == 0, 5)
    blocks = -(-115 // 20)
    assert joined[0][0] < 0.75 * blocks * 16
