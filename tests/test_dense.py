import math
import random

import pytest
from pyspark.sql import functions as F

from topicgauge.functions.bands import band_struct
from topicgauge.operators import dense, similarity
from topicgauge.settings import STANDARD_BANDS

CHUNKS = "doc_id long, chunk_index int, scope string, vector array<double>, norm double, note string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    vector = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    length = lambda v: math.sqrt(sum(x * x for x in v if x is not None))
    odd = [None, [], [1.0, None] + vector(10), [math.nan] + vector(11), [0.0] * 12, vector(7), [math.inf] + vector(11)]
    vectors = [(k, odd[k % 23] if k % 23 < len(odd) else vector(12)) for k in range(400)]
    chunks = [(k // 9, k % 9, ["a", "a", "b", "c", None][k % 5], v, length(v or []), f"n{k}") for k, v in vectors]
    asked = [(q, ["a", "b", "d", None][q % 4], v, length(v or [])) for q, v in enumerate([vector(12) for _ in range(17)] + [vector(7), [0.0] * 12, None, vector(12)])]
    queries = spark.createDataFrame(asked, "query_id long, scope string, query_vector array<double>, query_norm double")
    return spark.createDataFrame(chunks, CHUNKS).repartition(3), queries.withColumn("bands", band_struct(STANDARD_BANDS))


@pytest.mark.parametrize("normalized", [False, True])
def test_same_as_pair_by_pair(tables, monkeypatch, normalized):
    monkeypatch.setattr(dense, "PAIRS", 50)
    chunks, queries = tables
    rows = lambda df: sorted((r.query_id, r.doc_id, r.chunk_index, r.similarity, r.interpretation, r.note, tuple(r.bands)) for r in df.collect())
    want, got = rows(similarity.score(chunks, queries, assume_normalized=normalized)), rows(dense.score_blocked(chunks, queries, assume_normalized=normalized))
    assert len(want) == len(got) > 500
    for a, b in zip(want, got):
        assert a[:3] == b[:3] and a[4:] == b[4:] and a[3] == pytest.approx(b[3], abs=1e-12)


def test_many_queries_take_the_join(tables):
    chunks, queries = tables
    joined = dense.score_blocked(chunks, queries, query_limit=100)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" in plan
    assert joined.count() == dense.score_blocked(chunks, queries).count()


def test_nothing_to_compare(tables):
    chunks, queries = tables
    assert dense.score_blocked(chunks.limit(0), queries).count() == 0 and dense.score_blocked(chunks, queries.limit(0)).count() == 0
    assert dense.score_blocked(chunks, queries.withColumn("scope", F.lit("nowhere"))).count() == 0
