import random

import pytest
from pyspark.sql import functions as F

from topicgauge.functions.bands import band_struct
from topicgauge.operators import similarity
from topicgauge.operators import threshold_join as J
from topicgauge.settings import STANDARD_BANDS


@pytest.fixture(scope="module")
def tables(spark):
    """Sparse vectors whose coordinates are as uneven as words, some with negative numbers, zero, short or null."""
    rng = random.Random(12)

    def vector(dim=60):
        v = [0.0] * dim
        for _ in range(rng.randrange(1, 9)):
            v[min(dim - 1, int(rng.expovariate(0.12)))] += rng.choice([1.0, 1.0, 2.0, 5.0, -1.0])
        return v

    length = lambda v: sum(x * x for x in v or [] if x is not None) ** 0.5
    vectors = [vector() for _ in range(900)] + [[0.0] * 60, None, [1.0, 2.0], [None, 1.0]]
    chunks = [(k // 7, k % 7, "ab"[k % 2], v, length(v)) for k, v in enumerate(vectors)]
    asked = [(q, "abc"[q % 3], v, length(v)) for q, v in enumerate([vector() for _ in range(40)] + [vectors[5], [0.0] * 60, [1.0, 2.0]])]
    queries = spark.createDataFrame(asked, "query_id long, scope string, query_vector array<double>, query_norm double")
    chunks = spark.createDataFrame(chunks, "doc_id long, chunk_index int, scope string, vector array<double>, norm double")
    return chunks.cache(), queries.withColumn("bands", band_struct(STANDARD_BANDS)).cache()


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3, 0.6, 0.8, 1.0 - 1e-9])
def test_equals_filtering_all_pairs(tables, threshold):
    chunks, queries = tables
    rows = lambda df: sorted((r.query_id, r.doc_id, r.chunk_index, round(r.similarity, 12)) for r in df.collect())
    assert rows(J.score_above(chunks, queries, threshold)) == rows(similarity.score(chunks, queries).filter(F.col("similarity") >= threshold))


def test_compared_pairs_fall_with_the_threshold(tables):
    chunks, queries = tables
    everything = chunks.join(queries, "scope").count()
    compared = [J.candidate_pairs(chunks, queries, t).count() for t in (0.3, 0.6, 0.8, 0.95)]
    assert compared == sorted(compared, reverse=True)
    assert compared[2] < 0.5 * everything and compared[3] < 0.35 * everything, (compared, everything)


def test_empty_tables(tables):
    chunks, queries = tables
    assert J.score_above(chunks.limit(0), queries, 0.5).count() == 0 and J.score_above(chunks, queries.limit(0), 0.5).count() == 0
