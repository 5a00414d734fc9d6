import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicgauge.functions import vectors as V
from topicgauge.operators import diagnostics, embedding, similarity
from topicgauge.operators.embedding import HashedTerms, ModelVectors, PrecomputedVectors
from topicgauge.sources.readers import make_queries


def test_cosine_of_known_pairs(spark):
    pairs = [
        ([1.0, 2.0, 2.0], [1.0, 2.0, 2.0], 1.0), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], -1.0),
        ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.0), ([1.0, 2.0, 2.0], [10.0, 20.0, 20.0], 1.0),
    ]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want double")
    for r in df.withColumn("got", V.cosine(F.col("a"), F.col("b"))).collect():
        assert r.got == pytest.approx(r.want) and -1 <= r.got <= 1


def test_bad_pairs_have_a_reason(spark):
    pairs = [([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(
        V.cosine_reject_reason(F.col("a"), F.col("b")).alias("why"), V.cosine(F.col("a"), F.col("b")).alias("s")
    )
    got = [(r.why, r.s) for r in df.collect()]
    assert got == [("dimension mismatch", None), ("zero-length vector", None), ("zero-magnitude vector", None), (None, 1.0)]


def test_normalized_path_clamps_and_does_not_rescale(spark):
    df = spark.createDataFrame([([2.0, 0.0], [1.0, 0.0], 1.0), ([0.5, 0.0], [0.5, 0.0], 0.25)], "a array<double>, b array<double>, want double")
    for r in df.withColumn("got", V.cosine_normalized(F.col("a"), F.col("b"))).collect():
        assert r.got == r.want


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r.u for r in df.select(V.l2_normalize(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], None]


@pytest.mark.parametrize("dim", [16, 200])
def test_hashed_terms_count_every_token(spark, dim):
    df = spark.createDataFrame([("The cat, the CAT and 42 dogs",), ("...",), (" ",)], "text string")
    rows = embedding.embed(df, HashedTerms(dim)).collect()
    assert len(rows) == 2 and embedding.unembeddable(df).count() == 1
    assert sum(rows[0].vector) == 7 and len(rows[0].vector) == dim
    assert rows[0].norm == pytest.approx(math.sqrt(sum(x * x for x in rows[0].vector)))
    assert rows[1].norm == 0


def test_terms_are_counted_by_batch(monkeypatch):
    def bucket(term):
        calls.append(term)
        return sum(term) % 5

    rng, calls = random.Random(3), []
    for rows in (0, 1, 2, 9, 60):
        texts = ["".join(rng.choice("ab09z -\u00e9.\u4e2d") for _ in range(rng.choice([0, 1, 4, 30]))) if rng.random() < 0.9 else None for _ in range(rows)]
        batch = pa.array(["ends a", *texts, "b"], pa.string()).slice(1, rows)  # neighbours must not leak in
        want = [sum(sum(t.encode()) % 5 == k for t in re.findall("[a-z0-9]+", text or "")) for text in texts for k in range(5)]
        for most in (1, 7, 1 << 20):
            monkeypatch.setattr(embedding, "_PIECE", most)
            calls.clear()
            parts = list(embedding.pieces(batch))
            assert sum(map(len, parts)) == rows
            assert [int(x) for p in parts for x in embedding.bucket_counts(p, bucket, 5)] == want
        assert len(calls) == len(set(calls))  # one call a distinct term of a piece


def _model():
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


def test_model_vectors_are_unit_vectors_in_order(spark):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(50)], "id int, text string")
    for r in embedding.embed(df, ModelVectors(_model, 2, batch_size=8)).collect():
        length = math.hypot(r.id + 1, 1)
        assert r.vector == pytest.approx([(r.id + 1) / length, 1 / length])


def test_precomputed_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    store = PrecomputedVectors(table, ("vec_id",), 2)
    rows = embedding.with_metadata(store.embed(table.select("vec_id")), store).collect()
    assert {(r.vec_id, tuple(r.vector), r.model_name, r.embedding_dim) for r in rows} == {
        (1, (1.0, 0.0), "precomputed", 2), (2, (0.0, 1.0), "precomputed", 2),
    }


def test_scope_pairs_and_salts_agree(spark):
    chunks = spark.createDataFrame(
        [(d, i, "all", f"alpha beta {'gamma ' * i}") for d in range(4) for i in range(5)], "doc_id long, chunk_index int, scope string, text string"
    )
    embedder = HashedTerms(16)
    queries = similarity.prepare_queries(
        make_queries(spark, [(1, "alpha gamma delta", "all", None), (2, "beta", "all", None), (3, "x", "none", None)]), embedder
    )
    vectors = embedding.embed(chunks, embedder)
    pairs = spark.createDataFrame([(q, d) for q in (1, 2) for d in range(4)], "query_id long, doc_id long")
    key = ("query_id", "doc_id", "chunk_index", "similarity", "interpretation")

    def rows(df):
        return sorted(map(tuple, df.select(*key).collect()))

    plain = rows(similarity.score(vectors, queries))
    assert len(plain) == 40
    assert plain == rows(similarity.score(vectors, queries, salts=3))
    assert plain == rows(similarity.score_pairs(vectors, queries, pairs))


def test_chunk_without_terms_scores_zero(spark):
    chunks = spark.createDataFrame([(1, 0, "all", "...")], "doc_id long, chunk_index int, scope string, text string")
    e = HashedTerms(16)
    q = similarity.prepare_queries(make_queries(spark, [(1, "a b c", "all", None)]), e)
    row = similarity.score(embedding.embed(chunks, e), q).first()
    assert row.similarity == 0 and row.interpretation == "Off-topic"


def test_bands_follow_query_length(spark):
    q = make_queries(spark, [(1, "one two", "all", None), (2, "one two three", "all", None)])
    got = {r.query_id: r.bands.strong for r in similarity.prepare_queries(q, HashedTerms(16)).collect()}
    assert got == {1: 0.72, 2: 0.80}


BAD = {
    "null vector": None, "dimension mismatch": [1.0], "null element": [1.0, None], "not a number": [float("nan"), 0.0], "zero-length vector": [],
}


def test_bad_vectors_have_no_similarity(spark):
    rows = [(1, i, "all", v) for i, v in enumerate([*BAD.values(), [3.0, 0.0], [0.0, 0.0], [float("inf"), 1.0]])]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, scope string, vector array<double>").withColumn("norm", V.norm(F.col("vector")))
    queries = spark.createDataFrame([(1, "all", [1.0, 0.0], 1.0)], "query_id long, scope string, query_vector array<double>, query_norm double")
    queries = queries.withColumn("bands", similarity.B.band_struct({"strong": 0.8, "moderate": 0.65, "weak": 0.45}))
    got = {r.chunk_index: (r.similarity, r.interpretation) for r in similarity.score(chunks, queries).collect()}
    assert got == {5: (1.0, "Strong"), 6: (0.0, "Off-topic")}
    why = {r.chunk_index: r.reason for r in similarity.score_rejects(chunks, queries).collect()}
    assert why == {**dict(enumerate(BAD)), 7: "not a number"}
    assumed = {r.chunk_index: r.similarity for r in similarity.score(chunks, queries, assume_normalized=True).collect()}
    assert assumed == {5: 1.0, 6: 0.0, 7: 1.0}


def test_cosine_functions_reject_alike(spark):
    rows = [(k, v) for k, v in BAD.items()]
    df = spark.createDataFrame(rows, "kind string, v array<double>")
    good = F.array(F.lit(1.0), F.lit(0.0))
    for r in df.select("kind", V.cosine_reject_reason(good, F.col("v")).alias("why"), V.cosine(good, F.col("v")).alias("s"), V.cosine_normalized(F.col("v"), good).alias("n")).collect():
        assert (r.why, r.s, r.n) == (r.kind, None, None)


def test_vector_tables_are_scaled_unless_told(spark):
    table = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id int, embedding array<float>")
    keys = table.select("vec_id").union(spark.createDataFrame([(9,)], "vec_id int"))
    store = PrecomputedVectors(table, ("vec_id",), 2)
    assert [r.norm for r in store.embed(keys).collect()] == [5.0]
    assert [r.norm for r in PrecomputedVectors(table, ("vec_id",), 2, normalized=True).embed(keys).collect()] == [1.0]
    assert [(r.vec_id, r.reason) for r in embedding.without_vector(keys, store).collect()] == [(9, "no vector")]


def test_filters_do_not_repeat_the_product(spark):
    chunks = spark.createDataFrame([(1, 0, "all", "alpha beta")], "doc_id long, chunk_index int, scope string, text string")
    e = HashedTerms(16)
    scored = similarity.score(embedding.embed(chunks, e), similarity.prepare_queries(make_queries(spark, [(1, "alpha", "all", None)]), e))
    plan = scored.filter(F.col("similarity") > 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1


def test_hashed_terms_are_the_same_in_any_engine(spark):
    """The bucket of a term, from Spark's own MD5; a null text has no vector."""
    df = spark.createDataFrame([(0, "The cat, the CAT K9 İx"), (1, None), (2, "...")], "id int, text string")
    got = {r.id: r.vector for r in HashedTerms(24).embed(df, "text").collect()}
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")))
    bucket = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("bigint") % 24
    want = [0.0] * 24
    for r in df.filter("id = 0").select(tokens.alias("w")).select(bucket.alias("b")).collect():
        want[r.b] += 1
    assert got == {0: want, 1: None, 2: [0.0] * 24}


def test_no_word_is_hashed_or_sorted_in_expressions(spark):
    """Interpreted lambdas over every word took most of the scoring's time."""
    plan = HashedTerms(16).embed(spark.createDataFrame([("a b",)], "text string"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "array_sort" not in plan and "ArrowEvalPython" in plan


def test_words_and_lengths_are_found_beside_the_terms(spark):
    characters = [chr(c) for c in (*range(1, 0x250), *range(0x1670, 0x1690), *range(0x2000, 0x2070), 0x212A, 0x3000, 0x1F600)]
    texts = [f"a{c}B {c} x{c}{c}Y1 {c}" for c in characters] + ["İS KG k i s", "A a\nb\x1cC", "x"]
    facts = diagnostics.with_text_facts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = embedding.embed_facts(facts, HashedTerms(8))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RegExpCount" not in plan and "regexp_count" not in plan  # no pattern counts the words once more
    want = facts.select("doc_id", "word_count", F.lower("text").alias("low")).collect()
    got = {r.doc_id: r for r in found.select("doc_id", "word_count", "vector", "norm").collect()}
    bucket = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % 8
    for r in want:
        counts = [0.0] * 8
        for term in re.findall("[a-z0-9]+", r.low):
            counts[bucket(term)] += 1
        assert (got[r.doc_id].word_count, got[r.doc_id].vector) == (r.word_count, counts)
        assert got[r.doc_id].norm == math.sqrt(sum(x * x for x in counts))
