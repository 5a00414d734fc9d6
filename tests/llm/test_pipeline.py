"""The pipeline and the registered queries on the smallest tables, against plain versions."""

import hashlib
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from check_oracle import connect, difference
from tests.llm.test_byte_bpe import PLAIN
from tests.llm.test_ngram_join import brute as near
from tests.llm.data import documents, edge_rows
from topicgauge.llm import mixing, quality
from topicgauge.llm.queries import ORACLES, QUERIES
from topicgauge.sources.storage import materialize

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op4")])
def test_query_matches_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in C.STAGES][1] == "exact dedup" and len(C.STAGES) == 5


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = C.good_documents(spark, docs, SF)
    weights = quality.train(quality.training_shards(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True)))
    accepted = {r.doc_id for r in quality.score(docs, weights).collect() if r.score >= quality.THRESHOLD}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == accepted

    distinct = C.distinct_documents(spark, good, SF)
    by_text = defaultdict(list)
    for r in good.collect():
        by_text[r.text.translate(LOWER)].append(r.doc_id)
    rows = distinct.collect()
    assert distinct.columns == columns and sorted(r.doc_id for r in rows) == sorted(max(ids) for ids in by_text.values())

    apart = C.dissimilar_documents(spark, distinct, SF)
    assert apart.columns == columns
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, _, root, _ in near([(r.doc_id, r.text) for r in rows]) if i == root)

    mixed = C.mixed_documents(spark, apart, SF)
    taken = {r.doc_id: r.copies for r in mixing.mixture(apart).collect()}
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r.doc_id] += 1
    assert mixed.columns == columns and dict(counts) == {i: n for i, n in taken.items() if n}

    texts = {r.doc_id: r.text for r in apart.collect()}
    encoded = C.encoded_documents(spark, mixed, SF).collect()
    assert len(encoded) == sum(counts.values())
    for r in encoded:
        ids = PLAIN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_chain_on_edge_cases(spark, rows):
    """Null, empty and very long texts, null and repeated ids, clashing names; then no rows at all."""
    docs = documents(spark, edge_rows() if rows == "edge" else [], ("digest", "position", "row", "score"))
    for (name, stage), same in zip(C.STAGES, [True] * 4 + [False]):
        columns, docs = docs.columns, materialize(stage(spark, docs, SF))
        assert not same or docs.columns == columns, name
    found = docs.collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in found) and (rows == "edge" or not found)


def test_encoding_and_decoding_do_not_run_in_one_stage(spark):
    """Two Python operators in a stage take two workers a task, whose memory stays with the executor."""
    plan = C.encoded_documents(spark, documents(spark, edge_rows()), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_run_gives_the_last_stage(spark):
    rows = C.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and rows.count() > 100
