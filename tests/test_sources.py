import json

import pytest
from pyspark.sql import functions as F

from topicgauge.sources.readers import make_queries
from topicgauge import HashedTerms, analyze, analyze_chunks, compare_documents, score_documents
from topicgauge.operators import diagnostics as D
from topicgauge.sources import readers, storage
from topicgauge.streaming.scoring import start_coverage

TEXT = "Widgets need tuning. " * 40 + "Cooking is fun. " * 60


@pytest.fixture
def queries(spark):
    return readers.make_queries(spark, [(1, "how to tune widgets", "all", None), (2, "cooking", "all", None)])


def test_rejects(spark):
    docs = spark.createDataFrame([(1, None), (2, " \t"), (3, "ok")], "doc_id long, text string")
    asked = readers.make_queries(spark, [(7, "", "all", None), (8, None, "all", None), (9, "fine", "all", None)])
    got = {(r.query_id, r.doc_id, r.reason) for r in readers.rejected_inputs(docs, asked).collect()}
    assert got == {
        (None, 1, "document is null"), (None, 2, "document is blank"), (7, None, "query is blank"), (8, None, "query is null"),
    }
    assert readers.accepted_documents(docs).count() == 1 and readers.accepted_queries(asked).count() == 1


def test_bad_rows_do_not_fail_a_job(spark, queries):
    docs = spark.createDataFrame([(1, None, "all"), (2, "  ", "all"), (3, TEXT, "all")], "doc_id long, text string, scope string")
    rows = compare_documents(docs, queries, HashedTerms(16)).collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {(1, 3), (2, 3)}
    assert all(r.document_char_count == len(TEXT) and r.embedding_dim == 16 for r in rows)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_formats_in_and_out(spark, queries, tmp_path, fmt):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, TEXT)], "id long, body string").write.format(fmt).option("header", "true").save(path)
    docs = readers.read_documents(spark, path, fmt, "id", "body", header="true")
    heat = D.heatmap(D.diagnose(score_documents(docs, queries, HashedTerms(16))))
    storage.write_table(heat, str(tmp_path / "heat"), "json", ["query_id"])
    lines = [json.loads(x) for p in (tmp_path / "heat" / "query_id=1").glob("*.json") for x in p.read_text().splitlines()]
    assert lines and set(lines[0]) == {"doc_id", "index", "score", "raw_score", "interpretation"}


def test_materialize_uses_the_named_folder(spark, tmp_path_factory):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    kept = storage.materialize(df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert all(folder in f for f in kept.inputFiles())


def test_spread_by_a_given_number(spark):
    one = spark.range(10).coalesce(1)
    assert readers.spread(one, 0, "id") is one
    assert readers.spread(one, 6, "id").rdd.getNumPartitions() == 6
    assert readers.input_partitions(spark) == 0 and readers.input_partitions(spark, 5) == 5


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.checkpoint_folder(Cluster)


def test_no_document_disappears(spark):
    """Every asked pair has a report or an empty one; every faulty row has a reason."""
    docs = spark.createDataFrame(
        [(1, TEXT, "a", "flat"), (2, "<h2></h2>", "a", "html"), (3, None, "a", "flat"), (4, TEXT, "b", "flat"), (5, TEXT, "a", "odd"), (6, " ", "a", "flat"),
         (7, TEXT, "a", None)],
        "doc_id long, text string, scope string, strategy string",
    )
    queries = make_queries(spark, [(1, "widgets and tools", "a", None), (2, None, "a", None), (3, "alone here", "c", None)])
    a = analyze(docs, queries, HashedTerms(16), F.col("strategy"))
    assert {r.doc_id for r in a.coverage.collect()} == {1}
    reasons = {r.doc_id: r.reason for r in a.rejects.collect() if r.doc_id}
    assert reasons == {
        2: "no chunks", 3: "document is null", 4: "no query asks for it", 5: "unknown strategy", 6: "document is blank", 7: "unknown strategy",
    }
    assert {r.query_id: r.reason for r in a.rejects.collect() if r.query_id} == {2: "query is null", 3: "no document to ask"}
    empty = {r.doc_id: (r.coverage_score, r.coverage_label, r.reason) for r in a.empty_reports.collect()}
    assert empty == {d: (0.0, "Low", reasons[d]) for d in (2, 3, 5, 6, 7)}


def test_scored_rows_hold_no_text(spark, queries):
    docs = spark.createDataFrame([(1, TEXT, "all")], "doc_id long, text string, scope string")
    scored = analyze(docs, queries, HashedTerms(16)).scored
    assert [c for c, t in scored.dtypes if t == "string"] == ["interpretation"]


def test_pairs_give_the_same_reports_as_their_scope(spark, queries):
    docs = spark.createDataFrame([(i, f"{TEXT} {i}", "all") for i in range(3)], "doc_id long, text string, scope string")
    whole = analyze(docs, queries, HashedTerms(16))
    pairs = whole.asked
    by_pairs = analyze(docs, queries, HashedTerms(16), pairs=pairs)
    salted = analyze(docs, queries, HashedTerms(16), salts=3)
    rows = lambda a: sorted(map(repr, a.next_steps.collect()))
    assert rows(whole) == rows(by_pairs) == rows(salted) and len(rows(whole)) > 0


def test_analysis_is_consistent(spark, queries):
    docs = spark.createDataFrame([(i, f"## Part\n{TEXT}\n### Sub\n" + "widgets " * i, "all") for i in range(1, 4)], "doc_id long, text string, scope string")
    a = analyze(docs, queries, HashedTerms(16), "auto")
    facts = a.facts.collect()
    assert len(facts) == 6 and all(f.is_hierarchical for f in facts)
    for f in facts:
        assert f.total_chunks == f.chunks_strong + f.chunks_moderate + f.chunks_weak + f.chunks_off_topic
        assert 0 <= f.coverage_score <= 100
    assert a.readiness.count() == a.score_card.count() == a.step_report.count() == 6
    assert a.diagnostics.count() == 12 and a.section_summaries.count() == 12
    assert a.recommendation_targets.count() == a.recommendations.agg(F.sum("target_count")).first()[0]


def test_signals_are_read_where_they_are_shown(spark, queries):
    docs = spark.createDataFrame([(i, f"## Part\n{TEXT}\n" + "widgets " * i, "all") for i in range(3)], "doc_id long, text string, scope string")
    stored = []

    def keep(df):
        stored.append(df)
        return storage.materialize(df)

    rows = lambda df: sorted(map(repr, df.collect()))
    kept = analyze(docs, queries, HashedTerms(16), "auto")
    read = analyze(docs, queries, HashedTerms(16), "auto", keep, keep_signals=False)
    assert [sorted(set(df.columns) & {"chunks", "signals", "similarity"}) for df in stored] == [["chunks"], ["similarity"]]
    for name in ("recommendations", "recommendation_targets", "score_card", "next_steps", "readiness", "action_plan"):
        assert rows(getattr(read, name)) == rows(getattr(kept, name)), name


def test_stream_equals_batch(spark, queries, tmp_path):
    docs = spark.createDataFrame([(i, f"{TEXT} {i}", "all") for i in range(6)], "doc_id long, text string, scope string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    start_coverage(stream, queries, HashedTerms(16), out, str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(out).drop("batch")
    want = D.coverage(score_documents(docs, queries, HashedTerms(16)))
    columns = ["query_id", "doc_id", "total_chunks", "coverage_score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_chunk_table_gives_the_reports_of_its_documents(spark, queries):
    """Sections, intro, recommendations and, with the documents at hand, steps and readiness."""
    from topicgauge.operators import chunking

    docs = spark.createDataFrame(
        [(i, f"{TEXT}\n## Part {i}\n{TEXT}\n### Sub\n" + "widgets " * i + "\n## Other\nnothing of it", "all") for i in range(1, 5)],
        "doc_id long, text string, scope string",
    )
    whole = analyze(docs, queries, HashedTerms(16), "markdown")
    table = chunking.chunk_documents(docs, "markdown").drop("chunk_count")
    given = analyze_chunks(table, queries, HashedTerms(16), docs)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v  # noqa: E731  sums depend on the order of rows
    rows = lambda df: sorted(repr(sorted((k, plain(v)) for k, v in r.asDict().items())) for r in df.drop("document_char_count").collect())
    for name in ("numbers", "coverage", "section_summaries", "recommendations", "recommendation_targets", "next_steps", "step_targets", "readiness", "score_card"):
        assert rows(getattr(whole, name)) == rows(getattr(given, name)), name
    ranks = lambda a: rows(a.diagnostics.select("query_id", "doc_id", "chunk_index", "similarity_rank", "text_preview", "is_max"))
    assert ranks(whole) == ranks(given) and len(ranks(whole)) > 0
    bare = analyze_chunks(table.select("doc_id", "chunk_index", "text", "scope"), queries, HashedTerms(16))
    assert bare.readiness.count() == 0 and rows(bare.coverage) == rows(whole.coverage)
    blank = analyze_chunks(spark.createDataFrame([(1, 0, " ", "all")], "doc_id long, chunk_index int, text string, scope string"), queries, HashedTerms(16))
    assert blank.rejects.count() == 1 and blank.empty_reports.filter("reason IS NOT NULL").count() == blank.asked.count() > 0


def test_one_pass_over_the_text(spark, queries, tmp_path):
    """Reports read the stored tables only: no plan of theirs scans the documents."""
    path = str(tmp_path / "corpus_of_this_test")
    spark.createDataFrame([(i, f"## Part\n{TEXT}", "all") for i in range(3)], "doc_id long, text string, scope string").write.parquet(path)
    a = analyze(spark.read.parquet(path), queries, HashedTerms(16), "markdown")
    for report in (a.recommendations, a.readiness, a.next_steps, a.action_plan, a.diagnostics):
        assert "corpus_of_this_test" not in report._jdf.queryExecution().executedPlan().toString()


def test_a_rewritten_text_is_written_once(spark):
    """A filter on it would be pushed below the projection that writes it, with the rewriting inside."""
    docs = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "doc_id long, text string").repartition(2, "doc_id")
    kept = readers.accepted_documents(docs.withColumn("text", F.regexp_replace("text", "a", "c")))
    assert kept.columns == ["doc_id", "text"] and [tuple(r) for r in kept.collect()] == [(1, "c b")]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
