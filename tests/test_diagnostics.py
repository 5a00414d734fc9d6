import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.reports import by_doc, scored
from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.operators import diagnostics as D
from topicgauge.operators import ranking, sections

MIXED = [0.85, 0.72, 0.48, 0.25]


@pytest.fixture(scope="module")
def table(spark):
    return scored(spark, {1: MIXED, 2: [0.70, 0.70, 0.70], 3: [0.60]}).cache()


def test_summary(table):
    s = by_doc(D.diagnostic_summary(ranking.rank_chunks(table)))
    assert s[1].median_similarity == pytest.approx(0.60)
    assert (s[1].percent_strong, s[1].percent_on_topic, s[1].coverage_score) == pytest.approx((25, 75, 45))
    assert s[1].std_similarity == pytest.approx(statistics.stdev(MIXED))
    assert [s[1][f"chunks_{b}"] for b in ("strong", "moderate", "weak", "off_topic")] == [1, 1, 1, 1]
    assert s[2].coverage_score == pytest.approx(60) and s[2].coverage_label == "Moderate"
    assert (s[3].std_similarity, s[3].median_similarity, s[3].is_single_chunk) == (0.0, 0.60, True)
    assert (s[1].document_token_count, s[1].document_char_count) == (40, 100)


def test_chunk_diagnostics(table):
    rows = {(r.doc_id, r.chunk_index): r for r in D.diagnose(table).collect()}
    assert [rows[1, i].similarity_rank for i in range(4)] == [1, 2, 3, 4]
    assert [rows[1, i].position_percent for i in range(4)] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert [rows[1, i].normalized_score for i in range(4)] == pytest.approx([1, 0.47 / 0.6, 0.23 / 0.6, 0])
    assert [rows[2, i].similarity_rank for i in range(3)] == [1, 2, 3]
    assert all(rows[2, i].is_max and rows[2, i].is_min and rows[2, i].normalized_score == 0.5 for i in range(3))
    assert rows[3, 0].position_percent == 0
    assert [rows[1, i].above_moderate_threshold for i in range(4)] == [True, True, False, False]
    assert [rows[1, i].below_weak_threshold for i in range(4)] == [False, False, False, True]


def test_short_query_bands(spark):
    t = scored(spark, {1: [0.75, 0.61, 0.43]}, S.SHORT_QUERY_BANDS)
    assert [r.interpretation for r in t.orderBy("chunk_index").collect()] == ["Strong", "Moderate", "Weak"]
    assert by_doc(D.coverage(t))[1].chunks_off_topic == 0


@pytest.mark.parametrize("descending", [True, False])
def test_hot_reports_rank_like_others(spark, monkeypatch, descending):
    rng = random.Random(3)
    levels = [-1.0, -0.5, -0.0, 0.0, 1 / 3, 0.2500001, 0.25, 1.0]
    reports = {d: [rng.choice(levels) if rng.random() < 0.5 else rng.uniform(-1, 1) for _ in range(60 * d)] for d in (1, 2, 3)}
    t = scored(spark, reports)
    key = ("doc_id", "chunk_index", "similarity_rank", "report_chunks", "report_min", "report_max")

    def ranks(pre_chunked):
        return sorted(map(tuple, ranking.rank_chunks(t, pre_chunked, descending).select(*key).collect()))

    assert ranks(False) == ranks(True)
    monkeypatch.setattr(ranking, "_BLOCK_ROWS", 5)  # cells of ties are split further
    assert ranks(False) == ranks(True)
    best = sorted(range(180), key=lambda i: -reports[3][i] if descending else reports[3][i])
    want = {i: n + 1 for n, i in enumerate(best)}
    assert {r[1]: r[2] for r in ranks(True) if r[0] == 3} == want


def test_positions_without_a_group_window(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_BLOCK_ROWS", 4)
    rows = spark.createDataFrame([(i % 3, i * 7 % 101) for i in range(101)], "g int, v int")
    got = ranking.position_in_group(rows, "g", "v", "p").collect()
    for g in range(3):
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.p)] == sorted(r.v for r in got if r.g == g)
        assert sorted(r.p for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_views(table):
    def index(df):
        return sorted((r.doc_id, r.chunk_index) for r in df.collect())

    assert index(D.above(table, 0.72)) == [(1, 0), (1, 1)]
    assert index(D.below(table, 0.48)) == [(1, 3)]
    assert index(D.in_range(table, 0.48, 0.70)) == [(1, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    assert index(D.strong_chunks(table)) == [(1, 0)]
    assert index(D.weak_or_off_topic_chunks(table)) == [(1, 2), (1, 3), (3, 0)]
    assert index(D.off_topic_chunks(table)) == [(1, 3)]
    assert index(D.filter_by(table, F.col("chunk_index") == 2)) == [(1, 2), (2, 2)]
    assert index(D.filter_by(table, lambda rows: rows.chunk_index == 2)) == [(1, 2), (2, 2)]
    few = table.select("doc_id", "chunk_index", F.when(F.col("chunk_index") != 1, F.col("similarity")).alias("similarity"))
    assert index(D.filter_by(few, lambda rows: rows.similarity.where(rows.similarity.notna()) > 0.7, ["similarity"])) == [(1, 0)]
    unsure = D.filter_by(few, lambda rows: (rows.chunk_index > 0).where(rows.chunk_index != 2, None), ["chunk_index"])
    assert index(unsure) == [(1, 1), (1, 3), (2, 1)]  # null rejects
    assert D.filter_by(few.limit(0), lambda rows: rows.similarity > 0, ["similarity"]).isEmpty()
    assert index(D.max_chunk(table)) == [(1, 0), (2, 0), (3, 0)]
    assert index(D.min_chunk(table)) == [(1, 3), (2, 0), (3, 0)]
    assert index(D.get_chunk(table, 1)) == [(1, 1), (2, 1)]
    assert index(ranking.top_n(table, 2)) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert index(D.bottom_n(table, 2)) == [(1, 2), (1, 3), (2, 0), (2, 1), (3, 0)]
    assert {r.doc_id for r in D.drift_rows(table).collect()} == {1, 2}
    assert [r.bar_height for r in D.drift_rows(table.filter("doc_id = 1")).orderBy("chunk_index").collect()] == [54, 46, 31, 16]
    assert not any(r.is_hierarchical for r in D.hierarchical_reports(table).collect())


def test_sorted_views(table):
    order = [r.chunk_index for r in D.sorted_view(table.filter("doc_id = 1"), "similarity_asc").collect()]
    assert order == [3, 2, 1, 0]
    assert [r.chunk_index for r in D.sorted_view(table.filter("doc_id = 2"), "similarity_desc").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        D.sorted_view(table, "by_length")


def test_sequences_are_segmented(table):
    rows = D.sequences(D.diagnose(table)).filter("doc_id = 1").collect()
    assert [(r.segment, r.similarities) for r in rows] == [(0, MIXED)]
    rows = D.sequences(D.diagnose(table), segment_rows=3).filter("doc_id = 1").orderBy("segment").collect()
    assert [r.similarities for r in rows] == [MIXED[:3], MIXED[3:]]


def test_sections(spark):
    t = scored(spark, {1: [
        (0.85, "macro", "Intro", None), (0.82, "atomic", None, 0), (0.30, "macro", "Weather", None),
        (0.25, "atomic", None, 2), (0.28, "micro", "Sun", 2), (0.5, "atomic", None, None),
    ]}).cache()
    s = {r.section_index: r for r in sections.section_summaries(t).collect()}
    assert sorted(s) == [0, 2, 4]
    assert (s[0].chunk_count, s[0].coverage_score, s[0].heading, s[0].level) == (2, 100, "Intro", "macro")
    assert (s[2].chunk_count, s[2].coverage_score, s[4].chunk_count) == (3, 0, 1)
    assert s[2].avg_similarity == pytest.approx((0.30 + 0.25 + 0.28) / 3)
    assert s[0].total_words == 8
    keys = {r.chunk_index: (r.section_key, r.leads_section) for r in sections.chunks_by_section(t).collect()}
    assert keys == {0: (0, True), 1: (0, False), 2: (2, True), 3: (2, False), 4: (2, False), 5: (None, False)}
    heat = {r["index"]: list(r.children) for r in sections.hierarchy_heatmap(D.diagnose(t)).collect()}
    assert heat == {0: [1], 1: [], 2: [3, 4], 3: [], 4: [], 5: []}
    assert by_doc(D.hierarchical_reports(t))[1].is_hierarchical


def test_flat_report_has_no_sections(table):
    assert sections.section_summaries(table).count() == 0


def test_coverage_labels(spark):
    t = scored(spark, {1: [0.9] * 4 + [0.1], 2: [0.7], 3: [0.7, 0.7, 0.5], 4: [0.1]})
    got = {d: (r.coverage_label, r.coverage_rounded) for d, r in by_doc(D.coverage(t)).items()}
    assert got == {1: ("Strong", 80), 2: ("Moderate", 60), 3: ("Weak", 47), 4: ("Low", 0)}


def test_previews_are_as_long_as_what_was_kept(spark):
    chunks = spark.createDataFrame([(1, 0, "word " * 100)], "doc_id long, chunk_index int, text string")
    long = D.with_text_facts(chunks, lead_chars=300).select(D.preview(300).alias("p")).first().p
    assert long == ("word " * 60).rstrip() + "..."
    with pytest.raises(Exception, match="lead_chars=300"):
        D.with_text_facts(chunks).select(D.preview(300)).collect()


def test_best_chunk_is_the_first_of_the_most_similar(spark):
    t = scored(spark, {1: [0.1, 0.7, 0.7, -0.2], 2: [-0.5, -0.25, -0.25], 3: [0.0, 0.0], 4: [1.0, -1.0, 1.0]})
    assert {d: r.max_similarity_chunk_index for d, r in by_doc(D.compare(t)).items()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {d: r.best_chunk_index for d, r in by_doc(D.report_numbers(t)).items()} == {1: 1, 2: 1, 3: 0, 4: 0}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_are_aggregated_by_hash(table):
    for df in (D.compare(table), D.report_numbers(table), D.coverage(table)):
        assert "HashAggregate" in _plan(df) and "SortAggregate" not in _plan(df)


def test_sections_read_the_scored_rows_once(spark):
    """Rows of an id that comes twice count twice, and each opening row gives its section once; a null id has none."""
    rows = [(1, d, i, "macro" if i == 0 else "micro", h, None if i == 0 else 0, s, 2) for d, i, h, s in [
        (5, 0, "A", 0.9), (5, 0, "B", 0.7), (5, 1, "C", 0.1), (None, 0, "D", 0.5), (6, 1, "E", 0.5)]]
    schema = "query_id long, doc_id long, chunk_index int, level string, heading string, parent_index int, similarity double, word_count int"
    scored = spark.createDataFrame(rows, schema).withColumn("bands", B.band_struct(S.STANDARD_BANDS))
    found = sections.section_summaries(scored)
    got = sorted((r.doc_id, r.section_index, r.heading, r.level, r.chunk_count, r.total_words) for r in found.collect())
    assert got == [(5, 0, "A", "macro", 3, 6), (5, 0, "B", "macro", 3, 6), (5, 1, "C", "micro", 1, 2), (6, 1, "E", "micro", 1, 2)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
