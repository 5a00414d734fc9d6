import pytest

from tests.reports import by_doc, scored
from topicgauge.operators import diagnostics as D
from topicgauge.operators import recommendations as R
from topicgauge.operators import sections

REPORTS = {
    1: [0.85, 0.72, 0.50, 0.30],
    2: [0.85, 0.25, 0.28, 0.22],
    3: [0.88, 0.92, 0.85],
    4: [0.50, 0.55, 0.48],
    5: [0.88, 0.85, 0.25, 0.28, 0.70],
    6: [
        (0.85, "macro", "Introduction", None), (0.82, "atomic", None, 0), (0.30, "macro", "Weather", None),
        (0.25, "atomic", None, 2), (0.28, "atomic", None, 2),
    ],
    7: [0.9] * 8 + [0.1] * 7,
    8: [0.9] * 17 + [0.1] * 3,
}


@pytest.fixture(scope="module")
def parts(spark):
    t = scored(spark, REPORTS).cache()
    summaries = sections.section_summaries(t)
    facts = R.with_low_sections(D.report_facts(t), sections.low_sections(summaries)).cache()
    return t, summaries, facts


def _rows(df):
    out = {}
    for r in df.orderBy("doc_id", "position").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_rows_and_order(parts):
    got = {d: [(r.rec_type, r.priority, r.target_count) for r in rows] for d, rows in _rows(R.recommendations(parts[2])).items()}
    assert got[1] == [
        ("rewrite_off_topic", "high", 1), ("strengthen_weak", "medium", 1), ("expand_strong", "low", 2), ("remove_dilution", "low", 1),
    ]
    assert got[2] == [("rewrite_off_topic", "high", 3), ("expand_strong", "low", 3), ("remove_dilution", "low", 3)]
    assert 3 not in got
    assert got[4] == [("strengthen_weak", "medium", 3)]
    assert ("remove_dilution", "low", 2) in got[5]
    assert got[6][:2] == [("rewrite_off_topic", "high", 3), ("restructure_section", "medium", 1)]
    assert got[7] == [("rewrite_off_topic", "high", 7), ("expand_strong", "low", 5), ("remove_dilution", "low", 5)]
    # exactly 15 % is not above the threshold
    assert got[8][0] == ("rewrite_off_topic", "medium", 3)


def test_examples_come_from_the_best_strong_chunk(parts):
    rows = _rows(R.recommendations(parts[2]))
    by_type = {r.rec_type: r.example_text for r in rows[1]}
    assert by_type == {
        "rewrite_off_topic": "chunk 0 of 1", "strengthen_weak": "chunk 0 of 1", "expand_strong": "chunk 0 of 1", "remove_dilution": None,
    }
    assert rows[4][0].example_text is None


def test_targets(parts):
    t, summaries, facts = parts
    got = {}
    for r in R.targets(t, facts, summaries).collect():
        got.setdefault((r.doc_id, r.rec_type), []).append(r.chunk_index)
    got = {k: sorted(v) for k, v in got.items()}
    assert got[2, "rewrite_off_topic"] == [1, 2, 3]
    assert got[4, "strengthen_weak"] == [0, 1, 2]
    assert got[6, "restructure_section"] == [2]
    assert got[7, "rewrite_off_topic"] == list(range(8, 15))
    assert got[7, "expand_strong"] == got[7, "remove_dilution"] == list(range(8, 13))
    counts = {(r.doc_id, r.rec_type): r.target_count for r in R.recommendations(facts).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_report(parts):
    got = by_doc(R.recommendation_report(parts[2]))
    assert got[1].current_ccs == pytest.approx(45) and got[1].potential_ccs == pytest.approx((1 + 0.6 + 0.6 + 0.2) / 4 * 100)
    assert (got[1].recommendation_count, got[1].high_priority_count) == (4, 1)
    assert got[1].summary == "4 recommendation(s): 1 of high priority, up to +15 points, 1 off-topic chunk(s)"
    assert not got[3].has_recommendations and got[3].current_ccs == got[3].potential_ccs == 100
    assert all(r.potential_ccs >= r.current_ccs for r in got.values())


def test_wording_and_priority_filter(parts):
    recs = R.recommendations(parts[2])
    worded = recs.collect()
    assert all(r.what and r.why and r.how for r in worded)
    section = next(r for r in worded if r.rec_type == "restructure_section")
    assert section.what == "1 sections score below 40, the first of them 'Weather' with 0"
    weak = next(r for r in worded if r.doc_id == 4)
    assert weak.what == "3 chunks lie between 0.45 and 0.65"
    assert {r.priority for r in R.by_priority(recs, "low").collect()} == {"low"}
