import pytest

from tests.reports import by_doc, scored
from topicgauge.operators import diagnostics as D
from topicgauge.operators import nextsteps as N
from topicgauge.operators import readiness, recommendations
from topicgauge.plans.analysis import action_plan, score_card

BARE = {
    "word_count": 500, "h2_count": 0, "h3_count": 0, "link_count": 0, "table_like_lines": 0, "has_faq": False, "has_tldr": False,
    "has_sources_section": False, "has_steps": False, "has_definition_near_top": False, "has_examples": False,
    "has_comparison_language": False, "has_freshness_signals": False, "numeric_density": 0.0, "intro_query_term_coverage": 0.0,
    "intent": "informational",
}
FULL = BARE | {
    "h2_count": 4, "h3_count": 2, "link_count": 3, "has_faq": True, "has_tldr": True, "has_sources_section": True,
    "has_examples": True, "has_definition_near_top": True, "numeric_density": 0.4, "intro_query_term_coverage": 1.0,
}


def reports(spark, cases):
    """``{doc_id: (similarities, signals)}`` as facts joined with signals."""
    t = scored(spark, {d: sims for d, (sims, _) in cases.items()})
    rows = [(1, d, *s.values()) for d, (_, s) in cases.items()]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    schema = "query_id long, doc_id long, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in BARE.items())
    facts = recommendations.with_low_sections(D.report_facts(t), None)
    return t, N.with_signals(facts, spark.createDataFrame(rows, schema))


def test_steps(spark):
    cases = {
        1: ([0.30, 0.40, 0.85, 0.20], BARE),
        2: ([0.9, 0.9, 0.9], FULL),
        3: ([0.9, 0.5, 0.5], FULL | {"intent": "how_to", "word_count": 800, "has_tldr": False}),
        4: ([0.9, 0.9, 0.9], BARE | {"intent": "commercial", "intro_query_term_coverage": 1.0, "word_count": 1000}),
        5: ([0.1], BARE | {"word_count": 0}),
    }
    t, r = reports(spark, cases)
    steps = N.next_steps(r).cache()
    got = {}
    for s in steps.orderBy("doc_id", "position").collect():
        got.setdefault(s.doc_id, []).append((s.step, s.priority, s.minutes, s.target_count))
    assert got[1] == [
        ("add_definition", "high", 10, 0), ("front_load", "high", 15, 3), ("reduce_drift", "high", 20, 3),
        ("add_evidence", "medium", 15, 0), ("add_examples", "medium", 15, 0), ("add_headings", "medium", 20, 0),
        ("add_faq", "medium", 25, 0),
    ]
    assert 2 not in got
    assert got[3] == [("add_steps", "high", 25, 0), ("strengthen_weak", "medium", 25, 2), ("add_summary_box", "low", 10, 0)]
    assert got[4] == [
        ("add_evidence", "medium", 15, 0), ("add_headings", "medium", 20, 0), ("add_comparison", "medium", 30, 0),
        ("add_summary_box", "low", 10, 0), ("add_examples", "low", 15, 0), ("add_faq", "low", 25, 0),
    ]
    assert [s[0] for s in got[5]] == ["add_definition", "front_load", "reduce_drift"]
    targets = {}
    for s in N.step_targets(steps, t).collect():
        targets.setdefault((s.doc_id, s.step), []).append(s.chunk_index)
    assert sorted(targets[1, "reduce_drift"]) == [0, 1, 3] and sorted(targets[3, "strengthen_weak"]) == [1, 2]
    assert (2, "front_load") not in targets
    assert all(s.title and s.why and s.how for s in steps.collect())
    weak = next(s for s in steps.collect() if (s.doc_id, s.step) == (3, "strengthen_weak"))
    assert weak.why == "2 chunks score from 0.45 to 0.65."
    assert by_doc(N.step_report(r))[2].summary.startswith("Coverage is 80 or more")
    assert N.next_steps(r, max_steps=2).filter("doc_id = 1").count() == 2


def test_steps_are_worked_out_once(spark):
    t, r = reports(spark, {1: ([0.30, 0.40, 0.85, 0.20], BARE), 2: ([0.9, 0.5], FULL)})
    targets = N.step_targets(N.next_steps(r), t)
    plan = targets._jdf.queryExecution().optimizedPlan().toString()
    # the steps of a report once, not once per kind of target, and without the wording that targets do not show
    assert plan.count("posexplode(") == 1 and "format_string" not in plan
    assert sorted((x.doc_id, x.step, x.chunk_index) for x in targets.collect()) == [
        (1, "front_load", 0), (1, "front_load", 1), (1, "front_load", 2), (1, "reduce_drift", 0), (1, "reduce_drift", 1),
        (1, "reduce_drift", 3), (2, "strengthen_weak", 1),
    ]


def test_targets_of_a_document_that_comes_twice(spark):
    t, r = reports(spark, {1: ([0.30, 0.40, 0.85, 0.20], BARE)})
    once, twice = (N.step_targets(N.next_steps(a), b) for a, b in ((r, t), (r.union(r), t.union(t))))
    steps = [(x.step, x.chunk_index) for x in twice.collect()]
    assert steps.count(("front_load", 0)) == 2 and steps.count(("front_load", 2)) == 2
    assert len([s for s, _ in steps if s == "reduce_drift"]) == 5
    assert once.count() == 6


def test_intro_band(spark):
    sims = [0.1, 0.2, 0.3, 0.9, 0.9, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4]
    _, r = reports(spark, {1: (sims, BARE), 2: ([0.1, 0.5], BARE), 3: ([0.2], BARE)})
    got = {d: (x.intro_chunks, x.best_chunk_index, x.best_position) for d, x in by_doc(N.intro_band(r)).items()}
    assert got == {1: (3, 3, pytest.approx(0.3)), 2: (2, 1, 1.0), 3: (1, 0, 0.0)}
    assert by_doc(N.intro_band(r))[1].intro_similarity == pytest.approx(0.2)


def test_readiness(spark):
    strong = [0.90, 0.85, 0.88]
    cases = {
        1: ([0.30, 0.35], BARE), 2: (strong, FULL), 3: ([0.9], FULL | {"h2_count": 10, "link_count": 10}),
        4: (strong, BARE | {"h2_count": 2}), 5: (strong, BARE | {"h2_count": 2, "intent": "how_to"}),
        6: (strong, BARE | {"h2_count": 2, "intent": "how_to", "has_steps": True}),
        7: ([0.90, 0.50, 0.50], BARE), 8: ([0.50, 0.50, 0.90], BARE), 9: ([0.1, 0.2], FULL),
    }
    got = by_doc(readiness.readiness(reports(spark, cases)[1]))
    assert got[1].score < 40 and got[1].interpretation == "Not ready"
    assert got[2].score == pytest.approx(100) and got[2].interpretation == "AI-ready"
    assert all(0 <= got[3][c] <= 100 for c in ("coverage", "structure", "evidence", "answerability", "score"))
    assert got[4].structure == pytest.approx(50) and got[5].structure == pytest.approx(35)
    assert got[6].structure == got[4].structure
    assert got[7].answerability > got[8].answerability
    assert got[2].score - got[9].score >= 40
    assert got[1].score_rounded == round(got[1].score)


def test_action_plan_and_score_card(spark):
    t, r = reports(spark, {1: ([0.30, 0.40, 0.85, 0.20], BARE), 2: ([0.9], FULL)})
    facts = r.drop("intent")
    plan = action_plan(N.next_steps(r), recommendations.recommendations(facts)).orderBy("number").collect()
    assert [p.number for p in plan] == list(range(1, len(plan) + 1))
    assert [p.source for p in plan] == ["next_step"] * 7 + ["recommendation"] * 3
    card = by_doc(score_card(facts))
    assert card[1].potential_gain == pytest.approx(15) and card[2].potential_gain is None
    assert card[2].is_single_chunk and not card[2].is_short_topic
