"""Editorial next steps: report aggregates and content signals to prioritized rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import guidance
from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.operators.candidates import priority, ranked_rows
from topicgauge.operators.diagnostics import in_band, preview, with_lead
from topicgauge.operators.ranking import REPORT, first_n
from topicgauge.operators.signals import with_query_signals

#: Chunks listed for an opening that needs work.
OPENING_CHUNKS = 3


def with_signals(facts: DataFrame, signals: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Report aggregates and signals side by side.

    With ``queries`` (from :func:`with_query_facts`) the signals are one row per document: they meet
    the reports on ``doc_id``, and what depends on the query is worked out beside them. Without, they
    are one row per report already.
    """
    if queries is None:
        return facts.join(signals, list(REPORT))
    asked = queries.select("query_id", "terms", "intent")
    return with_query_signals(facts.join(signals.drop("scope"), "doc_id").join(asked, "query_id"))


def intro_band(facts: DataFrame) -> DataFrame:
    return facts.select(*REPORT, "intro_chunks", "intro_similarity", "best_chunk_index", "best_position")


def _front_load() -> Column:
    return (
        (F.col("intro_query_term_coverage") < 0.5)
        | (F.col("best_position") > 0.4)
        | (F.col("intro_similarity") + 0.05 < F.col("avg_similarity"))
    )


def _off_share() -> Column:
    return F.col("chunks_off_topic") / F.col("total_chunks")


def next_steps(reports: DataFrame, max_steps: int = S.MAX_NEXT_STEPS) -> DataFrame:
    """Up to ``max_steps`` rows per report, with their wording: by priority, then minutes, then rule order."""
    score, words, intent = F.col("coverage_score"), F.col("word_count"), F.col("intent")
    weak, off, n = F.col("chunks_weak"), F.col("chunks_off_topic"), F.col("total_chunks")

    def order(urgent: Column, high: int = 1) -> Column:
        return F.when(urgent, high).otherwise(high + 1)

    none = F.lit(0)
    # (step, condition, priority order, minutes, number of target chunks)
    found = (
        ("front_load", _front_load(), F.lit(1), 15, F.least(n, F.lit(OPENING_CHUNKS))),
        (
            "add_definition",
            intent.isin("informational", "how_to") & ~F.col("has_definition_near_top"),
            order(score < 70), 10, none,
        ),
        ("reduce_drift", _off_share() >= 0.10, order(_off_share() >= 0.15), 20, F.least(off, F.lit(S.SHORT_TARGET_LIST))),
        ("strengthen_weak", weak > 0, F.lit(2), 25, F.least(weak, F.lit(S.SHORT_TARGET_LIST))),
        ("add_steps", (intent == "how_to") & ~F.col("has_steps"), order(score < 70), 25, none),
        (
            "add_comparison",
            (intent == "commercial") & ~F.col("has_comparison_language") & (words >= 400),
            F.lit(2), 30, none,
        ),
        ("add_headings", (F.col("h2_count") + F.col("h3_count") == 0) & (words >= 400), F.lit(2), 20, none),
        (
            "add_evidence",
            ((F.col("link_count") == 0) | ~F.col("has_sources_section")) & (words >= 300),
            F.lit(2), 15, none,
        ),
        ("add_examples", ~F.col("has_examples") & (words >= 400), order(score < 80, 2), 15, none),
        ("add_faq", ~F.col("has_faq") & (words >= 500), order(score < 70, 2), 25, none),
        ("add_summary_box", ~F.col("has_tldr") & (words >= 700), F.lit(3), 10, none),
    )
    known = guidance.values(reports.columns)
    rules = [
        (
            cond,
            F.struct(rank.alias("_order"), F.lit(minutes).alias("minutes"), F.lit(no).alias("_rule"), targets.alias("target_count")),
        )
        for no, (_, cond, rank, minutes, targets) in enumerate(found)
    ]
    # worded after the limit, from values that stand beside the report: who asks for no wording spares it
    valued = reports.withColumns({f"_value_{name}": value for name, value in known.items()})
    values = {name: F.col(f"_value_{name}") for name in known}
    rows = ranked_rows(valued, (*REPORT, *(f"_value_{name}" for name in known)), rules, max_steps, "position")
    names = [name for name, *_ in found]

    def by_rule(value: Callable[[guidance.Step], Column]) -> Column:
        out = F.lit(None).cast("string")
        for no, name in reversed([*enumerate(names)]):
            out = F.when(F.col("_rule") == no, value(guidance.NEXT_STEPS[name])).otherwise(out)
        return out

    return rows.select(
        *REPORT, "position", "minutes",
        F.element_at(F.array(*map(F.lit, names)), F.col("_rule") + 1).alias("step"),
        "target_count",
        by_rule(lambda text: F.lit(text.title)).alias("title"),
        by_rule(lambda text: guidance.fill(text.why, values)).alias("why"),
        by_rule(lambda text: guidance.fill(text.how, values)).alias("how"),
        by_rule(lambda text: F.lit(text.example).cast("string")).alias("example"),
        priority(F.col("_order")).alias("priority"),
    )


def step_targets(steps: DataFrame, scored: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Target chunks of the steps that name some, one row each; previews from ``texts`` where ``scored`` holds none."""
    lead = [] if texts is not None else ["lead_text", "char_count"]
    shown = [*REPORT, "step", "chunk_index", *lead, "similarity", "interpretation"]
    opening = scored.filter(F.col("chunk_index") < OPENING_CHUNKS).withColumn("step", F.lit("front_load"))
    low = F.when(in_band("off_topic"), "reduce_drift").when(in_band("weak"), "strengthen_weak")
    banded = scored.withColumn("step", low).filter(F.col("step").isNotNull())
    listed = opening.select(*shown).unionByName(first_n(banded, S.SHORT_TARGET_LIST, "step").select(*shown))
    # distinct steps and a plain join: a semi join would move into the union, with all that steps are made of once per branch
    found = steps.filter(F.col("step").isin("front_load", "reduce_drift", "strengthen_weak")).select(*REPORT, "step").distinct()
    return with_lead(listed.join(found, [*REPORT, "step"]), texts).select(
        *REPORT, "step", "chunk_index", preview(S.TARGET_PREVIEW_CHARS).alias("text_preview"), "similarity", "interpretation"
    )


def step_report(reports: DataFrame) -> DataFrame:
    """Headline and intent per report."""
    headline = B.label_by_floor(F.col("coverage_score"), guidance.HEADLINES, guidance.LOWEST_HEADLINE)
    return reports.select(*REPORT, "intent", headline.alias("summary"))


def empty_reports(unanswered: DataFrame, signals: DataFrame, queries: DataFrame) -> DataFrame:
    """Reports of asked ``(query_id, doc_id, reason)`` pairs without any chunk: score 0, the lowest label.

    They have the query's intent and the document's signals like any other; a document without text has none of them.
    """
    counts = {f"chunks_{b}": F.lit(0) for b in ("strong", "moderate", "weak", "off_topic")}
    zero = F.lit(0.0)
    numbers = unanswered.select(*REPORT, "reason").withColumns(
        {
            "total_chunks": F.lit(0), **counts, "coverage_score": zero, "coverage_label": B.coverage_label(zero),
            "coverage_rounded": F.lit(0), "best_position": F.lit(1.0), "summary": F.lit(guidance.EMPTY_REPORT),
        }
    )
    found = [f for f in signals.drop("scope").schema.fields if f.name not in ("doc_id", "_found")]
    nothing = {"boolean": F.lit(False), "string": F.lit("")}
    known = numbers.join(signals.select("doc_id", *[f.name for f in found]), "doc_id", "left")
    filled = known.withColumns(
        {f.name: F.coalesce(f.name, nothing.get(f.dataType.simpleString(), F.lit(0).cast(f.dataType))) for f in found}
    )
    return with_query_signals(filled.join(queries.select("query_id", "terms", "intent"), "query_id"))
