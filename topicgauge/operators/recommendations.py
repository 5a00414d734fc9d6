"""Recommendations for raising the coverage score.

Headers need only report aggregates. Target chunks are rows of their own, so a report whose
off-topic band is huge never becomes one huge list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import guidance
from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.operators.candidates import priority, ranked_rows
from topicgauge.operators.diagnostics import in_band, off_topic_chunks, preview, weak_or_off_topic_chunks, with_lead
from topicgauge.operators.ranking import REPORT, first_n

TYPES = ("rewrite_off_topic", "strengthen_weak", "expand_strong", "restructure_section", "remove_dilution")


def with_low_sections(facts: DataFrame, low_sections: DataFrame | None) -> DataFrame:
    """Attach section findings; flat reports have none."""
    if low_sections is None:
        return facts.withColumn("low_sections", F.lit(0))
    joined = facts.join(low_sections, list(REPORT), "left")
    return joined.withColumn("low_sections", F.coalesce("low_sections", F.lit(0)))


def _share(count: str) -> Column:
    return F.col(count) / F.col("total_chunks")


def diluted() -> Column:
    return (
        (F.col("chunks_strong") > 0)
        & (F.col("chunks_off_topic") > 0)
        & (_share("chunks_strong") >= S.DILUTION_SHARE)
        & (_share("chunks_off_topic") >= S.DILUTION_SHARE)
    )


def _short(n: Column) -> Column:
    return F.least(n, F.lit(S.SHORT_TARGET_LIST))


def recommendations(facts: DataFrame) -> DataFrame:
    """At most five rows per report with their wording, from :func:`with_low_sections` output."""
    off, weak, strong = F.col("chunks_off_topic"), F.col("chunks_weak"), F.col("chunks_strong")
    example = F.col("best_example")
    none = F.lit(None).cast("string")
    urgent = F.when(_share("chunks_off_topic") > S.OFF_TOPIC_HIGH_SHARE, 1).otherwise(2)
    # (type, condition, priority order, number of targets, example)
    found = (
        ("rewrite_off_topic", off > 0, urgent, off, example),
        ("strengthen_weak", weak > 0, F.lit(2), weak, example),
        ("expand_strong", (strong > 0) & (off + weak > 0), F.lit(3), _short(off + weak), example),
        ("restructure_section", F.col("low_sections") > 0, F.lit(2), F.col("low_sections"), none),
        ("remove_dilution", diluted(), F.lit(3), _short(off), none),
    )
    known = guidance.values(facts.columns)

    def worded(name: str) -> list[Column]:
        advice = guidance.RECOMMENDATIONS[name]
        return [guidance.fill(text, known).alias(part) for part, text in zip(("what", "why", "how"), advice, strict=True)]

    rules = [
        (
            cond,
            F.struct(
                order.alias("_order"),
                (-targets).alias("_fewer"),
                F.lit(no).alias("_rule"),
                F.lit(name).alias("rec_type"),
                targets.alias("target_count"),
                text.alias("example_text"),
                *worded(name),
            ),
        )
        for no, (name, cond, order, targets, text) in enumerate(found)
    ]
    rows = ranked_rows(facts, REPORT, rules, S.MAX_RECOMMENDATIONS, "position")
    return rows.withColumns(
        {"priority": priority(F.col("_order")), "estimated_impact": F.initcap(priority(F.col("_order")))}
    ).drop("_order", "_fewer", "_rule")


def targets(
    scored: DataFrame, facts: DataFrame, summaries: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Target chunks of every recommendation, one row each, whole bands included.

    Previews come from ``texts`` by key, where ``scored`` holds no text.
    """
    lead = [] if texts is not None else ["lead_text", "char_count"]

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(*REPORT, F.lit(kind).alias("rec_type"), "chunk_index", *lead, "similarity", "interpretation")

    key = list(REPORT)
    with_model = facts.filter(F.col("chunks_strong") > 0).select(*key)
    with_dilution = facts.filter(diluted()).select(*key)
    below, off = weak_or_off_topic_chunks(scored), off_topic_chunks(scored)
    out = (
        rows(off, "rewrite_off_topic")
        .unionByName(rows(scored.filter(in_band("weak")), "strengthen_weak"))
        .unionByName(rows(first_n(below, S.SHORT_TARGET_LIST).join(with_model, key, "left_semi"), "expand_strong"))
        .unionByName(rows(first_n(off, S.SHORT_TARGET_LIST).join(with_dilution, key, "left_semi"), "remove_dilution"))
    )
    if summaries is not None:
        low = summaries.filter(F.col("coverage_score") < S.LOW_SECTION_COVERAGE).select(
            *key, F.col("section_index").alias("chunk_index")
        )
        out = out.unionByName(rows(scored.join(low, [*key, "chunk_index"], "left_semi"), "restructure_section"))
    return with_lead(out, texts).select(
        *REPORT, "rec_type", "chunk_index", preview(S.TARGET_PREVIEW_CHARS).alias("text_preview"), "similarity", "interpretation"
    )


def potential_coverage() -> Column:
    """Coverage if off-topic chunks became weak and weak ones moderate.

    Whole bands are targets and five rules fit under the limit of five, so the order of the
    recommendations does not matter.
    """
    return B.coverage(
        F.col("chunks_strong"), F.col("chunks_moderate") + F.col("chunks_weak"), F.col("chunks_off_topic"), F.lit(0)
    )


def recommendation_report(facts: DataFrame) -> DataFrame:
    """Current and potential coverage, counts and a headline per report."""
    off, weak, strong = F.col("chunks_off_topic"), F.col("chunks_weak"), F.col("chunks_strong")
    holds = [off > 0, weak > 0, (strong > 0) & (off + weak > 0), F.col("low_sections") > 0, diluted()]
    number = sum((F.when(h, 1).otherwise(0) for h in holds), F.lit(0))
    score, gain = F.col("coverage_score"), F.col("potential_ccs") - F.col("coverage_score")
    high = F.col("high_priority_count")
    parts = F.concat_ws(
        ", ",
        F.when(high > 0, F.concat(high.cast("string"), F.lit(" of high priority"))),
        F.when(gain > 5, F.concat(F.lit("up to +"), F.bround(gain).cast("int").cast("string"), F.lit(" points"))),
        F.when(off > 0, F.concat(off.cast("string"), F.lit(" off-topic chunk(s)"))),
    )
    count = F.col("recommendation_count")
    some = F.concat(count.cast("string"), F.lit(" recommendation(s)"), F.when(parts != "", F.concat(F.lit(": "), parts)).otherwise(""))
    nothing = B.label_by_floor(score, guidance.NOTHING_TO_DO, guidance.LITTLE_TO_SAY)
    return (
        facts.withColumns(
            {
                "potential_ccs": potential_coverage(),
                "recommendation_count": number,
                "high_priority_count": F.when(_share("chunks_off_topic") > S.OFF_TOPIC_HIGH_SHARE, 1).otherwise(0),
            }
        )
        .withColumn("summary", F.when(count == 0, nothing).otherwise(some))
        .withColumn("has_recommendations", count > 0)
        .select(
            *REPORT, score.alias("current_ccs"), "potential_ccs", "recommendation_count", "high_priority_count",
            "has_recommendations", "summary",
        )
    )


def by_priority(rows: DataFrame, level: str) -> DataFrame:
    return rows.filter(F.col("priority") == level)
