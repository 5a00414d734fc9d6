"""Composite readiness score: coverage blended with structure, evidence and answerability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.operators.ranking import REPORT


def _points(*terms: Column) -> Column:
    """Sum in the given order, capped at 1."""
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return F.least(total, F.lit(1.0))


def _if(cond: Column, points: float) -> Column:
    return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))


def _graded(count: Column, several: float, one: float) -> Column:
    return F.when(count >= 2, F.lit(several)).when(count == 1, F.lit(one)).otherwise(F.lit(0.0))


def readiness_components(reports: DataFrame) -> DataFrame:
    """Components on a 0-100 scale, from facts joined with signals."""
    structure = _points(
        _graded(F.col("h2_count"), 0.35, 0.15),
        _if(F.col("h3_count") >= 1, 0.15),
        _if(F.col("has_tldr"), 0.20),
        _if(F.col("has_faq"), 0.15),
        _if(F.col("has_steps") | (F.col("intent") != "how_to"), 0.15),
    )
    evidence = _points(
        _graded(F.col("link_count"), 0.40, 0.20),
        _if(F.col("has_sources_section"), 0.30),
        _if(F.col("has_examples"), 0.20),
        _if(F.col("numeric_density") >= 0.2, 0.10),
    )
    answerability = _points(
        _if(F.col("has_definition_near_top"), 0.40),
        F.lit(0.40) * F.col("intro_query_term_coverage"),
        _if(F.col("best_position") <= 0.4, 0.20),
    )
    return reports.select(
        *REPORT,
        (F.col("coverage_score") / 100.0).alias("_coverage"),
        structure.alias("_structure"),
        evidence.alias("_evidence"),
        answerability.alias("_answerability"),
    ).select(
        *REPORT, "_coverage", "_structure", "_evidence", "_answerability",
        *[(F.col(f"_{c}") * 100.0).alias(c) for c in S.READINESS_WEIGHTS],
    )


def readiness(reports: DataFrame) -> DataFrame:
    blend = F.lit(0.0)
    for name, weight in S.READINESS_WEIGHTS.items():
        blend = blend + F.lit(weight) * F.col(f"_{name}")
    score = F.col("score")
    return (
        readiness_components(reports)
        .withColumn("score", F.lit(100.0) * blend)
        .withColumns({"interpretation": B.readiness_label(score), "score_rounded": F.bround(score).cast("int")})
        .drop(*[f"_{c}" for c in S.READINESS_WEIGHTS])
    )
