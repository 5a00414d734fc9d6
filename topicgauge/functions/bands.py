"""Similarity bands, coverage arithmetic and score labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import text as X


def band_struct(bands: Mapping[str, float]) -> Column:
    return F.struct(*[F.lit(float(bands[k])).alias(k) for k in ("strong", "moderate", "weak")])


def bands_for_query(query: Column) -> Column:
    short = X.word_count(query) <= S.SHORT_QUERY_MAX_WORDS
    return F.when(short, band_struct(S.SHORT_QUERY_BANDS)).otherwise(band_struct(S.STANDARD_BANDS))


def interpret(similarity: Column, bands: Column) -> Column:
    """The band's label; null where there is no similarity."""
    strong, moderate, weak, off = S.BAND_LABELS
    return (
        F.when(similarity.isNull(), F.lit(None).cast("string"))
        .when(similarity >= bands["strong"], strong)
        .when(similarity >= bands["moderate"], moderate)
        .when(similarity >= bands["weak"], weak)
        .otherwise(off)
    )


def label_by_floor(score: Column, floors: tuple[tuple[float, str], ...], below: str) -> Column:
    out = F.lit(below)
    for floor, name in reversed(floors):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def coverage_label(score: Column) -> Column:
    return label_by_floor(score, S.COVERAGE_LABELS, S.COVERAGE_FLOOR_LABEL)


def readiness_label(score: Column) -> Column:
    return label_by_floor(score, S.READINESS_LABELS, S.READINESS_FLOOR_LABEL)


def weighted_sum(strong: Column, moderate: Column, weak: Column, off_topic: Column) -> Column:
    w = S.COVERAGE_WEIGHTS
    return (
        strong * F.lit(w["strong"])
        + moderate * F.lit(w["moderate"])
        + weak * F.lit(w["weak"])
        + off_topic * F.lit(w["off_topic"])
    )


def coverage(strong: Column, moderate: Column, weak: Column, off_topic: Column) -> Column:
    """0-100 score; 0 for a report without chunks."""
    total = strong + moderate + weak + off_topic
    return F.when(total > 0, weighted_sum(strong, moderate, weak, off_topic) / total * 100.0).otherwise(F.lit(0.0))
