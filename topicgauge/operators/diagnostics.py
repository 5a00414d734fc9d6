"""Chunk diagnostics, report aggregates and the views over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.functions import text as X
from topicgauge.functions.order import order_key
from topicgauge.operators.ranking import REPORT, rank_chunks, top_n

def position_percent() -> Column:
    """Needs no window: a document's chunk count is known when it is cut."""
    n = F.col("chunk_count")
    return F.when(n > 1, F.col("chunk_index") / (n - 1)).otherwise(F.lit(0.0))


# --- chunk level ----------------------------------------------------------------


def with_text_facts(chunks: DataFrame, lead_chars: int = S.EXAMPLE_CHARS) -> DataFrame:
    """What later steps need of the text, so that the text itself is neither shuffled nor stored.

    Every preview is cut from ``lead_text``, the first ``lead_chars`` characters of the chunk.
    """
    t = F.col("text")
    return chunks.withColumns(
        {"lead_text": F.substring(t, 1, lead_chars), "char_count": F.length(t), "word_count": X.word_count(t)}
    )


def preview(chars: int) -> Column:
    """A preview of any length up to the ``lead_chars`` that were kept; asking for more fails the job."""
    lead, size = F.col("lead_text"), F.col("char_count")
    enough = F.length(lead) >= F.least(F.lit(chars), size)
    short = F.raise_error(F.lit(f"a preview of {chars} characters needs lead_chars={chars}")).cast("string")
    return F.when(enough | lead.isNull(), X.preview(lead, chars, size)).otherwise(short)


def with_lead(rows: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Rows beside the beginning of their chunk: their own, or looked up in a table of chunk texts.

    Scored rows are kept without text, because they are repeated once per query.
    """
    if texts is None:
        return rows
    found = [c for c in ("lead_text", "char_count", "level", "heading", "depth") if c in texts.columns]
    return rows.drop(*found).join(texts.select("doc_id", "chunk_index", *found), ["doc_id", "chunk_index"], "left")


def normalized_score() -> Column:
    spread = F.col("report_max") - F.col("report_min")
    return F.when(spread == 0, F.lit(0.5)).otherwise((F.col("similarity") - F.col("report_min")) / spread)


def chunk_diagnostics(ranked: DataFrame, preview_chars: int = S.PREVIEW_CHARS) -> DataFrame:
    """One wide row per scored chunk, from :func:`rank_chunks` output."""
    s, bands = F.col("similarity"), F.col("bands")
    shown = {} if "text_preview" in ranked.columns else {"text_preview": preview(preview_chars)}
    return ranked.withColumns(
        {
            **shown,
            "normalized_score": normalized_score(),
            "position_percent": position_percent(),
            "is_max": s == F.col("report_max"),
            "is_min": s == F.col("report_min"),
            "above_strong_threshold": s >= bands["strong"],
            "above_moderate_threshold": s >= bands["moderate"],
            "below_weak_threshold": s < bands["weak"],
        }
    ).drop("report_min", "report_max", "report_chunks", "lead_text")


def diagnose(
    scored: DataFrame, pre_chunked: bool = False, texts: DataFrame | None = None, preview_chars: int = S.PREVIEW_CHARS
) -> DataFrame:
    """Ranks and flags of all chunks. Rows with text are cut to their preview before they are shuffled."""
    if texts is not None:
        return chunk_diagnostics(with_lead(rank_chunks(scored, pre_chunked), texts), preview_chars)
    if "lead_text" in scored.columns:
        scored = scored.withColumn("text_preview", preview(preview_chars)).drop("lead_text")
    return chunk_diagnostics(rank_chunks(scored, pre_chunked), preview_chars)


# --- report level -----------------------------------------------------------------


def in_band(name: str) -> Column:
    s, b = F.col("similarity"), F.col("bands")
    return {
        "strong": s >= b["strong"],
        "moderate": (s >= b["moderate"]) & (s < b["strong"]),
        "weak": (s >= b["weak"]) & (s < b["moderate"]),
        "off_topic": s < b["weak"],
        "below_moderate": s < b["moderate"],
    }[name]


def band_counts() -> list[Column]:
    names = ("strong", "moderate", "weak", "off_topic")
    return [F.count_if(in_band(n)).cast("int").alias(f"chunks_{n}") for n in names]


def _basic() -> list[Column]:
    s = F.col("similarity")
    return [
        F.count("*").cast("int").alias("total_chunks"),
        F.max(s).alias("max_similarity"),
        F.min(s).alias("min_similarity"),
        F.avg(s).alias("avg_similarity"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std_similarity"),
        *band_counts(),
    ]


def with_coverage(reports: DataFrame) -> DataFrame:
    n = F.col("total_chunks")
    counts = [F.col(f"chunks_{b}") for b in ("strong", "moderate", "weak", "off_topic")]
    score = F.col("coverage_score")
    return (
        reports.withColumn("weighted_sum", B.weighted_sum(*counts))
        .withColumn("coverage_score", B.coverage(*counts))
        .withColumns(
            {
                "coverage_label": B.coverage_label(score),
                "coverage_rounded": F.bround(score).cast("int"),
                "is_single_chunk": n == 1,
                "percent_strong": F.col("chunks_strong") / n * 100.0,
                "percent_on_topic": (n - F.col("chunks_off_topic")) / n * 100.0,
            }
        )
    )


def coverage(scored: DataFrame) -> DataFrame:
    """Coverage score per report: one aggregation whose partial step already runs per document."""
    return with_coverage(scored.groupBy(*REPORT).agg(*_basic()))


def diagnostic_summary(ranked: DataFrame) -> DataFrame:
    """Summary statistics with the exact median, read off the ranks."""
    n, rank = F.col("report_chunks"), F.col("similarity_rank")
    low, high = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
    middle = F.avg(F.when((rank == low) | (rank == high), F.col("similarity")))
    return with_coverage(
        ranked.groupBy(*REPORT).agg(
            *_basic(),
            middle.alias("median_similarity"),
            F.sum("token_count").cast("int").alias("document_token_count"),
            F.max("document_char_count").alias("document_char_count"),
        )
    )


_INDICES = 1 << 31


def _best_key() -> Column:
    """Similarity and chunk index as one number, whose maximum is the first of the most similar chunks.

    Unlike a struct it has a fixed width, so the aggregation that takes its maximum is hashed. Similarities that differ
    have different keys, however close they are.
    """
    return order_key(F.col("similarity")) * F.lit(_INDICES).cast("decimal(10,0)") - F.col("chunk_index").cast("decimal(10,0)")


def _best_index(key: Column) -> Column:
    return F.pmod(-key, F.lit(_INDICES).cast("decimal(10,0)")).cast("int")


_BAND_NAMES = ("strong", "moderate", "weak")


def _band_values() -> list[Column]:
    """The bands of a report, number by number: a struct could not be aggregated by hash."""
    return [F.max(F.col("bands")[b]).alias(f"_{b}") for b in _BAND_NAMES]


def _band_struct() -> Column:
    return F.struct(*[F.col(f"_{b}").alias(b) for b in _BAND_NAMES])


def is_section_row(scored: DataFrame) -> Column:
    """Whether a chunk belongs to a hierarchy; slim rows carry the flag instead of the level."""
    return F.col("in_hierarchy") if "in_hierarchy" in scored.columns else F.col("level") != "flat"


def report_facts(scored: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """:func:`report_numbers` with the text of the best chunk, looked up by key in ``texts`` or ``scored`` itself."""
    return with_example(report_numbers(scored), scored if texts is None else texts)


def report_numbers(scored: DataFrame) -> DataFrame:
    """All report-level numbers the recommendations, next steps and readiness score use.

    One aggregation by hash over numbers: the rows of a report leave a document together, so the
    partial step reduces them to about one row before anything is shuffled.
    """
    s, idx = F.col("similarity"), F.col("chunk_index")
    band = position_percent() <= 0.2
    facts = scored.groupBy(*REPORT).agg(
        *_basic(),
        F.max(_best_key()).alias("_best"),
        F.count_if(band).alias("_band_n"),
        F.sum(F.when(band, s)).alias("_band_sum"),
        F.count_if(idx < 3).alias("_head_n"),
        F.sum(F.when(idx < 3, s)).alias("_head_sum"),
        *_band_values(),
        F.bool_or(is_section_row(scored)).alias("is_hierarchical"),
    )
    total = F.col("total_chunks")
    best_index = F.col("best_chunk_index")
    wide_band = F.col("_band_n") >= 2
    return with_coverage(
        facts.withColumn("best_chunk_index", _best_index(F.col("_best")))
        .withColumns(
            {
                "best_position": F.when(total > 1, best_index / (total - 1)).otherwise(F.lit(0.0)),
                "intro_chunks": F.when(wide_band, F.col("_band_n")).otherwise(F.col("_head_n")).cast("int"),
                "intro_similarity": F.when(wide_band, F.col("_band_sum") / F.col("_band_n")).otherwise(
                    F.col("_head_sum") / F.col("_head_n")
                ),
                "bands": _band_struct(),
            }
        )
        .drop("_best", "_band_n", "_band_sum", "_head_n", "_head_sum", *[f"_{b}" for b in _BAND_NAMES])
    )


def with_example(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``best_example``, the beginning of the best chunk, to reports that have a strong chunk."""
    keys = [k for k in REPORT if k in texts.columns]
    example = texts.select(
        *keys, F.col("chunk_index").alias("best_chunk_index"), preview(S.EXAMPLE_CHARS).alias("best_example")
    )
    strong = F.col("chunks_strong") > 0
    named = facts.filter(strong).select(*REPORT, "best_chunk_index").join(example, [*keys, "best_chunk_index"])
    return facts.join(named.drop("best_chunk_index"), list(REPORT), "left")


def compare(scored: DataFrame) -> DataFrame:
    """One comparison row per (query, document)."""
    s = F.col("similarity")
    return (
        scored.groupBy(*REPORT)
        .agg(
            F.max("document_char_count").alias("document_char_count"),
            F.sum("token_count").cast("int").alias("document_token_count"),
            F.count("*").cast("int").alias("chunk_count"),
            F.max(_best_key()).alias("_best"),
            F.max(s).alias("max_similarity"),
            F.avg(s).alias("avg_similarity"),
            *_band_values(),
        )
        .withColumns({"max_similarity_chunk_index": _best_index(F.col("_best")), "bands": _band_struct()})
        .drop("_best", *[f"_{b}" for b in _BAND_NAMES])
    )


# --- views ------------------------------------------------------------------------


def sorted_view(scored: DataFrame, order: str) -> DataFrame:
    """``document_order``, ``similarity_desc`` or ``similarity_asc``; equal values keep document order."""
    s, idx = F.col("similarity"), F.col("chunk_index")
    keys = {
        "document_order": [idx],
        "similarity_desc": [s.desc(), idx],
        "similarity_asc": [s.asc(), idx],
    }
    if order not in keys:
        raise ValueError(f"unknown sort order {order!r}; expected one of {', '.join(keys)}")
    return scored.orderBy(*REPORT, *keys[order])


def above(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("similarity") >= threshold)


def below(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("similarity") < threshold)


def in_range(scored: DataFrame, low: float, high: float) -> DataFrame:
    return scored.filter(F.col("similarity").between(low, high))


def strong_chunks(scored: DataFrame) -> DataFrame:
    return scored.filter(in_band("strong"))


def weak_or_off_topic_chunks(scored: DataFrame) -> DataFrame:
    return scored.filter(in_band("below_moderate"))


def off_topic_chunks(scored: DataFrame) -> DataFrame:
    return scored.filter(in_band("off_topic"))


def filter_by(scored: DataFrame, predicate: Column | Callable[[pd.DataFrame], pd.Series], columns: Sequence[str] = ()) -> DataFrame:
    """Rows that a condition, or a Python function, accepts.

    A function gets a batch of rows as a pandas frame and returns one truth value per row; null rejects. Only ``columns``
    are handed to it (all, if none are named), so name those it reads: texts are long.
    """
    if isinstance(predicate, Column):
        return scored.filter(predicate)

    def accepts(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(predicate(rows)).astype("boolean").fillna(False).astype(bool)

    return scored.filter(F.pandas_udf(accepts, "boolean")(F.struct(*(columns or scored.columns))))


def max_chunk(scored: DataFrame) -> DataFrame:
    return top_n(scored, 1).drop("place")


def min_chunk(scored: DataFrame) -> DataFrame:
    return top_n(scored, 1, descending=False).drop("place")


def get_chunk(scored: DataFrame, index: int) -> DataFrame:
    return scored.filter(F.col("chunk_index") == index)


def bottom_n(scored: DataFrame, n: int) -> DataFrame:
    return top_n(scored, n, descending=False)


def chunks_at_level(scored: DataFrame, level: str) -> DataFrame:
    return scored.filter(F.col("level") == level)


def hierarchical_reports(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*REPORT).agg(F.bool_or(is_section_row(scored)).alias("is_hierarchical"))


def heatmap(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select(
        *REPORT,
        F.col("chunk_index").alias("index"),
        F.col("normalized_score").alias("score"),
        F.col("similarity").alias("raw_score"),
        "interpretation",
    )


def sequences(diagnostics: DataFrame, segment_rows: int = 1 << 16) -> DataFrame:
    """Similarities and normalized scores in document order: one row per report and segment.

    A segment holds the chunks of ``segment_rows`` consecutive positions, so no array grows without
    bound, however long a report is.
    """
    segment = F.floor(F.col("chunk_index") / segment_rows).cast("int").alias("segment")
    entry = F.struct("chunk_index", "similarity", "normalized_score")
    ordered = diagnostics.groupBy(*REPORT, segment).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return ordered.select(
        *REPORT,
        "segment",
        F.col("_e.similarity").alias("similarities"),
        F.col("_e.normalized_score").alias("normalized_scores"),
    )


def drift_rows(scored: DataFrame) -> DataFrame:
    """Bars of the drift map: only for documents of at least two chunks."""
    height = F.greatest(F.lit(8), F.bround(F.col("similarity") * 64).cast("int"))
    return scored.filter(F.col("chunk_count") >= 2).select(
        *REPORT,
        "chunk_index",
        height.alias("bar_height"),
        F.bround("similarity", 2).alias("shown_similarity"),
        "interpretation",
        X.collapse(preview(S.PREVIEW_CHARS)).alias("preview"),
    )
