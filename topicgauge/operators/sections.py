"""Section roll-ups: a heading's chunk and its direct children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.operators.diagnostics import band_counts
from topicgauge.operators.ranking import REPORT


def _opens(scored: DataFrame) -> Column:
    """Whether a chunk opens a section; slim rows carry the flag instead of the level."""
    return F.col("opens_section") if "opens_section" in scored.columns else F.col("level").isin("macro", "micro")


def section_members(scored: DataFrame) -> DataFrame:
    """One row per (section, member). A chunk emits its own section and its parent's: no join."""
    heads = _opens(scored)
    keys = F.array_compact(F.array(F.when(heads, F.col("chunk_index")), F.col("parent_index")))
    return scored.withColumn("section_index", F.explode_outer(keys)).filter(F.col("section_index").isNotNull())


def section_summaries(scored: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Aggregates per section. Only heading chunks open sections; member rows stay in :func:`section_members`.

    Heading and level are looked up by key in ``texts`` after the numbers have been added up. Without
    ``texts``, the chunk that opens a section brings them along: ``scored`` is read once.
    """
    s = F.col("similarity")
    numbers = [
        F.count("*").cast("int").alias("chunk_count"),
        F.avg(s).alias("avg_similarity"),
        F.max(s).alias("max_similarity"),
        F.min(s).alias("min_similarity"),
        F.sum("word_count").cast("int").alias("total_words"),
        *band_counts(),
    ]
    if texts is None:
        totals = _totals_with_headings(scored, numbers)
    else:
        keys = [k for k in REPORT if k in texts.columns]
        headings = texts.filter(F.col("level").isin("macro", "micro")).select(
            *keys, F.col("chunk_index").alias("section_index"), "heading", "level"
        )
        totals = section_members(scored).groupBy(*REPORT, "section_index").agg(*numbers).join(headings, [*keys, "section_index"])
    counts = [f"chunks_{b}" for b in ("strong", "moderate", "weak", "off_topic")]
    return totals.withColumn("coverage_score", B.coverage(*map(F.col, counts))).drop(*counts)


def _totals_with_headings(scored: DataFrame, numbers: list[Column]) -> DataFrame:
    """The sums of each section beside every row that opens it: one, unless an id comes more than once."""
    opens = F.col("level").isin("macro", "micro")
    own = F.when(opens, F.struct(F.col("chunk_index").alias("index"), F.struct("heading", "level").alias("head")))
    no_head = F.lit(None).cast("struct<heading:string,level:string>")
    parent = F.when(F.col("parent_index").isNotNull(), F.struct(F.col("parent_index").alias("index"), no_head.alias("head")))
    members = scored.withColumn("_section", F.explode(F.array_compact(F.array(own, parent))))
    heads = F.collect_list("_section.head").alias("_heads")
    sums = members.withColumn("section_index", F.col("_section.index")).groupBy(*REPORT, "section_index").agg(*numbers, heads)
    known = sums.dropna(subset=list(REPORT))
    return known.withColumn("_head", F.explode("_heads")).select("*", "_head.heading", "_head.level").drop("_head", "_heads")


def low_sections(summaries: DataFrame) -> DataFrame:
    """Per report: how many sections fall short, and the first of them."""
    first = F.min(F.struct("section_index", "heading", "coverage_score"))
    return (
        summaries.filter(F.col("coverage_score") < S.LOW_SECTION_COVERAGE)
        .groupBy(*REPORT)
        .agg(F.count("*").cast("int").alias("low_sections"), first.alias("first_low_section"))
    )


def chunks_by_section(scored: DataFrame) -> DataFrame:
    """Each chunk with the section it is listed under; null for orphans.

    Inside a section the order is ``leads_section`` first, then document order: a heading
    chunk without a parent leads its own section.
    """
    heads = _opens(scored)
    return scored.withColumns(
        {
            "section_key": F.coalesce(F.col("parent_index"), F.when(heads, F.col("chunk_index"))),
            "leads_section": F.col("parent_index").isNull() & heads,
        }
    )


def child_rows(scored: DataFrame) -> DataFrame:
    """Children of each parent chunk, one row each: for tables of chunks that no document row bounds."""
    return scored.filter(F.col("parent_index").isNotNull()).select(
        *REPORT, F.col("parent_index").alias("chunk_index"), F.col("chunk_index").alias("child")
    )


def child_lists(scored: DataFrame) -> DataFrame:
    """Children of each parent chunk as a list, shorter than the document row its chunks were cut from."""
    return (
        scored.filter(F.col("parent_index").isNotNull())
        .groupBy(*REPORT, F.col("parent_index").alias("chunk_index"))
        .agg(F.array_sort(F.collect_list("chunk_index")).alias("children"))
    )


def hierarchy_heatmap(diagnostics: DataFrame) -> DataFrame:
    """Heatmap rows with their place in the hierarchy. Reads ``diagnostics`` twice; store it first."""
    rows = diagnostics.join(child_lists(diagnostics), [*REPORT, "chunk_index"], "left")
    return rows.select(
        *REPORT,
        F.col("chunk_index").alias("index"),
        F.col("normalized_score").alias("score"),
        F.col("similarity").alias("raw_score"),
        "interpretation",
        "level",
        "heading",
        "depth",
        "parent_index",
        F.coalesce("children", F.array().cast("array<int>")).alias("children"),
        "word_count",
    )
