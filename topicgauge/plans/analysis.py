"""The whole analysis: every report of the engine from one scored table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicgauge.functions import bands as B
from topicgauge.functions import text as X
from topicgauge.operators import diagnostics, nextsteps, readiness, recommendations, sections, signals
from topicgauge.operators.embedding import Embedder, unembeddable
from topicgauge.operators.ranking import REPORT
from topicgauge.plans.compare import asked_pairs, document_facts, rejects, score_facts, stored_chunk_facts
from topicgauge.settings import MAX_NEXT_STEPS, SHORT_QUERY_BANDS
from topicgauge.sources.readers import accepted_documents, accepted_queries
from topicgauge.sources.storage import materialize


#: What is kept of a scored chunk: numbers, flags and the band's label. Its text is looked up by key.
SLIM = (
    "query_id", "doc_id", "chunk_index", "chunk_count", "similarity", "interpretation", "bands", "token_count",
    "document_char_count", "word_count", "parent_index",
)


def slim(scored: DataFrame) -> DataFrame:
    return scored.select(
        *SLIM, F.col("level").isin("macro", "micro").alias("opens_section"), (F.col("level") != "flat").alias("in_hierarchy")
    )


@dataclass(frozen=True)
class Analysis:
    """Tables over ``scored`` (slim rows), ``texts`` (one row per chunk) and ``signals`` (one per document).

    ``scored`` and what ``texts`` and ``signals`` are read from are stored; report numbers are one aggregation by hash
    over ``scored`` and are not. Texts and sections are looked up only by the reports that show them.
    """

    scored: DataFrame
    texts: DataFrame
    signals: DataFrame
    queries: DataFrame
    rejects: DataFrame
    asked: DataFrame
    hierarchical: bool = True
    pre_chunked: bool = False
    keep: Callable[[DataFrame], DataFrame] = materialize

    @property
    def numbers(self) -> DataFrame:
        """Report aggregates without any text."""
        return diagnostics.report_numbers(self.scored)

    @property
    def facts(self) -> DataFrame:
        """Report aggregates: all that recommendations need."""
        return recommendations.with_low_sections(diagnostics.with_example(self.numbers, self.texts), self._low_sections)

    @cached_property
    def kept_facts(self) -> DataFrame:
        return self.keep(self.facts)

    @property
    def reports(self) -> DataFrame:
        """Report aggregates with the content signals: all that next steps and readiness need."""
        return nextsteps.with_signals(self.numbers, self.signals, self.queries)

    @property
    def section_summaries(self) -> DataFrame:
        return sections.section_summaries(self.scored, self.texts)

    @property
    def _low_sections(self) -> DataFrame | None:
        return sections.low_sections(self.section_summaries) if self.hierarchical else None

    @property
    def coverage(self) -> DataFrame:
        return diagnostics.coverage(self.scored)

    @property
    def unanswered(self) -> DataFrame:
        """Asked ``query_id, doc_id`` pairs without a scored chunk, with the reason where one is known."""
        done = self.scored.select(*REPORT).distinct()
        reasons = self.rejects.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("reason").alias("reason"))
        return self.asked.join(done, list(REPORT), "left_anti").join(reasons, "doc_id", "left")

    @property
    def empty_reports(self) -> DataFrame:
        """A report of score 0, with intent and signals, for every asked pair without a scored chunk."""
        return nextsteps.empty_reports(self.unanswered, self.signals, self.queries)

    @property
    def empty_readiness(self) -> DataFrame:
        """The readiness score of those reports: their structure and evidence count, their coverage is 0."""
        return readiness.readiness(self.empty_reports)

    @property
    def diagnostics(self) -> DataFrame:
        return diagnostics.diagnose(self.scored, self.pre_chunked, self.texts)

    @property
    def recommendations(self) -> DataFrame:
        return recommendations.recommendations(self.facts)

    @property
    def recommendation_targets(self) -> DataFrame:
        summaries = self.section_summaries if self.hierarchical else None
        return recommendations.targets(self.scored, self.kept_facts, summaries, self.texts)

    @property
    def recommendation_report(self) -> DataFrame:
        return recommendations.recommendation_report(self.facts)

    def steps(self, max_steps: int = MAX_NEXT_STEPS) -> DataFrame:
        return nextsteps.next_steps(self.reports, max_steps)

    @property
    def next_steps(self) -> DataFrame:
        return self.steps()

    @property
    def step_targets(self) -> DataFrame:
        return nextsteps.step_targets(self.next_steps, self.scored, self.texts)

    @property
    def step_report(self) -> DataFrame:
        return nextsteps.step_report(self.reports)

    @property
    def readiness(self) -> DataFrame:
        return readiness.readiness(self.reports)

    @property
    def action_plan(self) -> DataFrame:
        return action_plan(self.next_steps, self.recommendations)

    @property
    def score_card(self) -> DataFrame:
        return score_card(self.facts)


def analyze(
    documents: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    strategy: str | Column = "flat",
    keep: Callable[[DataFrame], DataFrame] = materialize,
    bands: Mapping[str, float] | None = None,
    on: str = "scope",
    salts: int = 1,
    pairs: DataFrame | None = None,
    assume_normalized: bool = False,
    keep_signals: bool = True,
) -> Analysis:
    """Analysis of ``documents`` against the queries of their scope, or of the requested ``pairs``.

    The text is parsed once: chunks and signals of every document are stored by ``keep``, and the scored rows, which hold
    no text themselves, are stored because every report reads them. Only next steps and readiness read signals: without
    ``keep_signals`` these two take them from the documents when they run, and coverage, sections and recommendations spare the work.
    """
    usable, asking = accepted_documents(documents), accepted_queries(queries)
    how = {"bands": bands, "on": on, "salts": salts, "pairs": pairs, "assume_normalized": assume_normalized}
    facts = keep(document_facts(usable, strategy, with_signals=keep_signals))
    found = facts.select("doc_id", "signals.*") if keep_signals else signals.document_signals(usable.select("doc_id", "text"))
    rows = stored_chunk_facts(facts)
    scored = keep(slim(score_facts(rows, asking, embedder, **how)))
    return Analysis(
        scored, rows.select(*TEXTS), found, signals.with_query_facts(asking),
        rejects(documents, queries, embedder, strategy, on, pairs, assume_normalized), asked_pairs(documents, queries, on, pairs),
        not (isinstance(strategy, str) and strategy == "flat"), keep=keep,
    )


#: What reports show of a chunk's text and place.
TEXTS = ("doc_id", "chunk_index", "lead_text", "char_count", "level", "heading", "depth")


def analyze_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    documents: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = materialize,
    bands: Mapping[str, float] | None = None,
    on: str = "scope",
    salts: int = 1,
    pairs: DataFrame | None = None,
    assume_normalized: bool = False,
) -> Analysis:
    """Analysis of a given chunk table: ``doc_id, chunk_index``, the column ``on``, and whatever ``embedder`` reads.

    ``text, token_count, level, heading, parent_index, depth`` and ``document_char_count`` are used where the table has them; a
    chunk without a level is flat. A ``doc_id`` may hold any share of the chunks: sizes and report numbers are summed before the
    shuffle, and ranks are counted in cells. Signals come from ``documents``, where those are given; without, no report has next steps
    or a readiness score. Queries may bring ``query_vector, query_norm, bands`` instead of a text.
    """
    worded = "query" in queries.columns
    asking = accepted_queries(queries) if worded else queries
    rows = keep(chunk_table(chunks))
    given = rows if "text" in chunks.columns else rows.drop("text")
    scored = keep(slim(score_facts(given, asking, embedder, bands, on, salts, pairs, assume_normalized)))
    texts = rows.select("doc_id", F.lit(None).cast("string").alias("text")).limit(0) if documents is None else documents.select("doc_id", "text")
    asked = rows.select("doc_id", on).distinct().join(asking.select("query_id", on), on).drop(on) if pairs is None else pairs.select("query_id", "doc_id")
    blank = unembeddable(given) if "text" in given.columns else rows.limit(0).withColumn("reason", F.lit(""))
    unembedded = blank.select(F.lit(None).cast("bigint").alias("query_id"), "doc_id", "chunk_index", "reason")
    return Analysis(
        scored, rows.select(*TEXTS), signals.document_signals(accepted_documents(texts)), signals.with_query_facts(asking) if worded else asking,
        unembedded, asked, pre_chunked=True, keep=keep,
    )


def chunk_table(chunks: DataFrame) -> DataFrame:
    """A given chunk table with every column that scoring and reports read."""
    have = set(chunks.columns)
    text = F.col("text") if "text" in have else F.lit(None).cast("string")
    defaults = {
        "text": text, "heading": F.lit(None).cast("string"), "parent_index": F.lit(None).cast("int"), "depth": F.lit(0),
        "token_count": F.when(text.isNotNull(), X.token_estimate(text)).otherwise(F.lit(0)),
    }
    full = chunks.withColumns({c: v for c, v in defaults.items() if c not in have})
    full = full.withColumn("level", F.coalesce("level", F.lit("flat")) if "level" in have else F.lit("flat"))
    sizes = [F.count("*").cast("int").alias("chunk_count")] if "chunk_count" not in have else []
    if "document_char_count" not in have:
        sizes.append(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("int").alias("document_char_count"))
    if sizes:
        full = full.join(full.groupBy("doc_id").agg(*sizes), "doc_id")
    return diagnostics.with_text_facts(full)


def action_plan(steps: DataFrame, recs: DataFrame) -> DataFrame:
    """Next steps, then recommendations, numbered per report: at most twelve rows each."""
    items = steps.select(
        *REPORT, F.lit("next_step").alias("source"), F.col("step").alias("item"), "priority", "position", "title", "why", "how"
    ).unionByName(
        recs.select(
            *REPORT, F.lit("recommendation").alias("source"), F.col("rec_type").alias("item"), "priority", "position",
            F.col("what").alias("title"), "why", "how",
        )
    )
    w = Window.partitionBy(*REPORT).orderBy("source", "position")
    return items.withColumn("number", F.row_number().over(w)).drop("position")


def score_card(facts: DataFrame) -> DataFrame:
    """Score banner: counts, attainable gain and reliability flags."""
    gain = recommendations.potential_coverage() - F.col("coverage_score")
    short = F.col("bands") == B.band_struct(SHORT_QUERY_BANDS)
    return facts.select(
        *REPORT,
        "coverage_score", "coverage_rounded", "coverage_label",
        "chunks_strong", "chunks_moderate", "chunks_weak", "chunks_off_topic",
        F.when(gain > 0, recommendations.potential_coverage()).alias("potential_ccs"),
        F.when(gain > 0, gain).alias("potential_gain"),
        "is_single_chunk",
        short.alias("is_short_topic"),
    )
