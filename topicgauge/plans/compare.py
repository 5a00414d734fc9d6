"""From documents and queries to scored chunks and comparison rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions import text as X
from topicgauge.operators import chunking, dense, diagnostics, signals, similarity, threshold_join
from topicgauge.operators.embedding import Embedder, embed, embed_facts, unembeddable, with_metadata, without_vector
from topicgauge.settings import EXAMPLE_CHARS, ChunkOptions
from topicgauge.sources.readers import accepted_documents, accepted_queries, rejected_inputs, unasked
from topicgauge.sources.storage import materialize

#: Scoring needs no character ranges, so it skips the pass that finds them.
SCORING_OPTIONS = ChunkOptions(with_offsets=False)


def chunk_facts(
    documents: DataFrame,
    strategy: str | Column = "flat",
    options: ChunkOptions = SCORING_OPTIONS,
    lead_chars: int = EXAMPLE_CHARS,
) -> DataFrame:
    """Chunk rows with text and text facts. Narrow from the scan on."""
    sized = documents.withColumn("document_char_count", F.length("text"))
    return diagnostics.with_text_facts(chunking.chunk_documents(sized, strategy, options), lead_chars)


def document_facts(
    documents: DataFrame, strategy: str | Column = "flat", options: ChunkOptions = SCORING_OPTIONS, with_signals: bool = True
) -> DataFrame:
    """One row per document: its chunks as an array and, if wanted, its signals, from one pass over the text.

    Stored, this table serves scoring, previews and signals, each of which reads its own columns.
    """
    sized = documents.withColumn("document_char_count", F.length("text"))
    kept = [c for c in sized.columns if c != "text"]
    if not with_signals:
        return chunking.with_chunks(sized, strategy, options).select(*kept, "chunks")
    # signals first: rows wait for their batch to be judged, and need not hold the chunks meanwhile
    named = signals.with_document_signals(sized)
    found = F.struct(*[c for c in named.columns if c not in sized.columns]).alias("signals")
    return chunking.with_chunks(named.select(*sized.columns, found), strategy, options).select(*kept, "chunks", "signals")


def stored_chunk_facts(facts: DataFrame, lead_chars: int = EXAMPLE_CHARS) -> DataFrame:
    """The chunk rows of :func:`document_facts`, as :func:`chunk_facts` gives them."""
    return diagnostics.with_text_facts(chunking.explode_chunks(facts.drop("signals")), lead_chars)


def chunk_vectors(
    documents: DataFrame,
    embedder: Embedder,
    strategy: str | Column = "flat",
    options: ChunkOptions = SCORING_OPTIONS,
    lead_chars: int = EXAMPLE_CHARS,
) -> DataFrame:
    """Chunk rows with vectors and text facts but without the text."""
    return embed_facts(chunk_facts(documents, strategy, options, lead_chars), embedder).drop("text")


def _score(
    vectors: DataFrame, queries: DataFrame, embedder: Embedder, bands: Mapping[str, float] | None, on: str, salts: int,
    pairs: DataFrame | None, assume_normalized: bool,
) -> DataFrame:
    # queries may bring their vectors and bands
    asked = queries if "query_vector" in queries.columns else similarity.prepare_queries(queries, embedder, bands)
    if pairs is not None:
        return similarity.score_pairs(vectors, asked, pairs, assume_normalized)
    if embedder.dim >= dense.WIDE and salts == 1:
        return dense.score_blocked(vectors, asked, on, assume_normalized)
    return similarity.score(vectors, asked, on, salts, assume_normalized)


def chunks_above(
    documents: DataFrame, queries: DataFrame, embedder: Embedder, threshold: float, strategy: str | Column = "flat", on: str = "scope",
    bands: Mapping[str, float] | None = None, keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Scored chunks with ``similarity >= threshold`` only, found without comparing all pairs of a scope."""
    vectors = keep(chunk_vectors(documents, embedder, strategy))
    return threshold_join.score_above(vectors, keep(similarity.prepare_queries(queries, embedder, bands)), threshold, on)


def score_documents(
    documents: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    strategy: str | Column = "flat",
    options: ChunkOptions = SCORING_OPTIONS,
    bands: Mapping[str, float] | None = None,
    on: str = "scope",
    salts: int = 1,
    pairs: DataFrame | None = None,
    lead_chars: int = EXAMPLE_CHARS,
    assume_normalized: bool = False,
) -> DataFrame:
    """Scored chunks of every document against the queries of its scope, or of the requested pairs."""
    vectors = chunk_vectors(documents, embedder, strategy, options, lead_chars)
    return _score(vectors, queries, embedder, bands, on, salts, pairs, assume_normalized)


def score_prechunked(
    chunks: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    bands: Mapping[str, float] | None = None,
    on: str = "scope",
    salts: int = 1,
    pairs: DataFrame | None = None,
    lead_chars: int = EXAMPLE_CHARS,
    assume_normalized: bool = False,
) -> DataFrame:
    """Score an existing chunk table; only the embedding is computed anew."""
    return score_facts(diagnostics.with_text_facts(chunks, lead_chars), queries, embedder, bands, on, salts, pairs, assume_normalized)


def score_facts(
    facts: DataFrame, queries: DataFrame, embedder: Embedder, bands: Mapping[str, float] | None = None, on: str = "scope", salts: int = 1,
    pairs: DataFrame | None = None, assume_normalized: bool = False,
) -> DataFrame:
    """Score chunk rows that have their text facts already; without any text, the embedder has to know their vectors."""
    vectors = embed_facts(facts, embedder) if "text" in facts.columns else embedder.embed(facts, "text")
    return _score(vectors.drop("text"), queries, embedder, bands, on, salts, pairs, assume_normalized)


def compare_documents(
    documents: DataFrame, queries: DataFrame, embedder: Embedder, strategy: str | Column = "flat", on: str = "scope",
    **options,
) -> DataFrame:
    """One comparison row per (query, document), with the embedder's name and vector width.

    ``options`` are those of :func:`score_documents`; :func:`rejects` has what gives no row.
    """
    scored = score_documents(documents, queries, embedder, strategy, on=on, **options)
    rows = diagnostics.compare(scored)
    return rows.withColumns({"model_name": F.lit(embedder.name), "embedding_dim": F.lit(embedder.dim)})


def asked_pairs(documents: DataFrame, queries: DataFrame, on: str = "scope", pairs: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id`` of everything that is asked of a document."""
    if pairs is not None:
        return pairs.select("query_id", "doc_id")
    return documents.select("doc_id", on).join(accepted_queries(queries).select("query_id", on), on).drop(on)


def rejects(
    documents: DataFrame, queries: DataFrame, embedder: Embedder, strategy: str | Column = "flat", on: str = "scope",
    pairs: DataFrame | None = None, assume_normalized: bool = False,
) -> DataFrame:
    """``query_id, doc_id, chunk_index, reason`` of everything that gets no score.

    Null or blank documents and queries, documents nobody asks and queries without documents, unknown
    strategies, documents that give no chunk, chunks without a vector, and vectors without a similarity.
    """
    columns = ("query_id", "doc_id", "chunk_index", "reason")
    no_query, no_chunk = F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("int").alias("chunk_index")
    usable = accepted_documents(documents)
    bad = rejected_inputs(documents, queries)
    if pairs is None:
        bad = bad.unionByName(unasked(documents, queries, on))
    named = chunking.unknown_strategies(usable, strategy).select(no_query, "doc_id", "reason")
    uncut = chunking.unchunkable(chunking.with_chunks(usable, strategy, SCORING_OPTIONS))
    uncut = uncut.join(named.select("doc_id"), "doc_id", "left_anti").select(no_query, "doc_id", "reason")
    rows = bad.unionByName(named).unionByName(uncut).withColumn("chunk_index", F.lit(None).cast("int")).select(*columns)
    facts = chunk_facts(usable, strategy)
    blank = unembeddable(facts).unionByName(without_vector(facts.filter(~X.is_blank(F.col("text"))), embedder))
    asked = similarity.prepare_queries(accepted_queries(queries), embedder)
    vectors = embed(facts, embedder).drop("text")
    apart = similarity.score_rejects(vectors, asked, on, 1, assume_normalized, pairs)
    return rows.unionByName(blank.select(no_query, "doc_id", "chunk_index", "reason")).unionByName(apart.select(*columns))


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    return with_metadata(embed(queries, embedder, "query"), embedder)
