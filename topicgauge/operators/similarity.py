"""Query-to-chunk similarity.

Queries meet chunks through an equi-join: on ``scope`` (the queries asked of a group of
documents) or on ``doc_id`` through a table of requested pairs. No side is forced to be
broadcast: Spark broadcasts the queries where their size allows and otherwise shuffles,
splitting a hot scope with its skew-join rule.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions import bands as B
from topicgauge.functions import text as X
from topicgauge.functions import vectors as V
from topicgauge.operators.embedding import Embedder, embed


def prepare_queries(queries: DataFrame, embedder: Embedder, bands: Mapping[str, float] | None = None) -> DataFrame:
    """Query rows with ``query_vector``, ``query_norm`` and the bands that apply to them."""
    chosen = B.band_struct(bands) if bands else B.bands_for_query(F.col("query"))
    return (
        embed(queries, embedder, "query")
        .withColumnsRenamed({"vector": "query_vector", "norm": "query_norm"})
        .withColumn("bands", chosen)
    )


def _similarity(assume_normalized: bool) -> Column:
    """From the vectors' ``_product``, which is null where they cannot be multiplied."""
    product = F.col("_product")
    if assume_normalized:
        return V.clamp(product)
    lengths = F.col("query_norm") * F.col("norm")
    # A chunk without any term has a zero vector: similarity 0, as a plain dot product gives.
    return F.when(product.isNotNull() & (lengths == 0), F.lit(0.0)).otherwise(V.clamp(product / lengths))


_QUERY_COLUMNS = ("query_id", "query_vector", "query_norm", "bands")


def _meet(chunks: DataFrame, queries: DataFrame, on: str, salts: int) -> DataFrame:
    """Chunks beside the queries of their scope.

    Where the queries are too many to be broadcast and a scope holds much of the chunks, ``salts``
    spreads that scope over as many join keys; the queries are repeated once per salt.
    """
    asked = queries.select(on, *_QUERY_COLUMNS)
    if salts == 1:
        return chunks.join(asked, on)
    repeated = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = chunks.withColumn("_salt", F.pmod(F.hash("doc_id", "chunk_index"), F.lit(salts)))
    return salted.join(repeated, [on, "_salt"]).drop("_salt")


def _meet_pairs(chunks: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    asked = pairs.select("query_id", "doc_id").join(queries.select(*_QUERY_COLUMNS), "query_id")
    return chunks.join(asked, "doc_id")


def score(
    chunks: DataFrame, queries: DataFrame, on: str = "scope", salts: int = 1, assume_normalized: bool = False
) -> DataFrame:
    """Every chunk against every query of its scope; :func:`score_rejects` has the pairs that have no similarity.

    ``assume_normalized`` takes the dot product alone, for tables known to hold unit vectors.
    """
    return scored(_meet(chunks, queries, on, salts), assume_normalized)


def score_pairs(chunks: DataFrame, queries: DataFrame, pairs: DataFrame, assume_normalized: bool = False) -> DataFrame:
    """Only the requested ``(query_id, doc_id)`` pairs."""
    return scored(_meet_pairs(chunks, queries, pairs), assume_normalized)


def _with_similarity(joined: DataFrame, assume_normalized: bool) -> DataFrame:
    # A generator keeps the optimizer from pushing filters on the similarity below it, and from
    # repeating the product wherever its value is named.
    a, b = F.col("query_vector"), F.col("vector")
    product = F.when(F.size(a) == F.size(b), V.dot(a, b))
    multiplied = joined.withColumn("_product", F.explode(F.array(product)))
    return multiplied.withColumn("similarity", _similarity(assume_normalized)).drop("_product")


def scored(joined: DataFrame, assume_normalized: bool = False) -> DataFrame:
    """Similarity and band of chunks beside their queries; pairs without a similarity are left out."""
    return (
        _with_similarity(joined, assume_normalized)
        .filter(F.col("similarity").isNotNull())
        .withColumn("interpretation", B.interpret(F.col("similarity"), F.col("bands")))
        .drop("query_vector", "query_norm", "vector", "norm")
    )


def score_rejects(
    chunks: DataFrame, queries: DataFrame, on: str = "scope", salts: int = 1, assume_normalized: bool = False,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """``query_id, doc_id, chunk_index, reason`` of the pairs whose vectors cannot be compared."""
    met = _meet(chunks, queries, on, salts) if pairs is None else _meet_pairs(chunks, queries, pairs)
    a, b = F.col("query_vector"), F.col("vector")
    reason = F.coalesce(V.vector_reject_reason(a), V.vector_reject_reason(b), V.sizes_differ(a, b), F.lit("no similarity"))
    bad = _with_similarity(met, assume_normalized).filter(F.col("similarity").isNull())
    return bad.select("query_id", "doc_id", "chunk_index", reason.alias("reason"))


def with_query_words(queries: DataFrame) -> DataFrame:
    return queries.withColumn("query_words", X.word_count(F.col("query")))
