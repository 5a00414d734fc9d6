"""Chunks at or above a similarity, without comparing every chunk with every query.

Vectors are cut in their coordinates, the rarest first. The coordinates behind a prefix can add at most the length
of that suffix to the similarity, so where the suffix of a unit vector is shorter than the threshold, a pair that
reaches it shares a coordinate of the prefix; and since both sides keep the same order, the first coordinate they share lies in
the prefixes of both. Prefixes meet in an equi-join on scope and coordinate (the inverted lists), each pair that
meets is named once, and only those pairs are compared.

The more coordinates and the higher the threshold, the fewer pairs. A coordinate that nearly all chunks have comes last
and is in a prefix only where nothing else makes up the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.functions import arrays as A
from topicgauge.operators import similarity

#: Suffixes count as this much longer, so that rounding cannot lose a pair.
SLACK = 1e-9


def coordinate_order(chunks: DataFrame) -> list[int]:
    """The coordinates by the number of chunks that have them, the rarest first: at most one number per coordinate."""
    held = chunks.select(F.explode(present(F.col("vector"))).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return [r.i for r in sorted(held.collect(), key=lambda r: (r.n, r.i))]


def present(vector: Column) -> Column:
    """Places of the numbers that are not zero."""
    numbered = F.transform(vector, lambda x, i: F.when(x.isNotNull() & (x != 0), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def prefix(vector: Column, norm: Column, rank: Column, threshold: float) -> Column:
    """Coordinates of a vector, in the order of ``rank``, up to where the rest is shorter than the threshold."""

    def of(entries: Column) -> Column:
        def step(acc: Column, entry: Column):
            rest = acc["rest"] - entry["v"] * entry["v"]
            # a coordinate counts while what begins with it is long enough
            return {"rest": rest}, entry["i"], acc["rest"] * (1 + SLACK) + SLACK >= threshold * threshold

        return A.collected(entries, {"rest": F.lit(1.0)}, step)

    known = F.filter(present(vector), lambda i: F.get(rank, i).isNotNull())
    entries = F.transform(known, lambda i: F.struct(F.get(rank, i).alias("rank"), i.alias("i"), (F.get(vector, i) / norm).alias("v")))
    return F.when(norm > 0, A.bound(F.array_sort(entries), of))


def candidate_pairs(chunks: DataFrame, queries: DataFrame, threshold: float, on: str = "scope") -> DataFrame:
    """``query_id, doc_id, chunk_index`` of the pairs that may reach the threshold; no other can."""
    order = coordinate_order(chunks)
    width = max(order, default=-1) + 1
    ranks = [None] * width
    for r, i in enumerate(order):
        ranks[i] = r
    rank = F.array(*[F.lit(r).cast("int") for r in ranks]) if ranks else F.array().cast("array<int>")
    of = lambda v, n: F.explode(prefix(F.col(v), F.col(n), rank, threshold)).alias("i")
    left = chunks.select(on, "doc_id", "chunk_index", F.size("vector").alias("_size"), of("vector", "norm"))
    right = queries.select(on, "query_id", F.size("query_vector").alias("_size"), of("query_vector", "query_norm"))
    return left.join(right, [on, "_size", "i"]).select("query_id", "doc_id", "chunk_index").distinct()


def score_above(chunks: DataFrame, queries: DataFrame, threshold: float, on: str = "scope") -> DataFrame:
    """The rows of :func:`similarity.score` with ``similarity >= threshold``; ``doc_id, chunk_index`` is the key of ``chunks``."""
    if threshold <= 0:
        return similarity.score(chunks, queries, on).filter(F.col("similarity") >= threshold)
    pairs = candidate_pairs(chunks, queries, threshold, on)
    near = chunks.join(pairs, ["doc_id", "chunk_index"]).join(queries.select("query_id", "query_vector", "query_norm", "bands"), "query_id")
    return similarity.scored(near).filter(F.col("similarity") >= threshold)
