"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut in buckets of similar length. A query's k-th best score so far
and a bucket's greatest length give a local threshold: no vector of the bucket can enter the result
unless its cosine with the query reaches score / (query length * bucket length). Per query and
bucket one of three things happens:

- the threshold exceeds 1: the bucket is skipped;
- it is high (COORDINATE_FROM or more): coordinate pruning. With the cosine at least c, the
  coordinate of the unit vector at the query's largest component lies in an interval around it, and
  only vectors inside are candidates;
- otherwise length pruning: only vectors long enough for the score are candidates.

Candidates are verified by their integer products. First thresholds come from the products with
the bucket of longest vectors, a block of fixed size that every task receives.

Queries are held in blocks, too. A block meets only the buckets whose longest vector some query of it can
use: such pairs are chosen from a table of lengths, without vectors, and then joined with blocks and buckets. A
task holds one query block and one bucket at a time. Each visit returns at most k rows per query; these are merged by a window.
All bounds are widened by a relative SLACK, so rounding can only
add candidates.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows without an id; vectors of different dimension have no product; rows that repeat an id
are candidates of their own, one of them (the smallest vector) is the query, and none is a
candidate of its own id; ties go to the smaller id. Products are exact 64-bit integers however large the
components; a score, or a scaled component, beyond 64 bits raises an error rather than overflow. The table must give the same rows each time it is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, rows_of
from topicgauge.sources.storage import materialize

#: Vectors per bucket and queries per block.
BUCKET_ROWS = 4096
QUERY_ROWS = 512
COORDINATE_FROM = 0.9
SLACK = 1e-9
ANGLE_SLACK = 1e-6

BLOCKS = "block long, dim int, longest double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, dim, vector, squared`` with integer components floor(scale * x)."""
    scaled_up = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("scaled", lambda x: F.abs(x.cast("double")) < float(1 << 63))
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), scaled_up.alias("scaled"))
    whole = F.when(fits, F.transform("scaled", lambda x: x.cast("long"))).otherwise(F.raise_error(F.lit("a component does not fit a long")))
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", whole.alias("vector")).select("vec_id", F.size("vector").alias("dim"), "vector", squared.alias("squared"))


def blocks_of(rows: DataFrame, size: int, partitions: int) -> DataFrame:
    """Runs of up to ``size`` vectors of one dimension, the longest first, packed as one row each."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(BLOCKS))
        held: list[tuple] = []

        def emit():
            ids = np.array([r[0] for r in held], "<i8")
            vectors = np.array([r[2] for r in held], "<i8")
            # numbered by the id of the first row: the same whenever the task runs
            yield from out.add((int(ids[0]), held[0][1], float(np.sqrt(held[0][3])), ids.tobytes(), vectors.tobytes()), 8 * vectors.size)

        for row in rows_of(batches):
            if held and (len(held) >= size or row[1] != held[0][1]):
                yield from emit()
                held = []
            held.append(row)
        if held:
            yield from emit()
        yield from out.flush()

    ordered = rows.repartitionByRange(partitions, F.col("dim"), F.desc("squared"), F.col("vec_id"))
    return ordered.sortWithinPartitions("dim", F.desc("squared"), "vec_id", "vector").mapInArrow(pack, BLOCKS)


class Bucket:
    """Vectors sorted by length, with the index for coordinate pruning made when first asked for."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.whole = np.frombuffer(vectors, "<i8").reshape(-1, dim)
        self.vectors = self.whole.astype(np.float64)
        self.lengths = np.linalg.norm(self.vectors, axis=1)
        self.longest = float(self.lengths.max(initial=0.0))
        self._by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.largest = float(np.abs(self.vectors).max(initial=0.0))

    def products(self, query: np.ndarray, rows) -> np.ndarray:
        """Exact products with a query of 64-bit integers; one that does not fit 64 bits is an error."""
        bound = self.largest * float(np.abs(query.astype(np.float64)).max()) * len(query)
        if bound < 2**52:  # float64 products of integers are exact below 2^53
            return (self.vectors[rows] @ query.astype(np.float64)).astype(np.int64)
        if bound < 2**62:
            return self.whole[rows] @ query
        whole = query.tolist()
        products = [sum(a * b for a, b in zip(v, whole)) for v in self.whole[rows].tolist()]
        if any(not -(1 << 63) <= p < 1 << 63 for p in products):
            raise OverflowError("a score does not fit a long")
        return np.array(products, np.int64)

    def candidates(self, query: np.ndarray, length: float, score: float):
        """Rows that may reach ``score``: an index array or slice, or None when there is none."""
        if length == 0 or self.longest == 0 or score <= 0:
            return slice(None)
        cosine = score / (length * self.longest) * (1 - SLACK)
        if cosine > 1:
            return None
        if cosine >= COORDINATE_FROM:
            at = int(np.argmax(np.abs(query)))
            to_axis, apart = np.arccos(np.clip(query[at] / length, -1, 1)), np.arccos(cosine)
            # a shorter vector needs a larger cosine, so its angle to the axis lies in this range, too
            low = np.cos(min(np.pi, to_axis + apart)) - ANGLE_SLACK
            high = np.cos(max(0.0, to_axis - apart)) + ANGLE_SLACK
            values, rows = self.by_coordinate(at)
            return rows[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
        need = score / length * (1 - SLACK)
        return slice(0, int(np.searchsorted(-self.lengths, -need, "right")))

    def by_coordinate(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        if at not in self._by_coordinate:
            unit = self.vectors[:, at] / np.where(self.lengths > 0, self.lengths, 1)
            rows = np.argsort(unit, kind="stable")
            self._by_coordinate[at] = unit[rows], rows
        return self._by_coordinate[at]


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], np.int64), np.array([], np.int64)) for _ in ids]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.found[q][0], scores])
        ids = np.concatenate([self.found[q][1], ids])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = scores[order], ids[order]

    def least(self, q: int) -> float:
        return float(self.found[q][0][-1]) if len(self.found[q][0]) == self.k else -np.inf


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.linalg.norm(vectors.astype(np.float64), axis=1)


def visit(queries: np.ndarray, lengths: np.ndarray, least: np.ndarray, bucket: Bucket, best: Best) -> None:
    for q in range(len(queries)):
        rows = bucket.candidates(queries[q].astype(np.float64), lengths[q], max(least[q], best.least(q)))
        if rows is None:
            continue
        ids = bucket.ids[rows]
        if len(other := np.flatnonzero(ids != best.ids[q])) < len(ids):  # its own product need not fit a score
            rows, ids = np.arange(len(bucket.ids))[rows][other], ids[other]
        if len(ids):
            best.offer(q, bucket.products(queries[q], rows), ids)


def shipped(pairs: DataFrame) -> DataFrame:
    """The pairs of query block and bucket whose vectors are brought together."""
    return pairs


def reach_of(lengths: np.ndarray, least: np.ndarray) -> float:
    """The length from which on a vector may enter the result of a block: the smallest least score over its query's own length."""
    known = (least > 0) & (lengths > 0)
    return float(np.min(least / np.where(lengths > 0, lengths, 1), where=known, initial=np.inf) * (1 - SLACK)) if known.all() else 0.0


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows with the highest product."""
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors, scale))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = materialize(blocks_of(rows, bucket_rows, partitions))
    asked = rows.filter(is_query).groupBy("vec_id", "dim").agg(F.min(F.struct("vector", "squared")).alias("m"))
    one = W.partitionBy("vec_id").orderBy("m.vector")
    asked = asked.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("vec_id", "dim", "m.vector", "m.squared")
    blocks = blocks_of(asked, query_rows, partitions)

    # one bucket per dimension: the longest vectors, a few rows of fixed size
    longest = W.partitionBy("dim").orderBy(F.desc("longest"), "block")
    first = buckets.withColumn("_n", F.row_number().over(longest)).filter("_n = 1").select("dim", F.col("ids").alias("long_ids"), F.col("vectors").alias("long_vectors"))
    started = blocks.join(first, "dim")
    schema = BLOCKS + ", least binary, reach double"

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        for dim, block, length, ids, data, long_ids, long_vectors in rows_of(batches):
            queries = np.frombuffer(data, "<i8").reshape(-1, dim)
            best = Best(np.frombuffer(ids, "<i8"), k)
            lengths = lengths_of(queries)
            visit(queries, lengths, np.full(len(queries), -np.inf), Bucket(dim, long_ids, long_vectors), best)
            least = np.array([best.least(q) for q in range(len(queries))])
            yield from out.add((block, dim, length, ids, data, least.tobytes(), reach_of(lengths, least)), len(data) + len(ids))
        yield from out.flush()

    # which pairs may hold a result is decided on lengths alone, before any vector moves
    queries = materialize(started.select("dim", "block", "longest", "ids", "vectors", "long_ids", "long_vectors").mapInArrow(start, schema))
    reach = queries.select("dim", F.col("block").alias("q_block"), "reach")
    pairs = buckets.select("dim", "block", "longest").join(reach, "dim").filter(F.col("longest") * (1 + SLACK) >= F.col("reach")).select("dim", "block", "q_block")
    asking = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "least")
    near = shipped(pairs).join(buckets.select("dim", "block", "ids", "vectors"), ["dim", "block"])
    visits = asking.join(near, ["dim", "q_block"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(FOUND))
        name, best, held = None, None, None

        def emit():
            for q, (scores, ids) in enumerate(best.found if best else ()):
                for score, vec_id in zip(scores.tolist(), ids.tolist()):
                    yield from out.add((int(best.ids[q]), vec_id, score))

        for dim, q_ids, q_vectors, least, ids, data in rows_of(batches):
            if name != (dim, q_ids):
                yield from emit()
                name, best = (dim, q_ids), Best(np.frombuffer(q_ids, "<i8"), k)
                asked_vectors = np.frombuffer(q_vectors, "<i8").reshape(-1, dim)
                held = asked_vectors, lengths_of(asked_vectors), np.frombuffer(least, "<f8")
            visit(*held, Bucket(dim, ids, data), best)
        yield from emit()
        yield from out.flush()

    found = visits.select("dim", "q_ids", "q_vectors", "least", "ids", "vectors").mapInArrow(search, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
