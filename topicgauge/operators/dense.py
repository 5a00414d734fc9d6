"""Query-to-chunk similarity as matrix products, for vectors as wide as a model's.

An expression multiplies one pair at a time and is interpreted; here every Arrow batch of chunks is
multiplied with all queries of its scopes at once. The queries travel as one broadcast value, so they must be
small: their size is checked before, and larger ones take the join of :func:`topicgauge.operators.similarity.score`.
Neither way shuffles the chunks' vectors when the queries are few.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicgauge.functions import bands as B
from topicgauge.operators import similarity
from topicgauge.sources.storage import materialize

#: Bytes of query vectors that are broadcast at most.
QUERY_BYTES = 64 << 20
#: Vectors at least this wide are scored here by default: below, the expression is about as fast.
WIDE = 128
#: Pairs that a task makes at a time.
PAIRS = 1 << 18


def query_bytes(queries: DataFrame) -> int:
    return queries.agg(F.coalesce(F.sum(F.coalesce(F.size("query_vector"), F.lit(0)) * 8 + 200), F.lit(0))).first()[0]


def matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` numbers as a matrix, and which rows they are."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    values = vectors.take(pa.array(rows)).flatten()
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if values.null_count:  # a hole has no product
        holes = ~values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(axis=1)
        numbers, rows = numbers[~holes], rows[~holes]
    return numbers, rows


def _similarities(numbers: np.ndarray, norms: np.ndarray, asked: np.ndarray, asked_norms: np.ndarray, assume_normalized: bool) -> np.ndarray:
    with np.errstate(all="ignore"):
        products = numbers @ asked.T
        if not assume_normalized:
            lengths = np.outer(norms, asked_norms)
            products = np.where((lengths == 0) & ~np.isnan(products), 0.0, products / lengths)
        return np.clip(products, -1.0, 1.0)  # NaN stays and has no similarity


def score_blocked(
    chunks: DataFrame, queries: DataFrame, on: str = "scope", assume_normalized: bool = False, query_limit: int | None = None
) -> DataFrame:
    """What :func:`similarity.score` gives, to rounding: every chunk against every query of its scope."""
    queries = materialize(queries.select(on, "query_id", "query_vector", "query_norm", "bands"))
    if query_bytes(queries) > (QUERY_BYTES if query_limit is None else query_limit):
        return similarity.score(chunks, queries, on, assume_normalized=assume_normalized)
    # scope -> size of vectors -> (places in the query table, vectors, norms); bounded by the check above
    table = queries.toArrow().combine_chunks()
    groups: dict[object, dict[int, list[int]]] = {}
    for place, (scope, vector) in enumerate(zip(table[on].to_pylist(), table["query_vector"].to_pylist())):
        if scope is not None and vector and None not in vector:
            groups.setdefault(scope, {}).setdefault(len(vector), []).append(place)
    norms = table["query_norm"].to_numpy()
    by_scope = {
        scope: {dim: (np.array(p), np.array([table["query_vector"][k].as_py() for k in p], float), norms[p]) for dim, p in dims.items()}
        for scope, dims in groups.items()
    }
    shared = chunks.sparkSession.sparkContext.broadcast((by_scope, table.drop_columns([on, "query_vector", "query_norm"])))
    kept = [c for c in chunks.columns if c not in ("vector", "norm")]
    fields = [chunks.schema[c] for c in kept] + [T.StructField("query_id", queries.schema["query_id"].dataType), queries.schema["bands"]]
    schema = T.StructType([*fields, T.StructField("similarity", T.DoubleType())])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_scope, asked = shared.value
        for batch in batches:
            scopes = np.array(batch[on].to_pylist(), object)
            all_norms = batch["norm"].to_numpy(zero_copy_only=False).astype(float)
            plain = batch.select(kept)
            for scope in {s for s in scopes.tolist() if s in by_scope}:
                own = np.flatnonzero(scopes == scope)
                vectors = batch["vector"].take(pa.array(own))
                for dim, (places, wanted, wanted_norms) in by_scope[scope].items():
                    numbers, rows = matrix(vectors, dim)
                    step = max(1, PAIRS // len(places))
                    for at in range(0, len(rows), step):
                        here = own[rows[at : at + step]]
                        found = _similarities(numbers[at : at + step], all_norms[here], wanted, wanted_norms, assume_normalized)
                        i, j = np.nonzero(~np.isnan(found))
                        left, right = plain.take(pa.array(here[i])), asked.take(pa.array(places[j]))
                        columns = [*left.columns, *(right[c].combine_chunks() for c in ("query_id", "bands")), pa.array(found[i, j])]
                        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "query_id", "bands", "similarity"])

    pairs = chunks.mapInArrow(multiply, schema)
    return pairs.withColumn("interpretation", B.interpret(F.col("similarity"), F.col("bands")))
