"""Table schemas. Every table is keyed by some of ``query_id``, ``doc_id``, ``chunk_index``."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("scope", T.StringType()),
    ]
)

#: ``scope`` names the documents a query is asked of; ``intent_override`` is null for inferred intent.
QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("query", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("intent_override", T.StringType()),
    ]
)

CHUNK_FIELDS = (
    "text", "char_start", "char_end", "token_count", "level", "heading", "parent_index", "depth",
)

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("level", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("parent_index", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
    ]
)
