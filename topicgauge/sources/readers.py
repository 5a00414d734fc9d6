"""Input tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.functions import text as X
from topicgauge.schemas import QUERIES

#: A job may name here in how many tasks small input files are to be worked on; unset or 0 keeps the scan's tasks.
INPUT_PARTITIONS = "topicgauge.input.partitions"


def spread(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Repartition an input whose files are too few for the cores; 0 keeps the partitions of the scan."""
    return df.repartition(partitions, *keys) if partitions else df


def read_documents(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    scope: str | Column | None = None,
    **options: str,
) -> DataFrame:
    """Documents from any Spark file format; only the named columns are read."""
    table = spark.read.format(fmt).options(**options).load(path)
    return as_documents(table, doc_id, text, scope)


def as_documents(
    table: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", scope: str | Column | None = None
) -> DataFrame:
    def col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    group = F.lit("all") if scope is None else col(scope)
    return table.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"), group.alias("scope"))


def input_partitions(spark: SparkSession, default: int = 0) -> int:
    return int(spark.conf.get(INPUT_PARTITIONS, str(default)))


def make_queries(spark: SparkSession, rows: list[tuple[int, str, str, str | None]]) -> DataFrame:
    """A query table from ``(query_id, query, scope, intent_override)`` tuples given as job options.

    Built through Arrow, so Spark knows its exact size and broadcasts it only where it is small.
    """
    columns = list(zip(*rows, strict=True))
    types = (pa.int64(), pa.string(), pa.string(), pa.string())
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=QUERIES.names), QUERIES)


def _reason(c: Column, what: str) -> Column:
    return F.when(c.isNull(), f"{what} is null").when(X.is_blank(c), f"{what} is blank")


def accepted_documents(documents: DataFrame) -> DataFrame:
    # filters are not pushed through a generator: below the projections that write the text, it would be written once more
    judged = documents.withColumn("_accepted", F.explode(F.array(_reason(F.col("text"), "document").isNull())))
    return judged.filter("_accepted").drop("_accepted")


def accepted_queries(queries: DataFrame) -> DataFrame:
    return queries.filter(_reason(F.col("query"), "query").isNull())


def rejected_inputs(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows that cannot be compared, with the reason; a bad row never fails the job."""
    no_id = F.lit(None).cast("bigint")
    docs = documents.select(
        no_id.alias("query_id"), "doc_id", _reason(F.col("text"), "document").alias("reason")
    )
    asked = queries.select("query_id", no_id.alias("doc_id"), _reason(F.col("query"), "query").alias("reason"))
    return docs.unionByName(asked).filter(F.col("reason").isNotNull())


def unasked(documents: DataFrame, queries: DataFrame, on: str = "scope") -> DataFrame:
    """Documents that no usable query is asked of, and usable queries without any document."""
    no_id = F.lit(None).cast("bigint")
    docs, asked = accepted_documents(documents), accepted_queries(queries)
    lone = docs.join(asked.select(on).distinct(), on, "left_anti")
    idle = asked.join(docs.select(on).distinct(), on, "left_anti")
    return lone.select(no_id.alias("query_id"), "doc_id", F.lit("no query asks for it").alias("reason")).unionByName(
        idle.select("query_id", no_id.alias("doc_id"), F.lit("no document to ask").alias("reason"))
    )
