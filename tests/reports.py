"""Hand-made scored tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.operators.diagnostics import with_text_facts

SCHEMA = (
    "query_id long, doc_id long, chunk_index int, similarity double, text string, level string, heading string, "
    "parent_index int, depth int, token_count int, document_char_count int"
)


def scored(spark: SparkSession, reports: dict[int, list], bands=S.STANDARD_BANDS) -> DataFrame:
    """``{doc_id: [similarity or (similarity, level, heading, parent), ...]}`` as a scored table of query 1."""
    rows = []
    for doc, chunks in reports.items():
        for i, c in enumerate(chunks):
            s, level, heading, parent = c if isinstance(c, tuple) else (c, "flat", None, None)
            rows.append((1, doc, i, float(s), f"chunk {i} of {doc}", level, heading, parent, 0, 10, 100))
    df = with_text_facts(spark.createDataFrame(rows, SCHEMA)).drop("text").withColumn("bands", B.band_struct(bands))
    sizes = df.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    return df.join(sizes, "doc_id").withColumn("interpretation", B.interpret(F.col("similarity"), F.col("bands")))


def by_doc(df: DataFrame) -> dict:
    return {r.doc_id: r for r in df.collect()}
