"""Small tables with the cases every operator has to take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, rows, extra=()):
    """Documents of (doc_id, text[, lang[, source]]), with extra columns of clashing names."""
    full = [(*r, *["en", "s"][len(r) - 2 :], len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def edge_rows():
    """Null and empty texts, null ids, repeated rows, one very long text."""
    long_text = " ".join(f"wort{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "  \n\t"), (None, "Only a few words here"), (4, "Only a few words here"), (4, "Only a few words here"),
        (5, long_text), (6, long_text.upper()), (7, "É é \u2003 Ünï 日本 🙂"), (None, None),
    ]
