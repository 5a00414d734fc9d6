"""Documents, queries and vector tables derived from the given tables.

Every derivation is row by row over a whole table, and :mod:`workload.oracle` states the
same expressions in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicgauge.functions.bands import band_struct
from topicgauge.functions.vectors import l2_normalize, norm
from topicgauge.operators.embedding import HashedTerms, PrecomputedVectors
from topicgauge.operators.ranking import position_in_group
from topicgauge.sources.readers import as_documents, input_partitions, make_queries, spread

EMBEDDER = HashedTerms(16)
#: Bands for the given vectors, which lie far apart even under one label.
VECTOR_BANDS = {"strong": 0.25, "moderate": 0.15, "weak": 0.05}
#: Turns are numbered below this, so a conversation and a turn make one number without collisions.
TURNS = 1 << 32

#: query_id, query, scope (language of the documents it is asked of), intent override
TOPICS: list[tuple[int, str, str, str | None]] = [
    (1, "the tion and ther of with", "en", None),
    (2, "that the", "en", None),
    (3, "how to read the tion with this and ther", "en", None),
    (4, "best software pricing and the ther tion of that", "en", None),
    (5, "that with the tion", "en", "how_to"),
    (6, "de la les pour avec", "fr", None),
    (7, "le des", "fr", None),
    (8, "die der und von eine nicht", "de", None),
    (9, "de la que los para", "es", None),
]

# Line rewrites that give plain prose the structure the section parsers and signals look for.
# Pairs of (pattern, replacement) in Java syntax; the SQL side writes \1 for $1. ``^`` is the start of a line.
MARKDOWN_REWRITES: list[tuple[str, str]] = [
    (r"^To ", r"1. To "),
    (r"^Of ", r"step 2 Of "),
    (r"^In ([^\n]*)", r"| In | $1 |"),
    (r"^And ", r"[And](https://example.com/and) "),
    (r"^With ", "```\n"),
    (r"^Is ", r"FAQ: Is "),
    (r"^Or [^\n]*", r"## Sources"),
    (r"^It ", r"TL;DR it "),
    (r"^A ", r"For example A "),
    (r"^That ", r"Updated 2024. That "),
    (r"^By ", r"Compare https://example.org/by) by "),
    (r"^([A-MÉ][^.\n]{0,40})\.[ \n]", "## $1\n"),
    (r"^([N-Z][^.\n]{0,40})\.[ \n]", "### $1\n"),
]
HTML_REWRITES: list[tuple[str, str]] = [
    (r"<(/?)h1>", r"<$1h2>"),
    (r"<p><b>([^<]*)<br>", r"<h3 class='x'>$1</h3>"),
]


def _rewritten(docs: DataFrame, rewrites: list[tuple[str, str]]) -> DataFrame:
    """A byte search for the word that a line has to begin with spares most texts the pattern."""
    text = F.col("text")
    for pattern, replacement in rewrites:
        written = F.regexp_replace(text, "(?dm)" + pattern, replacement)
        word = re.match(r"\^([A-Za-z]+ )", pattern)
        if word:
            written = F.when(text.startswith(word[1]) | text.contains("\n" + word[1]), written).otherwise(text)
        docs = docs.withColumn("text", written)
    return docs


def _partitions(spark: SparkSession) -> int:
    """The given tables are single small files; a job over large ones sets the option to 0."""
    return input_partitions(spark, 2 * spark.sparkContext.defaultParallelism)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark: SparkSession) -> DataFrame:
    return make_queries(spark, TOPICS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(as_documents(_table(spark, sf_dir, "documents"), scope="lang"), _partitions(spark), "doc_id")


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(documents(spark, sf_dir), MARKDOWN_REWRITES)


def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    docs = spread(as_documents(pages, "page_id", "html", lang), _partitions(spark), "doc_id")
    return _rewritten(docs, HTML_REWRITES)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, Markdown and HTML documents in one table, told apart by ``doc_id % 3``."""
    parts = (documents(spark, sf_dir), markdown_documents(spark, sf_dir), html_documents(spark, sf_dir))
    tables = [p.withColumn("doc_id", F.col("doc_id") * 3 + i) for i, p in enumerate(parts)]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def turn_id(conversation: Column, turn: Column) -> Column:
    return conversation * TURNS + turn


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asked of the turn after it in its conversation, where there is one."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    ids = turn_id(F.col("conv_id"), F.col("turn"))
    return turns.join(after, ["conv_id", "turn"]).select(ids.alias("query_id"), (ids + 1).alias("doc_id"))


def turn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a query text."""
    return _table(spark, sf_dir, "conversations").select(
        turn_id(F.col("conv_id"), F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
        F.col("role").alias("scope"),
        F.lit(None).cast("string").alias("intent_override"),
    )


def damaged_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queries of which some are null or blank."""
    def damaged(c, length):
        return F.when(length % 5 == 0, F.lit(None)).when(length % 7 == 0, " \t\n ").otherwise(c)

    docs = _table(spark, sf_dir, "documents")
    turns = turn_queries(spark, sf_dir)
    return (
        docs.select("doc_id", damaged(F.col("text"), F.col("n_chars")).alias("text")),
        turns.withColumn("query", damaged(F.col("query"), F.length("query"))),
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as a pre-chunked table: a label is a document, a vector a chunk.

    A label may hold a large share of all vectors, so positions are counted in blocks.
    """
    table = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("doc_id"), "vec_id")
    placed = position_in_group(table, "doc_id", "vec_id", "chunk_index")
    sizes = table.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    scope = F.col("doc_id").cast("string")
    return placed.join(sizes, "doc_id").withColumns({"scope": scope, "level": F.lit("flat")})


#: Labels below this number are one document of :func:`hot_vector_chunks`.
HOT_LABELS = 4


def hot_vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as a chunk table in which one document holds more than a third of all chunks."""
    doc_id = F.when(F.col("label") < HOT_LABELS, 0).otherwise(F.col("label")).cast("bigint")
    table = _table(spark, sf_dir, "embeddings").select(doc_id.alias("doc_id"), "vec_id")
    return position_in_group(table, "doc_id", "vec_id", "chunk_index").withColumn("scope", F.col("doc_id").cast("string"))


def centroid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries per label: its own mean vector, asked of itself and of the next label (after the last, the first)."""
    table = _table(spark, sf_dir, "embeddings")
    dims = table.select(F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"])
    unit = means.groupBy("label").agg(mean.alias("mean")).withColumn("query_vector", l2_normalize(F.col("mean")))
    in_order = Window.orderBy("label")  # one row per label
    following = F.coalesce(F.lead("label").over(in_order), F.first("label").over(in_order))
    asked = unit.withColumn("next", following).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    return asked.select(
        (F.col("label") * 2 + F.col("shift")).alias("query_id"),
        F.when(F.col("shift") == 0, F.col("label")).otherwise(F.col("next")).cast("string").alias("scope"),
        "query_vector",
        F.lit(1.0).alias("query_norm"),
        band_struct(VECTOR_BANDS).alias("bands"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> PrecomputedVectors:
    return PrecomputedVectors(_table(spark, sf_dir, "embeddings"), ("vec_id",), 64, normalized=True)


#: What :func:`damaged_vectors` does to a vector, by ``vec_id % 7``; the rest stay as they are.
DAMAGE = ("null", "shorter", "hole", "nan", "zero")


def damaged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as chunks of their label, some of them missing, short, with holes, without numbers or zero."""
    table = _table(spark, sf_dir, "embeddings")
    v, kind = F.col("embedding").cast("array<double>"), F.col("vec_id") % 7
    last = F.slice(v, 1, 63)
    damaged = (
        F.when(kind == 0, F.lit(None).cast("array<double>")).when(kind == 1, last)
        .when(kind == 2, F.concat(last, F.array(F.lit(None).cast("double"))))
        .when(kind == 3, F.concat(last, F.array(F.lit(float("nan"))))).when(kind == 4, F.transform(v, lambda x: F.lit(0.0)))
        .otherwise(F.transform(v, lambda x: x * 3.0))
    )
    chunks = table.select(
        F.col("label").cast("bigint").alias("doc_id"), F.col("vec_id").cast("int").alias("chunk_index"), damaged.alias("vector"),
        F.col("label").cast("string").alias("scope"),
    )
    return chunks.withColumn("norm", norm(F.col("vector")))


def faulty_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and topics with every fault an analysis has to report.

    By ``doc_id % 11``: 0 null, 1 blank, 2 only empty headings, 3 a scope nobody asks, 4 an unknown strategy.
    """
    docs = documents(spark, sf_dir)
    kind = F.col("doc_id") % 11
    text = (
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, " \t\n ").when(kind == 2, "<h2></h2><h3> </h3>").otherwise(F.col("text"))
    )
    strategy = F.when(kind == 4, "outline").when(kind == 2, "html").otherwise("flat")
    asked = make_queries(spark, [*TOPICS, (10, " ", "en", None), (11, None, "de", None), (12, "nobody there", "nowhere", None)])
    return docs.select(
        "doc_id", text.alias("text"), F.when(kind == 3, "elsewhere").otherwise(F.col("scope")).alias("scope"), strategy.alias("strategy")
    ), asked
