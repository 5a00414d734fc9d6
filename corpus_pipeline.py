"""A corpus pipeline of five stages, each over all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a table that
is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents.

Defined results: a null text counts as empty in every stage, and what a stage keeps of it has no ids in the
last; rows with null or repeated ids are judged each on their own by the classifier, one row of an equal text stays, one row of a
group of near duplicates stays (texts without words are near nothing), and a text of size 0 is not mixed; ties go to the
largest id in the second stage, the smallest in the third, and by hash of the id in the fourth. Texts are processed whole, however long.
Columns beside those of documents are carried along, whatever their names. An empty table gives an empty table in
every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from topicgauge.llm.common import hand_over_in_small_batches, table
from topicgauge.llm.queries import VOCABULARY
from topicgauge.sources.storage import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all labels, accepts."""
    weights = quality.train(quality.training_shards(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    return quality.keep_good(docs, weights)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    hand_over_in_small_batches(spark)
    return exact_dedup.drop_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    hand_over_in_small_batches(spark)
    return ngram_join.drop_near_duplicates(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, as often as it takes them, in training order."""
    return mixing.training_order(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text.

    The ids are stored in between: in one stage with the decoder, every task would hold two Python workers, and these stay.
    """
    hand_over_in_small_batches(spark)
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    decoded = byte_bpe.decode(materialize(byte_bpe.encode(docs, path, pattern)), path, pattern)
    return decoded.select("doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram jaccard join", dissimilar_documents),
    ("source mixing", mixed_documents),
    ("byte-level bpe", encoded_documents),
]

#: SQL can express neither the classifier nor the encoding; tests hold both against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
