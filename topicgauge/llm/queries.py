"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge.llm import byte_bpe, collocations, exact_dedup, language_id, mixing, ngram_join, packing, pii, prefix_trie, quality, token_counts, topk_search, url_filter
from topicgauge.llm import sql as Q
from topicgauge.llm.common import crc_bucket, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
#: host, path, verdict
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@register(Q.EXACT_DEDUP)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))


@register(Q.url_filter(URL_RULES))
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@register(Q.TOPK_SEARCH)
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register(Q.mixing(mixing.WEIGHTS, mixing.SHARE, mixing.LIMIT, mixing.CURRICULUM, mixing.FILLS))
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position")
    return mix.select("doc_id", "size", "source_size", "target", "copies", "taken", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


@register()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = language_id.learn(docs.select("doc_id", "text", "lang"), crc_bucket(F.col("doc_id"), 4) != 2)
    judged = language_id.identify(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return decoded.select(
        "doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket(F.col("doc_id"), 5)
    weights = quality.train(quality.training_shards(docs, table(spark, sf_dir, "labels"), fold != 0))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@register(Q.NGRAM_JOIN)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


#: A pseudonym is only as secret as its key; this one is for the given test tables.
PSEUDONYM_KEY = b"key of the registered query"


@register()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@register()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return counts.select("doc_id", F.col("section").cast("int").alias("line"), "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"))


@register()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_words(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register(Q.PREFIX_TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), prefix_trie.shared_turns(conv_id), prefix_trie.begun_by(conv_id))
    return trie.drop("node")


@register(Q.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
