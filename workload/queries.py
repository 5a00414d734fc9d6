"""The registered queries: each a Spark plan over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgauge import guidance
from topicgauge import settings as S
from topicgauge.functions import bands as B
from topicgauge.functions import text as X
from topicgauge.functions import vectors as V
from topicgauge.operators import (
    chunking, dense, diagnostics, embedding, nextsteps, ranking, readiness, recommendations, sections, signals, similarity,
)
from topicgauge.plans.analysis import Analysis, analyze, analyze_chunks
from topicgauge.plans.compare import chunks_above, compare_documents, embed_queries as embed_query_table, score_documents
from topicgauge.plans.compare import score_prechunked as score_chunk_table
from topicgauge.settings import ChunkOptions
from topicgauge.sources.readers import rejected_inputs
from topicgauge.sources.storage import materialize
from workload import corpora as W
from workload import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doubles to six places: sums depend on the order of addition in the last bits."""
    types = dict(df.dtypes)
    names = columns or df.columns
    return df.select(*[F.round(c, 6).alias(c) if types[c] == "double" else F.col(c) for c in names])


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def joined(values, sep: str = ","):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def micro(values):
    """Doubles as whole millionths, so a list reads the same in any engine."""
    return joined(F.transform(values, lambda x: F.round(x * 1000000).cast("bigint")))


KEY = "query_id, doc_id, chunk_index"
K = ("query_id", "doc_id", "chunk_index")


# --- shared inputs -----------------------------------------------------------------


def plain_scored(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(W.documents(spark, sf), W.topics(spark), W.EMBEDDER)


def mixed_scored(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(W.mixed_documents(spark, sf), W.topics(spark), W.EMBEDDER, "auto")


def plain_analysis(spark: SparkSession, sf: str) -> Analysis:
    return analyze(W.documents(spark, sf), W.topics(spark), W.EMBEDDER)


def mixed_analysis(spark: SparkSession, sf: str) -> Analysis:
    return analyze(W.mixed_documents(spark, sf), W.topics(spark), W.EMBEDDER, "auto")


def advice_analysis(spark: SparkSession, sf: str) -> Analysis:
    """For reports that show no content signals: coverage, sections and recommendations."""
    return analyze(W.mixed_documents(spark, sf), W.topics(spark), W.EMBEDDER, "auto", keep_signals=False)


def vector_scored(spark: SparkSession, sf: str) -> DataFrame:
    chunks = W.vectors(spark, sf).embed(W.vector_chunks(spark, sf))
    return similarity.score(chunks, W.centroid_queries(spark, sf))


# --- sources -------------------------------------------------------------------------


@register("SELECT doc_id, text, lang AS scope, length(text) AS document_char_count FROM documents")
def scan_documents(spark, sf):
    return W.documents(spark, sf).withColumn("document_char_count", F.length("text"))


@register(
    f"SELECT conv_id * {W.TURNS} + turn AS query_id, text AS query, role AS scope, {O.words('text')} AS query_words FROM conversations"
)
def scan_queries(spark, sf):
    return similarity.with_query_words(W.turn_queries(spark, sf)).drop("intent_override")


def _damage(c: str, n: str) -> str:
    return f"CASE WHEN {n} % 5 = 0 THEN NULL WHEN {n} % 7 = 0 THEN ' ' || chr(9) || chr(10) || ' ' ELSE {c} END"


@register(f"""
WITH d AS (SELECT doc_id, {_damage('text', 'n_chars')} AS t FROM documents),
q AS (SELECT conv_id * {W.TURNS} + turn AS query_id, {_damage('text', 'length(text)')} AS t FROM conversations)
SELECT NULL::BIGINT AS query_id, doc_id, CASE WHEN t IS NULL THEN 'document is null' ELSE 'document is blank' END AS reason
  FROM d WHERE t IS NULL OR {O.strip('t')} = ''
UNION ALL SELECT query_id, NULL::BIGINT, CASE WHEN t IS NULL THEN 'query is null' ELSE 'query is blank' END
  FROM q WHERE t IS NULL OR {O.strip('t')} = ''""")
def reject_invalid_inputs(spark, sf):
    return rejected_inputs(*W.damaged_inputs(spark, sf))


# --- chunking ------------------------------------------------------------------------


@register(f"SELECT doc_id, {O.tokens('text')} AS token_count FROM documents")
def token_estimate(spark, sf):
    return W.documents(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("token_count"))


@register(f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence_no, s AS sentence FROM (
  SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (SELECT doc_id, {O.pieces('text')} AS ss FROM documents))
WHERE {O.strip('s')} <> ''""")
def sentence_split(spark, sf):
    return chunking.sentence_rows(W.documents(spark, sf))


_FLAT = "doc_id, chunk_index, chunk_count, text, token_count, level, depth"


@register(O.on("plain", f"SELECT {_FLAT} FROM chunks"))
def chunk_flat(spark, sf):
    rows = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    return rows.select(*_FLAT.split(", "))


@register(O.on("plain", "SELECT doc_id, chunk_index, char_start, char_end FROM flat_placed"))
def chunk_flat_offsets(spark, sf):
    return chunking.chunk_documents(W.documents(spark, sf)).select("doc_id", "chunk_index", "char_start", "char_end")


_CHUNK = "doc_id, chunk_index, chunk_count, text, token_count, level, heading, parent_index, depth"


@register(O.on("mixed", f"SELECT {_CHUNK} FROM chunks"))
def chunk_dispatch(spark, sf):
    rows = chunking.chunk_documents(W.mixed_documents(spark, sf), "auto", ChunkOptions(with_offsets=False))
    return rows.select(*_CHUNK.split(", "))


@register(O.on("mixed", f"SELECT doc_id, {O.STRATEGY['mixed']} AS format FROM docs"))
def detect_format(spark, sf):
    return W.mixed_documents(spark, sf).select("doc_id", chunking.detect_format(F.col("text")).alias("format"))


_SECTION = "doc_id, section_no, level, heading, content, char_start, char_end"


@register(O.on(
    "markdown",
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no, level, heading, content, "
    "char_start, char_end FROM md WHERE content <> ''",
))
def sections_markdown(spark, sf):
    return chunking.sections(W.markdown_documents(spark, sf), "markdown").select(*_SECTION.split(", "))


@register(O.on(
    "html",
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no, level, heading, content, "
    "char_start, char_end FROM html WHERE sec > 0 OR content <> ''",
))
def sections_html(spark, sf):
    return chunking.sections(W.html_documents(spark, sf), "html").select(*_SECTION.split(", "))


@register(O.on("markdown", "SELECT doc_id, chunk_index, level, parent_index FROM chunks"))
def chunk_parents(spark, sf):
    rows = chunking.chunk_documents(W.markdown_documents(spark, sf), "markdown", ChunkOptions(with_offsets=False))
    return rows.select("doc_id", "chunk_index", "level", "parent_index")


_TREE = _CHUNK + ", char_start, char_end"


@register(O.on("markdown", f"SELECT {_TREE} FROM chunks"))
def chunk_hierarchical(spark, sf):
    """Documents without headings are among them, cut flat."""
    return chunking.chunk_documents(W.markdown_documents(spark, sf), "markdown").select(*_TREE.split(", "))


@register(O.on("html", f"SELECT {_TREE} FROM chunks"))
def chunk_hierarchical_html(spark, sf):
    return chunking.chunk_documents(W.html_documents(spark, sf), "html").select(*_TREE.split(", "))


_ALL_MARKDOWN = O.PRELUDES["plain"].replace("'flat' AS strategy", "'markdown' AS strategy")


@register(_ALL_MARKDOWN + "\nSELECT doc_id, chunk_index, text, token_count, level, char_start, char_end FROM chunks")
def split_long_atomic(spark, sf):
    """Documents without headings, cut as Markdown: one section each, split where it is long."""
    rows = chunking.chunk_documents(W.documents(spark, sf), "markdown")
    return rows.select("doc_id", "chunk_index", "text", "token_count", "level", "char_start", "char_end")


@register(O.on("plain", "SELECT doc_id, sum(token_count)::BIGINT AS document_token_count FROM chunks GROUP BY 1"))
def doc_token_totals(spark, sf):
    rows = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    return chunking.token_totals(rows)


@register(O.on("mixed", "SELECT doc_id, chunk_index, char_count, word_count, level <> 'flat' AS is_hierarchical FROM chunks"))
def chunk_stats(spark, sf):
    rows = chunking.chunk_documents(W.mixed_documents(spark, sf), "auto", ChunkOptions(with_offsets=False))
    return chunking.with_chunk_stats(rows).select("doc_id", "chunk_index", "char_count", "word_count", "is_hierarchical")


# --- vectors and similarity --------------------------------------------------------------


def _counted(source: str, keys: str, text: str) -> str:
    """Bucket counts of every text as a comma-separated list, with the squared norm."""
    return f"""
tfs AS ({O._terms(source, keys, text)}),
grid AS (SELECT {keys}, unnest(range(0, {O.DIM})) AS b FROM {source}),
lists AS (SELECT {keys}, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY b) AS vector, sum(coalesce(n, 0) ** 2)::BIGINT AS square_norm
  FROM grid LEFT JOIN tfs USING ({keys}, b) GROUP BY ALL)"""


def _vector_list(df: DataFrame, *keys: str) -> DataFrame:
    counts = F.transform("vector", lambda x: x.cast("bigint"))
    square = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    return df.select(*keys, joined(counts).alias("vector"), square.alias("square_norm"))


@register(
    f"WITH qs AS (SELECT conv_id * {W.TURNS} + turn AS query_id, text FROM conversations WHERE {O.strip('text')} <> ''),"
    + _counted("qs", "query_id", "text") + " SELECT query_id, vector, square_norm FROM lists"
)
def embed_queries(spark, sf):
    return _vector_list(embed_query_table(W.turn_queries(spark, sf), W.EMBEDDER), "query_id")


@register(O.PRELUDES["plain"] + "," + _counted("chunks", "doc_id, chunk_index", "text") + "\nSELECT doc_id, chunk_index, vector, square_norm FROM lists")
def embed_chunks(spark, sf):
    rows = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    return _vector_list(embedding.embed(rows, W.EMBEDDER), "doc_id", "chunk_index")


@register("""
SELECT vec_id, string_agg(round(x / len * 1000000)::BIGINT::VARCHAR, ',' ORDER BY i) AS unit FROM (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE * (1 + vec_id % 7) AS x,
  sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * (1 + vec_id % 7)) ** 2))) AS len FROM embeddings) GROUP BY vec_id""")
def l2_normalize(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    stretched = F.transform(embedding.as_vector(F.col("embedding")), lambda x: x * (F.col("vec_id") % 7 + 1))
    return table.select("vec_id", micro(V.l2_normalize(stretched)).alias("unit"))


@register("SELECT vec_id, 'precomputed' AS model_name, len(embedding) AS embedding_dim FROM embeddings")
def vector_metadata(spark, sf):
    store = W.vectors(spark, sf)
    rows = store.embed(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id"))
    return embedding.with_metadata(rows, store).select("vec_id", "model_name", "embedding_dim")


_CENTROIDS = f"""
dims AS (SELECT vec_id, label::BIGINT AS label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY ALL),
lens AS (SELECT label, sqrt(sum(m * m)) AS len FROM means GROUP BY 1),
units AS (SELECT label, i, m, m / len AS u FROM means JOIN lens USING (label)),
asked AS (SELECT label, shift, label * 2 + shift AS query_id, CASE WHEN shift = 0 THEN label ELSE following END AS doc_id
  FROM (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS following FROM (SELECT DISTINCT label FROM means)),
  (VALUES (0), (1)) AS s(shift))"""
_VECTOR_SCORED = f"""WITH {_CENTROIDS},
vec_chunks AS (SELECT vec_id, label::BIGINT AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index,
  count(*) OVER (PARTITION BY label) AS chunk_count FROM embeddings),
products AS (SELECT a.query_id, d.vec_id, sum(u * x) AS p, sum(m * x) AS mx, sqrt(sum(m * m)) AS ml, sqrt(sum(x * x)) AS xl
  FROM asked a JOIN units t ON t.label = a.label JOIN dims d ON d.label = a.doc_id AND d.i = t.i GROUP BY ALL),
vec_scored AS MATERIALIZED (SELECT *, {O.INTERPRET} AS interpretation FROM (
  SELECT query_id, c.doc_id, c.chunk_index, c.chunk_count, c.vec_id, greatest(-1.0, least(1.0, p)) AS similarity,
    greatest(-1.0, least(1.0, mx / (ml * xl))) AS full_cosine,
    {W.VECTOR_BANDS['strong']}::DOUBLE AS strong, {W.VECTOR_BANDS['moderate']}::DOUBLE AS moderate, {W.VECTOR_BANDS['weak']}::DOUBLE AS weak
  FROM products JOIN vec_chunks c USING (vec_id)))"""


def _vector_pairs(spark, sf) -> DataFrame:
    """Each vector beside the two mean vectors asked of its label, before any scaling."""
    queries = W.centroid_queries(spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    chunks = table.select("vec_id", F.col("label").cast("string").alias("scope"), embedding.as_vector(F.col("embedding")).alias("vector"))
    return chunks.join(queries, "scope")


@register(_VECTOR_SCORED + "\nSELECT query_id, vec_id, round(full_cosine, 6) AS similarity, NULL::VARCHAR AS reason FROM vec_scored")
def cosine_pairs(spark, sf):
    pairs = _vector_pairs(spark, sf)
    a, b = F.transform("query_vector", lambda x: x * 3.0), F.col("vector")
    return pairs.select(
        "query_id", "vec_id", F.round(V.cosine(a, b), 6).alias("similarity"),
        V.cosine_reject_reason(a, b).alias("reason"),
    )


@register(_VECTOR_SCORED + "\nSELECT query_id, vec_id, round(similarity, 6) AS similarity FROM vec_scored")
def cosine_normalized(spark, sf):
    pairs = _vector_pairs(spark, sf)
    value = V.cosine_normalized(F.col("query_vector"), F.col("vector"))
    return pairs.select("query_id", "vec_id", F.round(value, 6).alias("similarity"))


_DAMAGED = _VECTOR_SCORED + """,
damaged AS (SELECT vec_id, label::BIGINT AS doc_id, vec_id % 7 AS kind FROM embeddings)"""


@register(_DAMAGED + """
SELECT a.query_id, d.doc_id, d.vec_id::INT AS chunk_index, ['null vector', 'dimension mismatch', 'null element', 'not a number'][kind + 1] AS reason
FROM damaged d JOIN asked a USING (doc_id) WHERE kind < 4""")
def score_rejects(spark, sf):
    return similarity.score_rejects(W.damaged_vectors(spark, sf), W.centroid_queries(spark, sf))


@register(_DAMAGED + f"""
SELECT v.query_id, v.vec_id, round(CASE WHEN kind = 4 THEN 0.0 ELSE full_cosine END, 6) AS similarity,
round(CASE WHEN kind = 4 THEN 0.0 ELSE greatest(-1.0, least(1.0, 3 * product)) END, 6) AS assumed
FROM (SELECT s.*, p.p AS product FROM vec_scored s JOIN products p USING (query_id, vec_id)) v JOIN damaged USING (vec_id) WHERE kind >= 4""")
def cosine_not_normalized(spark, sf):
    """Vectors of three times the unit length: their cosine, and what assuming unit length makes of them."""
    chunks, queries = W.damaged_vectors(spark, sf), W.centroid_queries(spark, sf)
    whole = similarity.score(chunks, queries).select("query_id", F.col("chunk_index").alias("vec_id"), "similarity")
    assumed = similarity.score(chunks, queries, assume_normalized=True).select(
        "query_id", F.col("chunk_index").alias("vec_id"), F.col("similarity").alias("assumed")
    )
    return shown(whole.join(assumed, ["query_id", "vec_id"]))


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')} FROM scored"))
def query_chunk_similarity(spark, sf):
    return shown(plain_scored(spark, sf), *K, "similarity")


@register(
    f"SELECT conv_id * {W.TURNS} + turn AS query_id, {O._band_columns(O.words('text'))} FROM conversations"
)
def query_thresholds(spark, sf):
    bands = B.bands_for_query(F.col("query"))
    return W.turn_queries(spark, sf).select("query_id", bands.alias("b")).select("query_id", "b.*")


@register(O.on("plain", f"SELECT {KEY}, interpretation FROM scored"))
def interpret_similarity(spark, sf):
    return plain_scored(spark, sf).select(*K, "interpretation")


@register(_VECTOR_SCORED + f"\nSELECT {KEY}, {r('similarity')}, interpretation FROM vec_scored")
def interpret_custom_bands(spark, sf):
    return shown(vector_scored(spark, sf), *K, "similarity", "interpretation")


@register(O.on("plain", f"""SELECT query_id, doc_id, document_char_count, document_token_count, total_chunks AS chunk_count,
{r('max_similarity', 'avg_similarity')}, best_chunk_index AS max_similarity_chunk_index, strong, moderate, weak,
'hashed-terms-16' AS model_name, 16 AS embedding_dim FROM facts"""))
def compare_query_to_document(spark, sf):
    rows = compare_documents(W.documents(spark, sf), W.topics(spark), W.EMBEDDER)
    return shown(rows.select("*", "bands.*").drop("bands"))


def _turn_pairs(spark, sf):
    """Every turn as a document, asked the turn before it."""
    turns = W.turn_queries(spark, sf)
    documents = turns.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"), "scope")
    return documents, turns, W.turn_pairs(spark, sf)


_PAIRS = f"""
turns AS (SELECT conv_id, turn, conv_id * {W.TURNS} + turn AS id, text FROM conversations),
pairs AS (SELECT q.id AS query_id, d.id AS doc_id, q.text AS query FROM turns d JOIN turns q ON q.conv_id = d.conv_id AND q.turn = d.turn - 1),
qt AS ({O._terms("pairs", "query_id", "query")}),
ct AS ({O._terms("chunks", "doc_id, chunk_index", "text")}),
qn AS (SELECT query_id, sum(n * n) AS sq FROM qt GROUP BY 1),
cn AS (SELECT doc_id, chunk_index, sum(n * n) AS sq FROM ct GROUP BY ALL),
pd AS (SELECT p.query_id, ct.doc_id, ct.chunk_index, sum(qt.n * ct.n) AS d FROM pairs p JOIN qt USING (query_id)
  JOIN ct ON ct.doc_id = p.doc_id AND ct.b = qt.b GROUP BY ALL),
pair_scored AS (SELECT *, {O.INTERPRET} AS interpretation FROM (SELECT p.query_id, c.doc_id, c.chunk_index,
  {O._band_columns(O.words('p.query'))},
  CASE WHEN qn.sq IS NULL OR cn.sq IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, coalesce(d, 0)::DOUBLE / (sqrt(qn.sq::DOUBLE) * sqrt(cn.sq::DOUBLE)))) END AS similarity
  FROM pairs p JOIN chunks c USING (doc_id) LEFT JOIN qn USING (query_id)
  LEFT JOIN cn ON cn.doc_id = c.doc_id AND cn.chunk_index = c.chunk_index
  LEFT JOIN pd ON pd.query_id = p.query_id AND pd.doc_id = c.doc_id AND pd.chunk_index = c.chunk_index))"""
_TURNS = O.PRELUDES["plain"].replace(
    O.CORPORA["plain"], f"SELECT conv_id * {W.TURNS} + turn AS doc_id, text, role AS scope FROM conversations"
)


@register(_TURNS + "," + _PAIRS + f"\nSELECT {KEY}, {r('similarity')}, interpretation FROM pair_scored")
def compare_pairs(spark, sf):
    documents, turns, pairs = _turn_pairs(spark, sf)
    return shown(score_documents(documents, turns, W.EMBEDDER, pairs=pairs), *K, "similarity", "interpretation")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')}, interpretation, text_preview FROM scored"))
def score_prechunked(spark, sf):
    """A chunk table as another job left it: only text and keys, no vectors."""
    table = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    scored = score_chunk_table(table, W.topics(spark), W.EMBEDDER).withColumn("text_preview", diagnostics.preview(S.PREVIEW_CHARS))
    return shown(scored, *K, "similarity", "interpretation", "text_preview")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')} FROM scored WHERE similarity >= 0.6"))
def result_above(spark, sf):
    return shown(diagnostics.above(plain_scored(spark, sf), 0.6), *K, "similarity")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')} FROM scored WHERE similarity < 0.6"))
def result_below(spark, sf):
    return shown(diagnostics.below(plain_scored(spark, sf), 0.6), *K, "similarity")


# --- diagnostics -----------------------------------------------------------------------

_DIAG = (
    "query_id, doc_id, chunk_index, text_preview, char_count, token_count, interpretation, similarity_rank, is_max, is_min, "
    "above_strong_threshold, above_moderate_threshold, below_weak_threshold, level, heading, parent_index, depth, word_count"
)
_DIAG_R = ("similarity", "normalized_score", "position_percent")


@register(O.on("mixed", f"SELECT {_DIAG}, {r(*_DIAG_R)} FROM diag"))
def chunk_diagnostics(spark, sf):
    return shown(diagnostics.diagnose(mixed_scored(spark, sf)), *_DIAG.split(", "), *_DIAG_R)


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')}, similarity_rank FROM diag"))
def similarity_rank(spark, sf):
    return shown(ranking.rank_chunks(plain_scored(spark, sf)), *K, "similarity", "similarity_rank")


_VECTOR_RANK = _VECTOR_SCORED + f"""
SELECT {KEY}, {r('similarity')}, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity DESC, chunk_index) AS similarity_rank,
round(CASE WHEN hi = lo THEN 0.5 ELSE (similarity - lo) / (hi - lo) END, 6) AS normalized_score FROM (
  SELECT *, max(similarity) OVER w AS hi, min(similarity) OVER w AS lo FROM vec_scored WINDOW w AS (PARTITION BY query_id, doc_id))"""


@register(_VECTOR_RANK)
def similarity_rank_hot(spark, sf):
    """Reports of unknown size are ranked in cells."""
    ranked = ranking.rank_chunks(materialize(vector_scored(spark, sf)), pre_chunked=True)
    rows = ranked.withColumn("normalized_score", diagnostics.normalized_score())
    return shown(rows, *K, "similarity", "similarity_rank", "normalized_score")


@register(O.on("plain", f"SELECT {KEY}, {r('normalized_score')} FROM diag"))
def normalized_score(spark, sf):
    return shown(diagnostics.diagnose(plain_scored(spark, sf)), *K, "normalized_score")


@register(O.on("plain", """SELECT doc_id, chunk_index,
round(CASE WHEN chunk_count > 1 THEN chunk_index::DOUBLE / (chunk_count - 1) ELSE 0.0 END, 6) AS position_percent FROM chunks"""))
def position_percent(spark, sf):
    rows = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    return shown(rows.withColumn("position_percent", diagnostics.position_percent()), "doc_id", "chunk_index", "position_percent")


@register(O.on("plain", "SELECT doc_id, chunk_index, text_preview, target_preview, example_text FROM chunks"))
def text_preview(spark, sf):
    rows = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    lengths = {"text_preview": S.PREVIEW_CHARS, "target_preview": S.TARGET_PREVIEW_CHARS, "example_text": S.EXAMPLE_CHARS}
    previews = [diagnostics.preview(n).alias(c) for c, n in lengths.items()]
    return diagnostics.with_text_facts(rows).select("doc_id", "chunk_index", *previews)


@register(O.on("plain", f"SELECT doc_id, chunk_index, {O.preview('text', 450)} AS text_preview FROM chunks"))
def text_preview_long(spark, sf):
    """A preview of any length: the beginning that is kept is as long."""
    rows = chunking.chunk_documents(W.documents(spark, sf), "flat", ChunkOptions(with_offsets=False))
    return diagnostics.with_text_facts(rows, lead_chars=450).select("doc_id", "chunk_index", diagnostics.preview(450).alias("text_preview"))


_COUNTS = "chunks_strong, chunks_moderate, chunks_weak, chunks_off_topic"
_SUMMARY = f"query_id, doc_id, total_chunks, {_COUNTS}, document_token_count, document_char_count"
_SUMMARY_R = (
    "max_similarity", "min_similarity", "avg_similarity", "median_similarity", "std_similarity", "percent_strong", "percent_on_topic",
)


@register(O.on("plain", f"SELECT {_SUMMARY}, {r(*_SUMMARY_R)} FROM facts"))
def diagnostic_summary(spark, sf):
    ranked = ranking.rank_chunks(plain_scored(spark, sf))
    return shown(diagnostics.diagnostic_summary(ranked), *_SUMMARY.split(", "), *_SUMMARY_R)


_COVERAGE = f"query_id, doc_id, total_chunks, {_COUNTS}, coverage_label, coverage_rounded, is_single_chunk"


@register(O.on("plain", f"SELECT {_COVERAGE}, {r('coverage_score', 'weighted_sum')} FROM facts"))
def coverage_score(spark, sf):
    return shown(diagnostics.coverage(plain_scored(spark, sf)), *_COVERAGE.split(", "), "coverage_score", "weighted_sum")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')} FROM diag ORDER BY query_id, doc_id, chunk_index"))
def sorted_by_document(spark, sf):
    return shown(diagnostics.sorted_view(plain_scored(spark, sf), "document_order"), *K, "similarity")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')}, similarity_rank AS place FROM diag"))
def sorted_by_similarity_desc(spark, sf):
    ranked = ranking.rank_chunks(plain_scored(spark, sf), out="place")
    return shown(diagnostics.sorted_view(ranked, "similarity_desc"), *K, "similarity", "place")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')}, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity, chunk_index) AS place FROM diag"))
def sorted_by_similarity_asc(spark, sf):
    ranked = ranking.rank_chunks(plain_scored(spark, sf), descending=False, out="place")
    return shown(diagnostics.sorted_view(ranked, "similarity_asc"), *K, "similarity", "place")


def _view(name: str, where: str, pick: Callable[[DataFrame], DataFrame], corpus: str = "plain") -> None:
    source = plain_scored if corpus == "plain" else mixed_scored

    def run(spark, sf):
        return shown(pick(source(spark, sf)), *K, "similarity", "interpretation")

    register(O.on(corpus, f"SELECT {KEY}, {r('similarity')}, interpretation FROM diag WHERE {where}"), name)(run)


_view("diag_above", "similarity >= 0.7", lambda d: diagnostics.above(d, 0.7))
_view("diag_below", "similarity < 0.5", lambda d: diagnostics.below(d, 0.5))
_view("diag_in_range", "similarity BETWEEN 0.5 AND 0.75", lambda d: diagnostics.in_range(d, 0.5, 0.75))
_view("strong_chunks", "similarity >= strong", diagnostics.strong_chunks)
_view("weak_or_off_topic_chunks", "similarity < moderate", diagnostics.weak_or_off_topic_chunks)
_view("off_topic_chunks", "similarity < weak", diagnostics.off_topic_chunks)
_view(
    "filter_by_predicate", "token_count > 100 AND similarity >= weak",
    lambda d: diagnostics.filter_by(d, (F.col("token_count") > 100) & (F.col("similarity") >= F.col("bands.weak"))),
)
_view(
    "filter_by_function", "token_count > 100 AND chunk_index % 3 <> 1 AND similarity < 0.7",
    lambda d: diagnostics.filter_by(
        d, lambda rows: (rows.token_count > 100) & (rows.chunk_index % 3 != 1) & (rows.similarity < 0.7), ("token_count", "chunk_index", "similarity")
    ),
)
_view("get_chunk", "chunk_index = 2", lambda d: diagnostics.get_chunk(d, 2))
_view("chunks_at_level", "level = 'macro'", lambda d: diagnostics.chunks_at_level(d, "macro"), "mixed")


def _extremum(name: str, rank: str, pick: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark, sf):
        return shown(pick(plain_scored(spark, sf)), *K, "similarity")

    sql = f"SELECT {KEY}, {r('similarity')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {rank}, chunk_index) AS k FROM diag) WHERE k = 1"
    register(O.on("plain", sql), name)(run)


_extremum("max_chunk", "similarity DESC", diagnostics.max_chunk)
_extremum("min_chunk", "similarity", diagnostics.min_chunk)


def _best(order: str) -> str:
    return O.on("plain", f"SELECT {KEY}, {r('similarity')}, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {order}, chunk_index) AS place FROM diag) WHERE place <= 3")


@register(_best("similarity DESC"))
def top_n(spark, sf):
    return shown(ranking.top_n(plain_scored(spark, sf), 3), *K, "similarity", "place")


@register(_best("similarity"))
def bottom_n(spark, sf):
    return shown(diagnostics.bottom_n(plain_scored(spark, sf), 3), *K, "similarity", "place")


@register(O.on("mixed", "SELECT query_id, doc_id, is_hierarchical FROM facts"))
def is_hierarchical(spark, sf):
    return diagnostics.hierarchical_reports(mixed_scored(spark, sf))


@register(O.on("plain", f"SELECT query_id, doc_id, chunk_index AS index, round(normalized_score, 6) AS score, round(similarity, 6) AS raw_score, interpretation FROM diag"))
def heatmap_data(spark, sf):
    return shown(diagnostics.heatmap(diagnostics.diagnose(plain_scored(spark, sf))))


@register(O.on("plain", """SELECT query_id, doc_id, 0 AS segment,
string_agg(round(similarity * 1000000)::BIGINT::VARCHAR, ',' ORDER BY chunk_index) AS similarities,
string_agg(round(normalized_score * 1000000)::BIGINT::VARCHAR, ',' ORDER BY chunk_index) AS normalized_scores FROM diag GROUP BY ALL"""))
def similarity_sequence(spark, sf):
    rows = diagnostics.sequences(diagnostics.diagnose(plain_scored(spark, sf)))
    return rows.withColumns({c: micro(F.col(c)) for c in ("similarities", "normalized_scores")})


@register(O.on("plain", f"""SELECT query_id, doc_id, chunk_index // 4 AS segment,
string_agg(round(similarity * 1000000)::BIGINT::VARCHAR, ',' ORDER BY chunk_index) AS similarities FROM diag GROUP BY ALL"""))
def similarity_segments(spark, sf):
    rows = diagnostics.sequences(diagnostics.diagnose(plain_scored(spark, sf)), segment_rows=4)
    return rows.select("query_id", "doc_id", "segment", micro(F.col("similarities")).alias("similarities"))


@register(_VECTOR_SCORED + """
SELECT query_id, doc_id, chunk_index // 64 AS segment,
string_agg(round(similarity * 1000000)::BIGINT::VARCHAR, ',' ORDER BY chunk_index) AS similarities FROM vec_scored GROUP BY ALL""")
def vector_sequence(spark, sf):
    """Sequences of reports of unknown size."""
    ranked = ranking.rank_chunks(materialize(vector_scored(spark, sf)), pre_chunked=True)
    rows = diagnostics.sequences(ranked.withColumn("normalized_score", diagnostics.normalized_score()), segment_rows=64)
    return rows.select("query_id", "doc_id", "segment", micro(F.col("similarities")).alias("similarities"))


@register(_VECTOR_SCORED + f"""
SELECT query_id, doc_id, count(*) AS total_chunks, {r('max_similarity', 'min_similarity', 'avg_similarity', 'median_similarity', 'std_similarity')} FROM (
  SELECT query_id, doc_id, count(*) AS n, max(similarity) AS max_similarity, min(similarity) AS min_similarity, avg(similarity) AS avg_similarity,
    median(similarity) AS median_similarity, coalesce(stddev_samp(similarity), 0.0) AS std_similarity FROM vec_scored GROUP BY ALL) GROUP BY ALL""".replace("count(*) AS total_chunks", "max(n) AS total_chunks", 1))
def vector_summary(spark, sf):
    """Summaries, with the exact median, of reports of unknown size."""
    ranked = ranking.rank_chunks(materialize(vector_scored(spark, sf)), pre_chunked=True)
    sized = ranked.withColumns({"token_count": F.lit(1), "document_char_count": F.lit(1)})
    return shown(
        diagnostics.diagnostic_summary(sized), "query_id", "doc_id", "total_chunks", "max_similarity", "min_similarity", "avg_similarity",
        "median_similarity", "std_similarity",
    )


@register(O.on("plain", f"""SELECT {KEY}, greatest(8, round_even(similarity * 64, 0)::INT) AS bar_height,
round_even(similarity, 2) AS shown_similarity, interpretation, {O.collapse('text_preview')} AS preview FROM diag WHERE chunk_count >= 2"""))
def drift_rows(spark, sf):
    return diagnostics.drift_rows(plain_scored(spark, sf))


_CARD = f"query_id, doc_id, coverage_rounded, coverage_label, {_COUNTS}, is_single_chunk"


@register(O.on("mixed", f"""SELECT {_CARD}, strong <> 0.8 AS is_short_topic, {r('coverage_score')},
round(CASE WHEN potential_ccs - coverage_score > 0 THEN potential_ccs END, 6) AS potential_ccs,
round(CASE WHEN potential_ccs - coverage_score > 0 THEN potential_ccs - coverage_score END, 6) AS potential_gain FROM facts"""))
def score_card(spark, sf):
    card = advice_analysis(spark, sf).score_card
    return shown(card, *_CARD.split(", "), "is_short_topic", "coverage_score", "potential_ccs", "potential_gain")


# --- sections ----------------------------------------------------------------------------

_SUM = "query_id, doc_id, section_index, heading, level, chunk_count, total_words"
_SUM_R = ("avg_similarity", "max_similarity", "min_similarity", "coverage_score")


@register(O.on("mixed", f"SELECT {_SUM}, {r(*_SUM_R)} FROM secs"))
def section_summary(spark, sf):
    return shown(sections.section_summaries(mixed_scored(spark, sf)), *_SUM.split(", "), *_SUM_R)


@register(O.on("mixed", "SELECT query_id, doc_id, section_index, chunk_index FROM sec_members"))
def section_members(spark, sf):
    return sections.section_members(mixed_scored(spark, sf)).select("query_id", "doc_id", "section_index", "chunk_index")


@register(O.on("mixed", f"""SELECT {KEY}, coalesce(parent_index, CASE WHEN level IN ('macro', 'micro') THEN chunk_index END) AS section_key,
parent_index IS NULL AND level IN ('macro', 'micro') AS leads_section FROM diag"""))
def chunks_by_section(spark, sf):
    return sections.chunks_by_section(mixed_scored(spark, sf)).select(*K, "section_key", "leads_section")


@register(O.on("mixed", f"""SELECT query_id, doc_id, chunk_index AS index, round(normalized_score, 6) AS score, round(similarity, 6) AS raw_score,
interpretation, level, heading, depth, parent_index, word_count, coalesce(children, '') AS children FROM diag
LEFT JOIN (SELECT doc_id, parent_index AS chunk_index, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS children
  FROM chunks WHERE parent_index IS NOT NULL GROUP BY ALL) USING (doc_id, chunk_index)"""))
def hierarchy_heatmap(spark, sf):
    rows = sections.hierarchy_heatmap(diagnostics.diagnose(materialize(mixed_scored(spark, sf))))
    return shown(rows.withColumn("children", joined(F.col("children"))))


# --- signals -------------------------------------------------------------------------------


@register(O.on("mixed", "SELECT doc_id, line_no, line FROM code_free"))
def non_code_lines(spark, sf):
    return signals.non_code_lines(W.mixed_documents(spark, sf))


_SIG = ", ".join(c for c in signals.SIGNAL_COLUMNS if c not in ("numeric_density", "intro_query_term_coverage"))


@register(O.on("mixed", f"SELECT query_id, doc_id, {_SIG}, intent, {r('numeric_density', 'intro_query_term_coverage')} FROM signals"))
def content_signals(spark, sf):
    rows = signals.content_signals(W.mixed_documents(spark, sf), signals.with_query_facts(W.topics(spark)))
    return shown(rows, "query_id", "doc_id", *signals.SIGNAL_COLUMNS, "intent")


@register(f"WITH qs AS (SELECT conv_id * {W.TURNS} + turn AS query_id, text AS query FROM conversations),"
          + ", ".join(O.terms("qs"))
          + " SELECT query_id, coalesce(string_agg(term, ',' ORDER BY k), '') AS terms FROM qs LEFT JOIN term_rows USING (query_id) GROUP BY 1")
def query_terms(spark, sf):
    return W.turn_queries(spark, sf).select("query_id", joined(signals.query_terms(F.col("query"))).alias("terms"))


@register(f"""SELECT conv_id * {W.TURNS} + turn AS query_id, {O.intent('text')} AS intent FROM conversations
UNION ALL SELECT -query_id, coalesce(nullif(intent_override, 'auto'), {O.intent('query')}) FROM ({O.TOPICS_SQL})""")
def infer_intent(spark, sf):
    """Of every turn as a query, and of the topics (as negative ids) with their overrides."""
    topics = W.topics(spark).withColumn("query_id", -F.col("query_id"))
    return signals.with_query_facts(W.turn_queries(spark, sf).unionByName(topics)).select("query_id", "intent")


# --- recommendations --------------------------------------------------------------------------

_TARGET = "query_id, doc_id, rec_type, chunk_index, text_preview, interpretation"


def _rule(kind: str) -> None:
    def run(spark, sf):
        a = advice_analysis(spark, sf)
        heads = recommendations.recommendations(a.kept_facts).filter(F.col("rec_type") == kind).select("query_id", "doc_id", "rec_type", "priority", "target_count")
        rows = a.recommendation_targets.filter(F.col("rec_type") == kind)
        return shown(rows.join(heads, ["query_id", "doc_id", "rec_type"]), *_TARGET.split(", "), "priority", "target_count", "similarity")

    sql = f"""SELECT {_TARGET}, priority, target_count, {r('similarity')} FROM rec_targets
JOIN recs USING (query_id, doc_id, rec_type) WHERE rec_type = '{kind}'"""
    register(O.on("mixed", sql), f"rec_{kind}")(run)


for _kind in recommendations.TYPES:
    _rule(_kind)

_REC = "query_id, doc_id, position, rec_type, priority, estimated_impact, target_count, example_text"


@register(O.on("mixed", f"SELECT {_REC} FROM recs"), "recommendations")
def recommendation_rows(spark, sf):
    return advice_analysis(spark, sf).recommendations.select(*_REC.split(", "))


@register(O.on("mixed", f"SELECT query_id, doc_id, {r('coverage_score', 'potential_ccs')} FROM facts"))
def potential_ccs(spark, sf):
    rows = advice_analysis(spark, sf).recommendation_report
    return shown(rows.withColumnRenamed("current_ccs", "coverage_score"), "query_id", "doc_id", "coverage_score", "potential_ccs")


_NOTHING = O.label("coverage_score", recommendations.guidance.NOTHING_TO_DO, recommendations.guidance.LITTLE_TO_SAY)


@register(O.on("mixed", f"""SELECT query_id, doc_id, round(coverage_score, 6) AS current_ccs, {r('potential_ccs')},
recommendation_count, high_priority_count, recommendation_count > 0 AS has_recommendations,
CASE WHEN recommendation_count = 0 THEN {_NOTHING} ELSE recommendation_count || ' recommendation(s)' || coalesce(': ' || nullif(concat_ws(', ',
  CASE WHEN high_priority_count > 0 THEN high_priority_count || ' of high priority' END,
  CASE WHEN potential_ccs - coverage_score > 5 THEN 'up to +' || round_even(potential_ccs - coverage_score, 0)::INT || ' points' END,
  CASE WHEN chunks_off_topic > 0 THEN chunks_off_topic || ' off-topic chunk(s)' END), ''), '') END AS summary
FROM (SELECT f.*, coalesce(n, 0) AS recommendation_count, coalesce(h, 0) AS high_priority_count FROM facts f LEFT JOIN (
  SELECT query_id, doc_id, count(*) AS n, count(*) FILTER (priority = 'high') AS h FROM recs GROUP BY ALL) USING (query_id, doc_id))"""))
def recommendation_report(spark, sf):
    return shown(advice_analysis(spark, sf).recommendation_report)


@register(O.on("mixed", f"SELECT {_REC} FROM recs WHERE priority = 'high'"))
def recs_by_priority(spark, sf):
    rows = advice_analysis(spark, sf).recommendations
    return recommendations.by_priority(rows, "high").select(*_REC.split(", "))


# --- next steps and readiness ---------------------------------------------------------------------


@register(O.on("mixed", f"SELECT query_id, doc_id, intro_chunks, best_chunk_index, {r('intro_similarity', 'best_position')} FROM facts"))
def intro_band(spark, sf):
    facts = diagnostics.report_numbers(mixed_scored(spark, sf))
    return shown(nextsteps.intro_band(facts), "query_id", "doc_id", "intro_chunks", "best_chunk_index", "intro_similarity", "best_position")


@register(O.on("mixed", "SELECT query_id, doc_id, step, ['high', 'medium', 'low'][ord] AS priority, minutes, target_count FROM step_rows"))
def geo_steps(spark, sf):
    """Every step that applies, before the report keeps the first seven."""
    rows = mixed_analysis(spark, sf).steps(max_steps=11)
    return rows.select("query_id", "doc_id", "step", "priority", "minutes", "target_count")


_STEP = "query_id, doc_id, position, step, priority, minutes, target_count"


@register(O.on("mixed", f"SELECT {_STEP} FROM steps"))
def geo_next_steps(spark, sf):
    return mixed_analysis(spark, sf).next_steps.select(*_STEP.split(", "))


@register(O.on("mixed", f"""
SELECT query_id, doc_id, step, chunk_index, target_preview AS text_preview, round(similarity, 6) AS similarity, d.interpretation FROM (
  SELECT *, 'front_load' AS step, chunk_index < 3 AS listed FROM diag
  UNION ALL SELECT *, 'reduce_drift', similarity < weak AND row_number() OVER (PARTITION BY query_id, doc_id, similarity < weak ORDER BY chunk_index) <= 5 FROM diag
  UNION ALL SELECT *, 'strengthen_weak', similarity >= weak AND similarity < moderate AND row_number() OVER (
    PARTITION BY query_id, doc_id, similarity >= weak AND similarity < moderate ORDER BY chunk_index) <= 5 FROM diag) d
JOIN steps USING (query_id, doc_id, step) WHERE listed"""))
def geo_step_targets(spark, sf):
    return shown(mixed_analysis(spark, sf).step_targets)


@register(O.on("mixed", f"""SELECT query_id, doc_id, intent,
{O.label('coverage_score', O.guidance.HEADLINES, O.guidance.LOWEST_HEADLINE)} AS summary FROM reports"""))
def geo_report(spark, sf):
    return mixed_analysis(spark, sf).step_report


@register(O.on("mixed", f"SELECT {_STEP} FROM steps WHERE priority = 'medium'"))
def geo_by_priority(spark, sf):
    return recommendations.by_priority(mixed_analysis(spark, sf).next_steps, "medium").select(*_STEP.split(", "))


_PARTS = ("coverage", "structure", "evidence", "answerability")
_PARTS_SQL = ", ".join(f"round({c[0]} * 100.0, 6) AS {c}" for c in _PARTS)


@register(O.on("mixed", f"SELECT query_id, doc_id, {_PARTS_SQL} FROM ready"))
def readiness_components(spark, sf):
    return shown(readiness.readiness_components(mixed_analysis(spark, sf).reports), "query_id", "doc_id", *_PARTS)


@register(O.on("mixed", f"""SELECT query_id, doc_id, {_PARTS_SQL}, {r('score')}, round_even(score, 0)::INT AS score_rounded,
{O.label('score', S.READINESS_LABELS, S.READINESS_FLOOR_LABEL)} AS interpretation FROM ready"""))
def readiness_score(spark, sf):
    return shown(mixed_analysis(spark, sf).readiness)


@register(O.on("mixed", """SELECT query_id, doc_id, source, item, priority,
row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source, item_no) AS number FROM (
  SELECT query_id, doc_id, 'next_step' AS source, step AS item, priority, position AS item_no FROM steps
  UNION ALL SELECT query_id, doc_id, 'recommendation', rec_type, priority, position FROM recs)"""))
def action_plan(spark, sf):
    return mixed_analysis(spark, sf).action_plan.select("query_id", "doc_id", "source", "item", "priority", "number")


# --- wording, rejects, pairs --------------------------------------------------------------------------


def _recommendation_texts(part: int) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {O.filled(texts[part])}" for name, texts in guidance.RECOMMENDATIONS.items())
    return f"CASE rec_type {cases} END"


@register(O.on("mixed", f"""SELECT query_id, doc_id, position, rec_type, {_recommendation_texts(0)} AS what, {_recommendation_texts(1)} AS why,
{_recommendation_texts(2)} AS how FROM recs JOIN facts f USING (query_id, doc_id) LEFT JOIN (
  SELECT query_id, doc_id, arg_min(heading, section_index) AS low_heading, arg_min(coverage_score, section_index) AS low_score FROM secs
  WHERE coverage_score < {S.LOW_SECTION_COVERAGE} GROUP BY ALL) USING (query_id, doc_id)"""))
def recommendations_worded(spark, sf):
    rows = advice_analysis(spark, sf).recommendations
    return rows.select("query_id", "doc_id", "position", "rec_type", "what", "why", "how")


def _step_texts(part: str) -> str:
    def one(step) -> str:
        value = getattr(step, part)
        return O.lit(value) if part in ("title", "example") else O.filled(value)

    return "CASE step " + " ".join(f"WHEN '{name}' THEN {one(step)}" for name, step in guidance.NEXT_STEPS.items()) + " END"


@register(O.on("mixed", f"""SELECT query_id, doc_id, position, step, {', '.join(f'{_step_texts(p)} AS {p}' for p in ('title', 'why', 'how', 'example'))}
FROM steps JOIN reports USING (query_id, doc_id)"""))
def geo_steps_worded(spark, sf):
    rows = mixed_analysis(spark, sf).next_steps
    return rows.select("query_id", "doc_id", "position", "step", "title", "why", "how", "example")


_FAULTS = f"""
WITH d AS (SELECT doc_id, doc_id % 11 AS kind, CASE WHEN doc_id % 11 = 3 THEN 'elsewhere' ELSE lang END AS scope FROM documents),
q AS (SELECT * FROM ({O.TOPICS_SQL}) WHERE query_id < 10),
a AS (SELECT * FROM q UNION ALL SELECT 10, ' ', 'en', NULL UNION ALL SELECT 11, NULL, 'de', NULL UNION ALL SELECT 12, 'nobody there', 'nowhere', NULL),
bad AS (SELECT doc_id, CASE kind WHEN 0 THEN 'document is null' WHEN 1 THEN 'document is blank' WHEN 2 THEN 'no chunks'
  WHEN 3 THEN 'no query asks for it' WHEN 4 THEN 'unknown strategy' END AS reason FROM d WHERE kind < 5)"""


def _faulty_analysis(spark, sf) -> Analysis:
    return analyze(*W.faulty_inputs(spark, sf), W.EMBEDDER, F.col("strategy"))


@register(_FAULTS + """
SELECT NULL::BIGINT AS query_id, doc_id, NULL::INT AS chunk_index, reason FROM bad
UNION ALL SELECT 10, NULL, NULL, 'query is blank' UNION ALL SELECT 11, NULL, NULL, 'query is null' UNION ALL SELECT 12, NULL, NULL, 'no document to ask'""")
def analysis_rejects(spark, sf):
    return _faulty_analysis(spark, sf).rejects


@register(_FAULTS + f"""
SELECT a.query_id, d.doc_id, bad.reason, 0 AS total_chunks, 0.0::DOUBLE AS coverage_score, 'Low' AS coverage_label, {O.lit(guidance.EMPTY_REPORT)} AS summary
FROM d JOIN a USING (scope) JOIN bad USING (doc_id) WHERE trim(a.query) <> '' AND kind <> 3""")
def empty_reports(spark, sf):
    rows = _faulty_analysis(spark, sf).empty_reports
    return rows.select("query_id", "doc_id", "reason", "total_chunks", "coverage_score", "coverage_label", "summary")


@register(_TURNS + "," + _PAIRS + f"""
SELECT query_id, doc_id, count(*) AS total_chunks, round(max(similarity), 6) AS max_similarity, round(avg(similarity), 6) AS avg_similarity
FROM pair_scored GROUP BY ALL""")
def analyze_pairs(spark, sf):
    """The whole analysis over requested pairs; its reports carry the signals, too."""
    documents, turns, pairs = _turn_pairs(spark, sf)
    reports = analyze(documents, turns, W.EMBEDDER, pairs=pairs).reports
    return shown(reports.filter(F.col("word_count") >= 0), "query_id", "doc_id", "total_chunks", "max_similarity", "avg_similarity")


_OWN_BANDS = {"strong": 0.7, "moderate": 0.55, "weak": 0.3}


@register(O.on("plain", f"""SELECT query_id, doc_id, count(*) FILTER (similarity >= 0.7) AS chunks_strong,
count(*) FILTER (similarity < 0.3) AS chunks_off_topic, false AS is_short_topic FROM scored GROUP BY ALL"""))
def score_card_custom_bands(spark, sf):
    """Own bands are no sign of a short topic."""
    card = analyze(W.documents(spark, sf), W.topics(spark), W.EMBEDDER, bands=_OWN_BANDS).score_card
    return card.select("query_id", "doc_id", "chunks_strong", "chunks_off_topic", "is_short_topic")


_EMPTY_SIGNALS = "word_count, h2_count, link_count, has_faq, has_steps, numeric_density"
_FAULTY_DOCS = """SELECT doc_id, CASE WHEN doc_id % 11 = 2 THEN '<h2></h2><h3> </h3>' ELSE text END AS text, lang AS scope FROM documents WHERE doc_id % 11 IN (2, 4)"""
_EMPTY = "WITH RECURSIVE " + ",\n".join([f"docs AS ({_FAULTY_DOCS})", *O.topic_rows(10), *O.signal_steps()]) + """,
unanswered AS (SELECT i.query_id, i.intent, d.doc_id FROM documents d JOIN intents i ON i.scope = d.lang WHERE d.doc_id % 11 IN (0, 1, 2, 4)),
empty AS (SELECT u.query_id, u.doc_id, u.intent, coalesce(word_count, 0) AS word_count, coalesce(h2_count, 0) AS h2_count, coalesce(h3_count, 0) AS h3_count,
  coalesce(link_count, 0) AS link_count, coalesce(has_faq, false) AS has_faq, coalesce(has_tldr, false) AS has_tldr, coalesce(has_steps, false) AS has_steps,
  coalesce(has_sources_section, false) AS has_sources_section, coalesce(has_examples, false) AS has_examples, coalesce(numeric_density, 0.0) AS numeric_density,
  coalesce(has_definition_near_top, false) AS has_definition_near_top, coalesce(intro_query_term_coverage, 0.0) AS intro_query_term_coverage,
  0.0::DOUBLE AS coverage_score, 1.0::DOUBLE AS best_position
  FROM unanswered u LEFT JOIN signals s ON s.query_id = u.query_id AND s.doc_id = u.doc_id)"""


@register(f"{_EMPTY}\nSELECT query_id, doc_id, intent, {_EMPTY_SIGNALS.replace('numeric_density', r('numeric_density'))} FROM empty")
def empty_step_reports(spark, sf):
    """Intent and signals of documents without chunks: null, blank, of bare headings, of an unknown strategy."""
    return shown(_faulty_analysis(spark, sf).empty_reports, "query_id", "doc_id", "intent", *_EMPTY_SIGNALS.split(", "))


@register(f"{_EMPTY}, {O.readiness_steps('empty')}\nSELECT query_id, doc_id, {_PARTS_SQL}, {r('score')} FROM ready")
def empty_readiness(spark, sf):
    return shown(_faulty_analysis(spark, sf).empty_readiness, "query_id", "doc_id", *_PARTS, "score")


_HOT_CHUNKS = (
    _VECTOR_SCORED.replace("label::BIGINT AS doc_id", f"(CASE WHEN label < {W.HOT_LABELS} THEN 0 ELSE label END)::BIGINT AS doc_id")
    .replace("PARTITION BY label", f"PARTITION BY CASE WHEN label < {W.HOT_LABELS} THEN 0 ELSE label END")
    .replace("d.label = a.doc_id", f"CASE WHEN d.label < {W.HOT_LABELS} THEN 0 ELSE d.label END = a.doc_id")
)


@register(_HOT_CHUNKS + f""",
placed AS (SELECT *, CASE WHEN chunk_count > 1 THEN chunk_index::DOUBLE / (chunk_count - 1) ELSE 0.0 END <= 0.2 AS opening FROM vec_scored),
sums AS (SELECT query_id, doc_id, count(*) AS total_chunks, max(similarity) AS max_similarity, avg(similarity) AS avg_similarity,
  arg_max(chunk_index, (similarity, -chunk_index)) AS best_chunk_index, count(*) FILTER (similarity >= strong) AS chunks_strong,
  count(*) FILTER (similarity < weak) AS chunks_off_topic, count(*) FILTER (opening) AS band_n, avg(similarity) FILTER (opening) AS band_avg,
  count(*) FILTER (chunk_index < 3) AS head_n, avg(similarity) FILTER (chunk_index < 3) AS head_avg FROM placed GROUP BY ALL)
SELECT query_id, doc_id, total_chunks, {r('max_similarity')}, {r('avg_similarity')}, best_chunk_index, chunks_strong, chunks_off_topic,
  CASE WHEN band_n >= 2 THEN band_n ELSE head_n END AS intro_chunks, round(CASE WHEN band_n >= 2 THEN band_avg ELSE head_avg END, 6) AS intro_similarity FROM sums""")
def analyze_hot_chunks(spark, sf):
    """Reports of a given chunk table with a hot document."""
    a = analyze_chunks(W.hot_vector_chunks(spark, sf), W.centroid_queries(spark, sf), W.vectors(spark, sf))
    return shown(
        a.numbers, "query_id", "doc_id", "total_chunks", "max_similarity", "avg_similarity", "best_chunk_index", "chunks_strong", "chunks_off_topic",
        "intro_chunks", "intro_similarity",
    )


@register(_VECTOR_SCORED + f"\nSELECT {KEY}, {r('similarity')}, interpretation FROM vec_scored")
def query_chunk_similarity_blocked(spark, sf):
    """The given vectors against mean vectors, as matrix products."""
    chunks = W.vectors(spark, sf).embed(W.vector_chunks(spark, sf))
    return shown(dense.score_blocked(chunks, W.centroid_queries(spark, sf)), *K, "similarity", "interpretation")


@register(O.on("plain", f"SELECT {KEY}, {r('similarity')}, interpretation FROM scored WHERE similarity >= 0.6"))
def threshold_join(spark, sf):
    """The chunks of :func:`result_above`, found by their rare coordinates."""
    return shown(chunks_above(W.documents(spark, sf), W.topics(spark), W.EMBEDDER, 0.6), *K, "similarity", "interpretation")
