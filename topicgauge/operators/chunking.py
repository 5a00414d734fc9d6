"""Documents to chunk rows.

One document is one row. All cutting happens in array expressions on that row, and one
explode at the end yields chunk rows, so chunking is a narrow stage: no shuffle, no join,
and no group that could become hot.

Input: ``doc_id``, ``text`` and any further columns, which are carried along.
Output: those columns without ``text``'s original, plus the chunk columns of
:data:`topicgauge.schemas.CHUNK_FIELDS` and ``chunk_count`` (chunks of that document).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import arrays as A
from topicgauge.functions import text as X
from topicgauge.settings import ChunkOptions

_HTML_HEADING = r"(?is)<(h[23])[^>]*>(.*?)</\1>"
_MD_HEADING = rf"#{{2,3}}[{X.WS_NO_LF}][^\n]"


def detect_format(text: Column) -> Column:
    """``markdown`` before ``html`` before ``flat``. Looser than the section parsers by design."""
    markdown = F.regexp_like(text, F.lit(rf"(?dmU)^#{{2,3}}{X.SPACE}+[^\n]"))
    html = F.regexp_like(text, F.lit(r"(?is)<h[23][^>]*>.*?</h[23]>"))
    return F.when(text.contains("##") & markdown, "markdown").when(_closes_heading(text) & html, "html").otherwise("flat")


def _closes_heading(text: Column) -> Column:
    """Without a closing tag no heading matches; this spares the search from every opening tag to the end."""
    return reduce(or_, [text.contains(tag) for tag in ("</h2>", "</h3>", "</H2>", "</H3>")])


def effective_strategy(strategy: Column, text: Column) -> Column:
    return F.when(strategy == "auto", detect_format(text)).otherwise(strategy)


# --- flat ---------------------------------------------------------------------


def _with_flat(df: DataFrame, guard: Column, opts: ChunkOptions) -> DataFrame:
    """Add ``_flat``: the flat chunk structs of rows where ``guard`` holds, else null."""
    df = (
        df.withColumn("_body", F.when(guard & ~X.is_blank(F.col("text")), X.strip(F.col("text"))))
        .withColumn("_sent", X.sentences(F.col("_body")))
        .withColumn("_tok", F.transform("_sent", X.token_estimate))
        .withColumn("_firsts", A.pack(F.col("_tok"), opts.target_tokens))
        .withColumn(
            "_texts",
            F.transform(
                "_firsts",
                lambda s, k: F.array_join(A.group_slice(F.col("_sent"), F.col("_firsts"), s, k), " "),
            ),
        )
    )
    if opts.with_offsets:
        df = (
            df.withColumn("_blocks", A.text_blocks(F.col("_body")))
            .withColumn("_gaps", A.block_gaps(F.reverse("_blocks")))
            .withColumn("_starts", A.running_starts(F.col("_texts"), F.col("_blocks"), F.col("_gaps")))
        )

    def offsets(t: Column, k: Column) -> list[Column]:
        if not opts.with_offsets:
            return []
        begin = F.get("_starts", k)
        end = F.least(begin + F.length(t), A.blocks_length(F.col("_blocks")))
        return [begin.alias("char_start"), end.alias("char_end")]

    def chunk(t: Column, k: Column) -> Column:
        tokens = F.aggregate(
            A.group_slice(F.col("_tok"), F.col("_firsts"), F.get("_firsts", k), k), F.lit(0), lambda a, b: a + b
        )
        return F.struct(
            t.alias("text"),
            *offsets(t, k),
            tokens.alias("token_count"),
            F.lit("flat").alias("level"),
            F.lit(None).cast("string").alias("heading"),
            F.lit(None).cast("int").alias("parent_index"),
            F.lit(0).alias("depth"),
        )

    return df.withColumn("_flat", F.transform("_texts", chunk))


# --- sections -----------------------------------------------------------------


def _section(level: Column, heading: Column, content: Column, begin: Column, end: Column) -> Column:
    return F.struct(
        level.cast("int").alias("level"),
        heading.alias("heading"),
        content.alias("content"),
        begin.cast("int").alias("char_start"),
        end.cast("int").alias("char_end"),
    )


def _null_string() -> Column:
    return F.lit(None).cast("string")


def _with_markdown(df: DataFrame, guard: Column) -> DataFrame:
    """Add ``_md``: non-empty sections cut at heading lines, for rows where ``guard`` holds."""
    df = (
        df.withColumn("_parts", F.when(guard, F.split("text", rf"(?dm)^(?={_MD_HEADING})", -1)))
        .withColumn("_offs", A.prefix_sums(F.col("_parts"), F.length))
    )

    def section(part: Column, i: Column) -> Column:
        headed = F.regexp_like(part, F.lit(rf"\A{_MD_HEADING}"))
        title = X.strip(F.regexp_replace(F.substring_index(part, "\n", 1), r"\A#{2,3}", ""))
        body = F.regexp_replace(part, r"\A[^\n]*\n?", "")
        last = i + 1 == F.size("_parts")
        end = F.get("_offs", i + 1)
        return _section(
            F.when(~headed, 4).when(part.startswith("###"), 3).otherwise(2),
            F.when(headed, title),
            X.strip(F.when(headed, body).otherwise(part)),
            F.get("_offs", i),
            F.when(last, end + 1).otherwise(end - 1),
        )

    return df.withColumn("_md", F.filter(F.transform("_parts", section), lambda s: s["content"] != ""))


def _html_text(c: Column) -> Column:
    return X.collapse(F.regexp_replace(c, "<[^>]+>", " "))


def _with_html(df: DataFrame, guard: Column) -> DataFrame:
    """Add ``_html``: the text before the first heading, then one section per heading.

    Sections without text stay in the list: a document that has headings never falls back
    to flat chunks, even if all of them are empty.
    """
    closes = _closes_heading(F.col("text"))
    cut = F.when(closes, F.split("text", _HTML_HEADING, -1)).otherwise(F.array("text"))
    found = F.when(closes, F.regexp_extract_all("text", F.lit(_HTML_HEADING), F.lit(0)))
    df = (
        df.withColumn("_between", F.when(guard, cut))
        .withColumn("_heads", F.when(guard, F.coalesce(found, F.array().cast("array<string>"))))
        .withColumn("_ends", A.prefix_sums(F.zip_with("_between", "_heads", lambda b, h: F.length(b) + F.coalesce(F.length(h), F.lit(0)))))
        .withColumn("_texts_html", F.transform("_between", _html_text))
    )
    size = F.length("text")
    before = F.get("_texts_html", F.lit(0))
    plain = F.size("_heads") == 0
    lead_end = F.when(plain, size).otherwise(F.length(F.get("_between", F.lit(0))))
    lead = F.when(
        before != "", F.array(_section(F.lit(4), _null_string(), before, F.lit(0), lead_end))
    ).otherwise(F.array())

    def section(head: Column, i: Column) -> Column:
        begin = F.get("_ends", i + 1) - F.length(head)
        following = F.get("_ends", i + 1) + F.length(F.get("_between", i + 1))
        title = F.regexp_extract(head, _HTML_HEADING, 2)
        return _section(
            F.substring(head, 3, 1),
            X.strip(F.regexp_replace(title, "<[^>]+>", "")),
            F.get("_texts_html", i + 1),
            begin,
            following,
        )

    return df.withColumn("_html", F.concat(lead, F.transform("_heads", section)))


# --- sections to chunks ---------------------------------------------------------


def _with_hierarchy(df: DataFrame, opts: ChunkOptions) -> DataFrame:
    """Add ``_tree``: chunk structs from ``_sections``.

    Only text before the first heading is atomic, so only the first section can be split;
    every later index moves by the pieces it was split into.
    """
    first = F.get("_sections", F.lit(0))
    too_long = (first["level"] == 4) & (X.word_count(first["content"]) > opts.atomic_max_words)
    df = (
        df.withColumn("_sections", F.filter("_sections", lambda s: s["content"] != ""))
        .withColumn(
            "_lead_sent",
            F.when(too_long & F.lit(opts.split_long_paragraphs), X.sentences(first["content"])),
        )
        .withColumn("_lead_firsts", A.pack(F.transform("_lead_sent", X.word_count), opts.atomic_max_words))
        .withColumn("_parents", A.nearest_macro(F.col("_sections.level")))
        .withColumn("_shift", F.when(F.col("_lead_sent").isNull(), 0).otherwise(F.size("_lead_firsts") - 1))
    )

    def chunk(s: Column, body: Column, parent: Column) -> Column:
        level = s["level"]
        name = F.when(level == 2, "macro").when(level == 3, "micro").otherwise("atomic")
        offsets = [s["char_start"], s["char_end"]] if opts.with_offsets else []
        return F.struct(
            body.alias("text"),
            *offsets,
            X.token_estimate(body).alias("token_count"),
            name.alias("level"),
            s["heading"].alias("heading"),
            parent.cast("int").alias("parent_index"),
            (level - 2).alias("depth"),
        )

    lead = F.transform(
        "_lead_firsts",
        lambda p, k: chunk(
            F.get("_sections", F.lit(0)),
            F.array_join(A.group_slice(F.col("_lead_sent"), F.col("_lead_firsts"), p, k), " "),
            F.lit(None),
        ),
    )
    whole = F.transform("_sections", lambda s, i: chunk(s, s["content"], F.get("_parents", i) + F.col("_shift")))
    return df.withColumn("_whole", whole).withColumn(
        "_tree",
        F.when(
            F.col("_lead_sent").isNotNull(),
            F.concat(lead, F.slice("_whole", F.lit(2), F.greatest(F.size("_whole") - 1, F.lit(0)))),
        ).otherwise(F.col("_whole")),
    )


# --- public ---------------------------------------------------------------------


def with_chunks(documents: DataFrame, strategy: str | Column = "flat", options: ChunkOptions | None = None) -> DataFrame:
    """Add ``chunks``, an array of chunk structs, to each document row.

    ``strategy`` is a name for the whole job or a column that names it per row. Null or an
    empty array marks a document without chunks; see :func:`unchunkable`.
    """
    opts = options or ChunkOptions()
    keep = documents.columns
    if isinstance(strategy, str):
        if S.check_strategy(strategy) == "flat":
            out = _with_flat(documents, F.lit(True), opts)
            return out.select(*keep, F.col("_flat").alias("chunks"))
        strategy = F.lit(strategy)
    df = documents.withColumn("_strategy", effective_strategy(strategy, F.col("text")))
    usable = ~X.is_blank(F.col("text"))
    df = _with_markdown(df, usable & (F.col("_strategy") == "markdown"))
    df = _with_html(df, usable & (F.col("_strategy") == "html"))
    df = df.withColumn("_sections", F.coalesce("_md", "_html"))
    # Without any section (only bare headings, or no text between tags) the document is cut flat.
    df = df.withColumn("_as_flat", (F.col("_strategy") == "flat") | (F.size("_sections") == 0))
    df = _with_flat(df, F.col("_as_flat"), opts)
    df = _with_hierarchy(df, opts)
    return df.select(*keep, F.when(F.col("_as_flat"), F.col("_flat")).otherwise(F.col("_tree")).alias("chunks"))


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """Chunk rows from :func:`with_chunks`.

    The outer explode plus a filter on its output keeps the optimizer from testing the size
    of the array below the projection that builds it, which would build it twice. The count
    is taken before the explode, so that no output row carries the whole array, and comes out of a
    generator as well: a filter on it would otherwise cut every document again, in the scan's tasks.
    """
    keep = [c for c in chunked.columns if c not in ("chunks", "text")]
    counted = chunked.select(*keep, "chunks", F.explode(F.array(F.size("chunks"))).alias("chunk_count"))
    rows = counted.select(*keep, "chunk_count", F.posexplode_outer("chunks").alias("chunk_index", "_c"))
    return rows.filter(F.col("chunk_index").isNotNull()).select(*keep, "chunk_index", "chunk_count", "_c.*")


def chunk_documents(
    documents: DataFrame, strategy: str | Column = "flat", options: ChunkOptions | None = None
) -> DataFrame:
    return explode_chunks(with_chunks(documents, strategy, options))


def unchunkable(chunked: DataFrame) -> DataFrame:
    """Documents that gave no chunk, with the reason."""
    reason = F.when(X.is_blank(F.col("text")), "blank document").otherwise("no chunks")
    # filters are not pushed through a generator: below the projections that cut, the count would be built once more
    counted = chunked.select("doc_id", reason.alias("reason"), F.explode(F.array(F.coalesce(F.size("chunks"), F.lit(0)))).alias("_n"))
    return counted.filter("_n <= 0").select("doc_id", "reason")


def unknown_strategies(documents: DataFrame, strategy: str | Column) -> DataFrame:
    """Documents whose row names no known strategy, with the reason."""
    named = F.lit(S.check_strategy(strategy)) if isinstance(strategy, str) else strategy
    unknown = named.isNull() | ~named.isin(*S.STRATEGIES)
    return documents.filter(unknown).select("doc_id", F.lit("unknown strategy").alias("reason"))


def sections(documents: DataFrame, fmt: str) -> DataFrame:
    """Section rows as the parsers see them, before levels become chunks."""
    usable = ~X.is_blank(F.col("text"))
    parsed = _with_markdown(documents, usable) if fmt == "markdown" else _with_html(documents, usable)
    column = "_md" if fmt == "markdown" else "_html"
    rows = parsed.select("doc_id", F.posexplode_outer(column).alias("section_no", "_s"))
    return rows.filter(F.col("section_no").isNotNull()).select("doc_id", "section_no", "_s.*")


def sentence_rows(documents: DataFrame) -> DataFrame:
    """Sentence rows of any text, stripped or not."""
    pieces = F.filter(X.sentences(F.col("text")), lambda s: ~X.is_blank(s))
    rows = documents.select("doc_id", F.posexplode_outer(pieces).alias("sentence_no", "sentence"))
    return rows.filter(F.col("sentence_no").isNotNull())


def token_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.sum("token_count").alias("document_token_count"))


def with_chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(
        {
            "char_count": F.length("text"),
            "word_count": X.word_count(F.col("text")),
            "is_hierarchical": F.col("level") != "flat",
        }
    )
