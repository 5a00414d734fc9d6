"""Content signals: regex facts about the raw text, and about text and query together.

Line rules run as multi-line patterns over the text with unified line ends, so no list of
lines is built. Everything here is one narrow pass per document; queries join on ``scope``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import text as X
from topicgauge.operators.plain_signals import plain_signals

#: ``\b``, ``\d`` and letter case follow Unicode; ``^`` and ``$`` mind ``\n`` only.
_ANY_CASE = "(?Uiu)"
_LINES = "(?dmUiu)"
_I = X.INLINE_WS
#: Letters that equal s, i or k when case is ignored but do not become them in lower case.
_CASE_VARIANTS = ("\u017f", "\u0130", "\u0131", "\u212a")


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _contains(c: Column, *needles: str) -> Column:
    return reduce(or_, [c.contains(n) for n in needles])


def _found_if(needles: Column, c: Column, pattern: str) -> Column:
    """A pattern that can only match where ``needles`` holds: a byte search spares most texts the regex.

    A search stops at every occurrence of its first byte, so needles begin with a rare one of the words they stand for.
    """
    return F.when(needles, _found(c, pattern)).otherwise(False)


def _count_if(needles: Column, c: Column, pattern: str) -> Column:
    return F.when(needles, _count(c, pattern)).otherwise(0)


def query_terms(query: Column) -> Column:
    """Up to eight distinct longer words of a query, in their order."""
    words = F.split(F.lower(query), "[^a-zA-Z0-9]+", -1)
    kept = F.filter(
        words, lambda w: (F.length(w) >= S.TERM_MIN_CHARS) & ~w.isin(*S.TERM_STOP_WORDS)
    )
    return F.slice(F.array_distinct(kept), 1, S.MAX_TERMS)


def infer_intent(query: Column) -> Column:
    q = F.lower(X.strip(F.coalesce(query, F.lit(""))))
    return (
        F.when(_found(q, rf"(?U)\b(?:{S.HOW_TO_WORDS})\b"), "how_to")
        .when(_found(q, rf"(?U)\b(?:{S.COMMERCIAL_WORDS})\b"), "commercial")
        .otherwise("informational")
    )


def resolve_intent(query: Column, override: Column) -> Column:
    return F.when(override.isNull() | (override == "auto"), infer_intent(query)).otherwise(override)


def with_query_facts(queries: DataFrame) -> DataFrame:
    return queries.withColumns(
        {
            "terms": query_terms(F.col("query")),
            "intent": resolve_intent(F.col("query"), F.col("intent_override")),
        }
    )


def non_code_lines(documents: DataFrame) -> DataFrame:
    """Lines outside code fences, numbered among themselves."""
    body = X.without_code_blocks(X.unify_line_ends(F.col("text")))
    rows = documents.select("doc_id", F.posexplode_outer(X.lines(body)).alias("line_no", "line"))
    return rows.filter(F.col("line_no").isNotNull())


def document_signals(documents: DataFrame) -> DataFrame:
    """Signals that need no query, plus the lower-cased openings the query rules look into."""
    return with_document_signals(documents).drop("text")


def with_document_signals(documents: DataFrame) -> DataFrame:
    """:func:`document_signals` beside the text. Texts of plain characters are judged in batches, the others by expressions."""
    judged = documents.withColumn("_plain", plain_signals(F.col("text")))
    found = judged.withColumn("_rest", F.when(F.col("_plain").isNull(), F.col("text"))).withColumns(_openings(F.col("_rest")))
    signals = {name: F.coalesce(F.col("_plain")[name], rule) for name, rule in _rules(F.col("_rest")).items()}
    return found.withColumns(signals).drop("_plain", "_rest", *_openings(F.col("_rest")))


def _openings(text: Column) -> dict[str, Column]:
    """What several rules read: the text outside code, its first words, its lower case."""
    unified = X.unify_line_ends(text)
    return {
        "_body": F.when(text.contains("```"), X.without_code_blocks(unified)).otherwise(unified),
        "_top": X.first_words(text, S.DEFINITION_WORDS),
        "_low": F.lower(text),
        "_odd": _contains(text, *_CASE_VARIANTS),
    }


def _rules(text: Column) -> dict[str, Column]:
    """The signals of a text beside its :func:`_openings`; :mod:`topicgauge.operators.plain_signals` states the same rules."""
    body, low, odd = F.col("_body"), F.col("_low"), F.col("_odd")
    heading = rf"(?:[{_I}]{{0,3}}#+[{_I}]*|[{_I}]*)"
    marks, pipes = body.contains("##"), body.contains("|")
    tags2, tags3 = _contains(low, "<h2"), _contains(low, "<h3")
    return {
        "word_count": X.word_count(text),
        "h2_count": _count_if(marks, body, rf"(?dmU)^[{_I}]*##[{_I}]+{X.NOT_SPACE}")
        + _count_if(tags2, text, _ANY_CASE + r"<h2\b"),
        "h3_count": _count_if(marks, body, rf"(?dmU)^[{_I}]*###[{_I}]+{X.NOT_SPACE}")
        + _count_if(tags3, text, _ANY_CASE + r"<h3\b"),
        "link_count": F.greatest(
            _count_if(body.contains("](http"), body, r"\[[^\]\n]+\]\(https?://[^)\n]+\)"),
            _count_if(text.contains("://"), text, r"(?U)https?://[^\s\x1c-\x1f)]+"),
        ),
        "table_like_lines": _count_if(pipes, body, rf"(?dm)^[{_I}]*\|[^\n]*\|[{_I}]*$"),
        "has_faq": _found_if(odd | _contains(low, "faq", "quently asked questions"), body, _ANY_CASE + S.FAQ_PATTERN),
        "has_tldr": _found(F.substring(text, 1, S.TLDR_CHARS), _ANY_CASE + S.TLDR_PATTERN),
        "has_sources_section": _found_if(
            odd | _contains(low, *S.SOURCES_HEADINGS.split("|")),
            body, rf"{_LINES}^{heading}(?:{S.SOURCES_HEADINGS})[{_I}]*$",
        ),
        "has_steps": _found(body, rf"{_LINES}^[{_I}]*(?:step[{_I}]+\d+|[0-9]+\.)[{_I}]"),
        "has_examples": _found_if(odd | _contains(low, "xample", ".g."), body, _ANY_CASE + S.EXAMPLE_PATTERN),
        "has_comparison_language": _found_if(
            odd | _contains(low, "vs", "versus", "mpar", "lternative"), body, _ANY_CASE + S.COMPARISON_PATTERN
        ),
        "has_freshness_signals": (odd | _contains(low, "updated", "s of", "w in", "201", "202"))
        & _found(F.substring(text, 1, S.FRESHNESS_CHARS), _ANY_CASE + S.FRESHNESS_PATTERN),
        "numeric_density": _count(body, r"(?d)\p{Nd}[^\n]*") / F.greatest(X.line_count(body), F.lit(1)),
        "defines_near_top": _found(F.col("_top"), _ANY_CASE + S.DEFINITION_PATTERN),
        "top_text": F.lower("_top"),
        "intro_text": F.lower(F.array_join(F.slice(F.split("_top", " ", -1), 1, S.INTRO_WORDS), " ")),
    }


def with_query_signals(rows: DataFrame) -> DataFrame:
    """What depends on the query, from a document's opening and the query's ``terms`` in the same row."""
    terms = F.col("terms")
    named = F.size(F.filter(terms, lambda t: F.col("intro_text").contains(t)))
    return rows.withColumns(
        {
            "has_definition_near_top": F.col("defines_near_top")
            & F.exists(terms, lambda t: F.col("top_text").contains(t)),
            "intro_query_term_coverage": F.when(F.size(terms) > 0, named / F.size(terms)).otherwise(F.lit(0.0)),
        }
    ).drop("defines_near_top", "top_text", "intro_text", "terms")


def content_signals(
    documents: DataFrame, queries: DataFrame, on: str = "scope", pairs: DataFrame | None = None
) -> DataFrame:
    """The full signal row per (query, document) of a scope, or per requested pair.

    ``queries`` come from :func:`with_query_facts`.
    """
    signals = document_signals(documents)
    if pairs is not None:
        asked = pairs.select("query_id", "doc_id").join(queries.select("query_id", "terms", "intent"), "query_id")
        return with_query_signals(signals.join(asked, "doc_id")).drop(on)
    return with_query_signals(signals.join(queries.select(on, "query_id", "terms", "intent"), on)).drop(on)


SIGNAL_COLUMNS = (
    "word_count", "h2_count", "h3_count", "link_count", "table_like_lines", "has_faq", "has_tldr",
    "has_sources_section", "has_steps", "has_definition_near_top", "has_examples",
    "has_comparison_language", "has_freshness_signals", "numeric_density", "intro_query_term_coverage",
)
