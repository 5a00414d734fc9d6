"""The rules of :mod:`topicgauge.operators.signals` over Arrow batches, for texts of plain characters.

An expression decodes a text anew for every pattern and tests it character by character; here a text is decoded once, and most
rules end at a byte search. Only texts whose characters are classed alike by both engines are judged: letters, digits,
marks and white space, one lower-case character each, none of which equals an ASCII letter when case is ignored. The rest is left to the
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions import text as X
from topicgauge.operators.embedding import pieces

SCHEMA = (
    "word_count int, h2_count int, h3_count int, link_count int, table_like_lines int, has_faq boolean, has_tldr boolean, "
    "has_sources_section boolean, has_steps boolean, has_examples boolean, has_comparison_language boolean, "
    "has_freshness_signals boolean, numeric_density double, defines_near_top boolean, top_text string, intro_text string"
)
_TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
_FIELDS = [(name, _TYPES[kind]) for name, kind in (field.split() for field in SCHEMA.split(", "))]

#: Latin letters, punctuation and the line ends; without digits that are no decimals, long s and dotted or dotless i.
_NOT_PLAIN = re.compile(r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u017e\u0180-\u024f\u2010-\u2029\u20ac]")

_I = X.INLINE_WS
_ENDS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
_LINE_END = re.compile(X.LINE_END)
_FENCE = re.compile(rf"^[{_I}]*```[^\n]*(?:\n|\Z)", re.M)
_H2, _H3 = (re.compile(rf"^[{_I}]*{marks}[{_I}]+\S", re.M) for marks in ("##", "###"))
_TAG2, _TAG3 = re.compile(r"<h2\b"), re.compile(r"<h3\b")
_LINK, _URL = re.compile(r"\[[^\]\n]+\]\(https?://[^)\n]+\)"), re.compile(r"https?://[^\s)]+")
_TABLE = re.compile(rf"^[{_I}]*\|[^\n]*\|[{_I}]*$", re.M)
_SOURCES = re.compile(rf"^(?:[{_I}]{{0,3}}#+[{_I}]*|[{_I}]*)(?:{S.SOURCES_HEADINGS})[{_I}]*$", re.M)
_STEP = re.compile(rf"^[{_I}]*(?:step[{_I}]+\d+|[0-9]+\.)[{_I}]", re.M)
_NUMBERED = re.compile(r"[0-9][^\n]*")
# searched in lower-case texts
_FAQ, _TLDR, _EXAMPLE, _COMPARISON, _FRESHNESS, _DEFINITION = (
    re.compile(pattern.lower())
    for pattern in (S.FAQ_PATTERN, S.TLDR_PATTERN, S.EXAMPLE_PATTERN, S.COMPARISON_PATTERN, S.FRESHNESS_PATTERN, S.DEFINITION_PATTERN)
)
_HEADINGS = S.SOURCES_HEADINGS.split("|")


def _any(text: str, *needles: str) -> bool:
    for needle in needles:
        if needle in text:
            return True
    return False


def _found(pattern: re.Pattern[str], text: str) -> bool:
    return pattern.search(text) is not None


def is_plain(text: str) -> bool:
    return text.isascii() or _NOT_PLAIN.search(text) is None


def signals_of(text: str) -> tuple:
    """The signals of a plain text, in the order of :data:`SCHEMA`."""
    low = text.lower()
    body = _LINE_END.sub("\n", text) if _any(text, *_ENDS) else text
    if "```" in text:
        body = "".join(_FENCE.split(body)[::2])
    low_body = low if body is text else body.lower()
    marks = "##" in body
    top = " ".join(text.split(None, S.DEFINITION_WORDS)[: S.DEFINITION_WORDS]).lower()
    intro = top.split(" ", S.INTRO_WORDS)
    opening, head = low[: S.TLDR_CHARS], low[: S.FRESHNESS_CHARS]
    lines = body.count("\n") + (body != "" and not body.endswith("\n"))
    digits = _any(body, *"0123456789")
    numbered = len(_NUMBERED.findall(body)) if digits else 0
    return (
        len(text.split()),
        (len(_H2.findall(body)) if marks else 0) + (len(_TAG2.findall(low)) if "<h2" in low else 0),
        (len(_H3.findall(body)) if marks else 0) + (len(_TAG3.findall(low)) if "<h3" in low else 0),
        max(len(_LINK.findall(body)) if "](http" in body else 0, len(_URL.findall(text)) if "://" in text else 0),
        len(_TABLE.findall(body)) if "|" in body else 0,
        _any(low_body, "faq", "quently asked questions") and _found(_FAQ, low_body),
        _any(opening, "tl", "summary") and _found(_TLDR, opening),
        _any(low_body, *_HEADINGS) and _found(_SOURCES, low_body),
        digits and _found(_STEP, low_body),
        _any(low_body, "for example", "e.g.", "example:") and _found(_EXAMPLE, low_body),
        _any(low_body, "vs", "versus", "compar", "alternative") and _found(_COMPARISON, low_body),
        _any(head, "updated", "as of", "new in", "201", "202") and _found(_FRESHNESS, head),
        numbered / max(lines, 1),
        _any(top, " is ", " are ") or _found(_DEFINITION, top),
        top,
        " ".join(intro[: S.INTRO_WORDS]),
    )


def _judged(raw: bytes) -> tuple | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return signals_of(text) if is_plain(text) else None


def plain_signals(text: Column) -> Column:
    """A struct of signals; null for a null text and for one that the expressions have to judge."""

    @F.arrow_udf(f"struct<{SCHEMA}>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nothing = (None,) * len(_FIELDS)
        for texts in batches:
            found = [_judged(raw) for piece in pieces(texts) for raw in piece.to_pylist()]
            columns = zip(*(nothing if row is None else row for row in found)) if found else [()] * len(_FIELDS)
            arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, _FIELDS)]
            left = pa.array([row is None for row in found], pa.bool_())
            missing = pa.compute.or_(left, texts.is_null())
            yield pa.StructArray.from_arrays(arrays, names=[name for name, _ in _FIELDS], mask=missing)

    return judged(text)
