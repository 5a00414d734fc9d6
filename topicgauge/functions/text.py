"""Unicode-aware text expressions.

Patterns that use :data:`SPACE` or :data:`NOT_SPACE` need the ``(?U)`` flag: then ``\\s`` is
one Unicode property test per character, which is far faster than a list of ranges.
Stripping uses ``ltrim``, which stops at the first character that stays, and ``rtrim``, which walks the whole text
and is therefore asked only where the last character is white space.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicgauge import settings as S
from topicgauge.functions.arrays import bound

#: Unicode white space plus the four ASCII separators ``\\s`` leaves out.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
#: The same two sets, asking for ASCII first: faster where every character of a text is tested.
_WORD = r"[!-~[^\s\x1c-\x1f]]"
_GAP = r"[[^!-~]&&[\s\x1c-\x1f]]"
#: White space that may occur inside a line once all line ends are ``\n``.
INLINE_WS = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: White space other than ``\n``, for text whose lines end at ``\n`` only.
WS_NO_LF = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends other than ``\n`` itself.
LINE_END = r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LINE_ENDS = tuple("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")

_WS_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(c: Column) -> Column:
    def ends(t: Column) -> Column:
        return F.when(F.lit(_WS_CHARS).contains(F.substring(t, -1, 1)), rstrip(t)).otherwise(t)

    return bound(F.ltrim(c, F.lit(_WS_CHARS)), ends)


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.ltrim(c, F.lit(_WS_CHARS)) == ""


def collapse(c: Column) -> Column:
    """Strip, then squeeze every run of white space to one space."""
    return F.regexp_replace(strip(c), f"(?U){SPACE}+", " ")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"(?U){_WORD}++"))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words joined by one space; the rest of the text is never split."""
    return F.array_join(F.slice(F.split(strip(c), f"(?U){_GAP}+", n + 1), 1, n), " ")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / S.CHARS_PER_TOKEN).cast("int"))


def sentences(c: Column) -> Column:
    """Pieces after ``. ! ?`` plus white space. ``c`` must be stripped, so no piece is blank."""
    return F.split(c, f"(?U)(?<=[.!?]){SPACE}+", -1)


def preview(c: Column, chars: int, length: Column | None = None) -> Column:
    """The first ``chars`` characters, marked where text was left out.

    ``length`` is that of the whole text where ``c`` holds only its beginning.
    """
    size = F.length(c) if length is None else length
    return F.when(size > chars, F.concat(rstrip(F.substring(c, 1, chars)), F.lit("..."))).otherwise(c)


def unify_line_ends(c: Column) -> Column:
    """A byte search for each of the line ends spares most texts the regex."""
    odd = reduce(or_, [c.contains(end) for end in _LINE_ENDS])
    return F.when(odd, F.regexp_replace(c, LINE_END, "\n")).otherwise(c)


def without_code_blocks(c: Column) -> Column:
    """Drop fence lines and what they enclose. ``c`` must have ``\\n`` line ends.

    Splitting at the fence lines leaves text outside code at the even positions, so
    no running state per line is needed.
    """
    pieces = F.split(c, rf"(?dm)^[{INLINE_WS}]*```[^\n]*(?:\n|\z)", -1)
    return F.array_join(F.filter(pieces, lambda _, i: i % 2 == 0), "")


def line_count(c: Column) -> Column:
    """Lines of a text with ``\\n`` ends; a final line end opens no further line."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)


def lines(c: Column) -> Column:
    parts = F.split(c, "\n", -1)
    return F.when(c.endswith("\n") | (c == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
