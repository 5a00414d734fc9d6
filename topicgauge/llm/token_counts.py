"""Token counts per section, from one encoding of the whole document.

A document is encoded once; each token covers a span of characters (from the character its first
byte belongs to, to the end of the character of its last byte). Sections are spans of characters,
too: lines, or what the caller names. The two ordered lists of spans are joined by position (binary
search of the section bounds among the token bounds). A token that crosses a border is allocated by
the rule: ``start`` gives it whole to the section of its first character; ``share`` splits it in
proportion to its bytes. With either rule the sections of a document that cover its text add up to
the tokens of the document, which counting sections one by one would not give.

Nothing is shuffled. Defined results: a null or empty text has one line without tokens; characters
outside all sections are not counted, overlapping sections count a token each; a section beyond the
text is empty; null or repeated ids are rows of their own. Sections with a null name or bound are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.byte_bpe import Memo, Vocabulary, loaded, vocabulary_file
from topicgauge.llm.common import Rows, arrow_schema

SCHEMA = "doc_id long, section string, char_start long, char_end long, n_tokens double"
RULES = ("start", "share")

_sizes: dict[int, Memo] = {}


def piece_sizes(vocabulary: Vocabulary) -> Memo:
    """piece -> bytes of each of its tokens, as binary."""
    def sizes(piece: str) -> bytes:
        ids = vocabulary.encode_piece(piece.encode())
        return vocabulary.sizes[ids].astype("<u4").tobytes()

    return _sizes.setdefault(id(vocabulary), Memo(sizes))


def token_ends(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """Where each token ends, in bytes."""
    sizes = b"".join(map(piece_sizes(vocabulary).__getitem__, vocabulary.pieces(text)))
    return np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))


def lines(text: str) -> list[tuple[str, int, int]]:
    """Numbered lines; a line includes its line feed."""
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        end = min(len(text), at + len(line) + 1)
        out.append((str(k), at, end))
        at = end
    return out if len(out) == 1 or out[-1][1] < out[-1][2] else out[:-1]


def allocate(text: str, sections: list[tuple[str, int, int]], vocabulary: Vocabulary, rule: str = "start") -> list[float]:
    """Tokens of each section (name, start, end in characters)."""
    ends = token_ends(text, vocabulary)
    starts = ends - np.diff(ends, prepend=0)
    data = np.frombuffer(text.encode(), np.uint8)
    # the byte at which each character starts, and the length at the end
    at = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    low = at[np.clip([s for _, s, _ in sections], 0, len(text))] if sections else np.array([], np.int64)
    high = at[np.clip([max(s, e) for _, s, e in sections], 0, len(text))] if sections else np.array([], np.int64)
    if rule == "start":
        # the first character of a token that starts inside a character begins earlier
        begin = at[np.searchsorted(at, starts, "right") - 1] if len(starts) else starts
        return (np.searchsorted(begin, high, "left") - np.searchsorted(begin, low, "left")).astype(float).tolist()
    before = np.append(np.arange(len(ends)), len(ends)).astype(float)

    def tokens_until(byte: np.ndarray) -> np.ndarray:
        k = np.searchsorted(ends, byte, "right")
        inside = np.zeros(len(byte))
        part = k < len(ends)
        inside[part] = (byte[part] - starts[k[part]]) / (ends[k[part]] - starts[k[part]])
        return before[k] + inside

    return (tokens_until(high) - tokens_until(low)).tolist()


def attribute(docs: DataFrame, path: str, pattern: str, rule: str = "start", sections: str | None = None) -> DataFrame:
    """``doc_id, section, char_start, char_end, n_tokens`` of every line, or of the spans in the column ``sections``.

    That column is an array of structs (section string, char_start, char_end); ends are exclusive.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(ranks.value, pattern)
        out = Rows(arrow_schema(SCHEMA))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    text = row["text"] or ""
                    if sections is None:
                        spans = lines(text)
                    else:
                        spans = [tuple(s.values()) for s in row["spans"] or [] if s is not None and None not in s.values()]
                    for span, n in zip(spans, allocate(text, spans, vocabulary, rule)):
                        yield from out.add((row["doc_id"], *span, n), 64)
        yield from out.flush()
        piece_sizes(vocabulary).clear()
        vocabulary.forget()

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if sections is not None:
        columns.append(F.col(sections).cast("array<struct<section:string,char_start:bigint,char_end:bigint>>").alias("spans"))
    return docs.select(*columns).mapInArrow(scan, SCHEMA)
