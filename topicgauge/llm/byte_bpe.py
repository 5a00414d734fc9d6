"""Byte-level BPE encoding and decoding as a tree reduction of a monoid.

An encoded stretch of text is a list; two neighbours are joined by encoding a small window around
their border anew and growing it until nothing outside can change. The join is associative, so a
long text is encoded as a balanced tree: halves recursively, then joins. It is used twice.

*Pieces.* The pattern scans left to right and a match looks at no character before its start and
at most two behind its end, apart from the run it ends in. So matches that end three characters
before a cut and are followed by another match are final, and from any position where the scan of
the window and that of the right half both start a match, all later matches coincide.

*Tokens of one piece.* Merging the lowest rank first, leftmost on ties, yields a sequence in which
every two neighbours, encoded together, come out as themselves, and only one sequence of tokens
does. So a window is wide enough as soon as its outer borders pass that test.

Decoding concatenates the bytes of the ids, which is the same reduction without a window.

Ids are held as binary: little-endian unsigned 32-bit integers (``unpack_ids`` gives an array).
Null texts count as empty and give no ids; rows with null or repeated ids are encoded like others;
special tokens are ordinary text. Memory per task: a batch, and a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, rows_of

#: Texts longer than this many characters are cut in halves; pieces beyond PIECE_LEAF bytes, too.
TEXT_LEAF = 1 << 16
PIECE_LEAF = 4
#: Windows beyond this many bytes are merged with a heap.
SHORT_WINDOW = 64
#: More ids than this are decoded in halves.
DECODE_LEAF = 1 << 18
#: Stretches up to this many bytes keep their tokens, because words share their halves.
SHARED_BYTES = 24
#: Entries of each of a worker's memories of encoded pieces, halves, windows and borders.
MEMO_ENTRIES = 200_000

ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, ids binary, decoded binary"


class Memo(dict):
    """What ``of`` gave for a key; starts anew when it holds MEMO_ENTRIES."""

    def __init__(self, of: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.of, self.entries = of, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        self[key] = value = self.of(key)
        return value


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that cuts texts in pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        listed = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.sizes = np.array([len(token) for token in listed], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(listed), np.uint8)
        self.fits = Memo(self._compatible)
        self.merged = Memo(self.merge)
        self.trees = Memo(self._tree)

    @staticmethod
    def parse(data: bytes, pattern: str) -> Vocabulary:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t}, pattern)

    def forget(self) -> None:
        for memo in (self.fits, self.merged, self.trees):
            memo.clear()

    # --- one piece -----------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Merge neighbours, lowest rank first, until none can be merged."""
        ranks = self.ranks
        if len(data) > SHORT_WINDOW:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [r for r in joined if r is not None]
            if not known:
                return [ranks[p] for p in parts]
            at = joined.index(min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = ranks.get(parts[at] + parts[at + 1])

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and links between the parts, for windows that have grown."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # a part is data[i:end[i]]; 0 marks one that was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(data[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= to or end[j] != to:
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        fits = self.fits
        if fits[left[-1], right[0]]:
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merged[b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b]))]
            if (not a or fits[left[a - 1], middle[0]]) and (b == len(right) or fits[middle[-1], right[b]]):
                return left[:a] + middle + right[b:]
            width *= 2

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= PIECE_LEAF:
            return self.merge(data)
        half = (len(data) + 1) // 2
        if len(data) > SHARED_BYTES:
            return self.join(self._tree(data[:half]), self._tree(data[half:]))
        return self.join(self.trees[data[:half]], self.trees[data[half:]])

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._tree(data)

    # --- a text --------------------------------------------------------------

    def pieces(self, text: str, leaf: int = TEXT_LEAF) -> list[str]:
        if len(text) <= leaf:
            return self.cut(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half], leaf), self.pieces(text[half:], leaf))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            before = sum(map(len, left[a:]))
            window = "".join(left[a:] + right[:b])
            again = self.cut(window)
            if b == len(right):
                return left[:a] + again
            starts, at = {}, before  # where a piece of the right half ends, and the number of the next
            for k, piece in enumerate(right[:b], 1):
                at += len(piece)
                starts[at] = k
            at = 0
            for k, piece in enumerate(again[:-1], 1):
                at += len(piece)
                if at in starts and at <= len(window) - 3:
                    return left[:a] + again[:k] + right[starts[at] :]
            width *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenate the bytes of the ids, in stretches whose index arrays stay small."""
        if len(ids) > DECODE_LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.letters[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + sizes, sizes)].tobytes()


def piece_cache(vocabulary: Vocabulary) -> Memo:
    """piece -> its ids as binary."""

    def ids(piece: str) -> bytes:
        found = array("I", vocabulary.encode_piece(piece.encode()))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    return Memo(ids)


_loaded: dict[bytes, tuple[Vocabulary, Memo]] = {}


def loaded(data: bytes, pattern: str) -> tuple[Vocabulary, Memo]:
    """The worker's vocabulary, parsed once per worker."""
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _loaded:
        vocabulary = Vocabulary.parse(data, pattern)
        _loaded[key] = vocabulary, piece_cache(vocabulary)
    return _loaded[key]


def vocabulary_file(path: str) -> bytes:
    """Read on the driver, so that executors need no copy of the file; ranks are a fixed, small table."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = loaded(ranks.value, pattern)
        out = Rows(arrow_schema(ENCODED))
        for doc_id, text in rows_of(batches):
            ids = b"".join(map(cache.__getitem__, vocabulary.pieces((text or b"").decode())))
            yield from out.add((doc_id, ids), len(ids))
        yield from out.flush()
        # the worker goes on with other work
        cache.clear()
        vocabulary.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes of the ids."""
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(ranks.value, pattern)
        out = Rows(arrow_schema(DECODED))
        for doc_id, ids in rows_of(batches):
            data = vocabulary.decode(np.frombuffer(ids or b"", "<u4"))
            yield from out.add((doc_id, ids, data), len(ids or b"") + len(data))
        yield from out.flush()

    return encoded.select("doc_id", "ids").mapInArrow(scan, DECODED)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpack_ids(ids: Column) -> Column:
    """The ids as an array of numbers."""
    digits = F.hex(ids)
    at = lambda i, k: F.substring(digits, (i * 8 + 2 * k + 1).cast("int"), F.lit(2))
    number = lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long")
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), n_tokens(ids) - 1), number)
    )
