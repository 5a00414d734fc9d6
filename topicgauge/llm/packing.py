"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

Every document becomes a run of ids with an end id behind it. A scan task packs its own documents:
nothing is shuffled, and a text is encoded once. Whole windows are cut off documents that exceed one;
what is left of them waits in a pool. Whenever the pool can fill WINDOWS windows, it is packed:

- *Differencing.* Each piece starts as a partial partition: its size in one window, nothing in the
  others. The two partial partitions with the largest spread (fullest minus emptiest window) are
  merged again and again, the fullest window of one with the emptiest of the other, so that opposing
  imbalances cancel. One partition of near-equal windows is left.
- *Count.* If its fullest window exceeds the capacity, the pool is partitioned anew into one window more.
- *Cuts.* Pieces as long as documents are too coarse to balance. So the longest pieces of a pool are cut
  to a LADDER of sizes, one of each size per window: those are merged last and even out the rest. A
  pool holds SLACK ids per window less than would fit, and its last document is cut there.

What is left when a task ends fills as many windows as it can; the last ids, fewer than a window, form
sequences whose lengths are powers of two, which need no padding.

The pool is bounded (WINDOWS windows of ids), and so is the memory of encoded words; besides, a task
holds one document's ids at a time. A task that runs again packs its documents again; the sequences are
numbered by task, so no number is used twice.

Defined results: a null or empty text is its end id alone; rows with null or repeated ids are packed
each on their own; further columns are ignored; an empty table gives no pieces. Texts are encoded
in stretches cut at white space, which the vocabularies meant here drop; a run without any white space is encoded as one.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, rows_of

CAPACITY = 2048
END_ID = 1
#: Windows that are balanced together.
WINDOWS = 64
#: Sizes of the pieces that even a partition out, one of each per window, and the ids per window left free.
LADDER = (64, 32, 16, 8, 4, 2, 1)
SLACK = 1
#: Bytes of text that are encoded at a time, more or less: stretches end at white space.
STRETCH = 1 << 20
#: Encoded words that a worker remembers, and their bytes, until it starts anew; a stretch has fewer.
WORDS_HELD, WORD_BYTES = 1_200_000, 28 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Marks that never form a token with the letters before them.
_MARKS = b".,;:!?)$*%#&@+=~/\"_-"

#: The bytes of texts to their ids, as little-endian unsigned 32-bit integers, in order.
Encode = Callable[[Iterable[bytes]], Iterator[bytes]]


def lowered(text: bytes) -> bytes:
    """A-Z in lower case, as the vocabularies have them, so that fewer words differ.

    Not where special tokens may stand, nor beside combining marks (U+0300 to U+036F, bytes CC and CD): a few of these
    combine with small letters only.
    """
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


class WordCodes(dict):
    """Encodes texts with a tokenizer that drops white space, word by word, and remembers words.

    White space ends every token and takes no part in any, so a text's ids are those of its words in order; so does
    punctuation behind letters.
    """

    def __init__(self, path: str, word_end: str = "</w>"):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(word_end)]] = True
        self.bytes = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Remember the ids of words. Those of letters are encoded in one go and told apart by the tokens that end a word."""
        letters, others, ended = set(), [], []
        for word in words:
            core = word.rstrip(_MARKS)
            if core.isalpha() or not core.isascii() and core.decode("utf-8", "replace").isalpha():
                if core not in self:
                    letters.add(core)
                if len(core) < len(word):
                    ended.append((word, core, word[len(core) :]))
            else:
                others.append(word)
        if letters:
            (ids,) = self.ids([b" ".join(letters).decode("utf-8", "replace")])
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            if len(stops) == len(letters):
                self.update(zip(letters, map(ids.__getitem__, map(slice, [0, *stops], stops))))
            else:  # a letter that lower case makes more than a letter
                self.update(zip(letters, self.ids([w.decode("utf-8", "replace") for w in letters])))
        others += {marks for _, _, marks in ended if marks not in self}
        self.update(zip(others, self.ids([w.decode("utf-8", "replace") for w in others])))
        self.update([(word, self[core] + self[marks]) for word, core, marks in ended])

    def encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts, about STRETCH bytes at most; what was known goes when it is too much."""
        gc.disable()  # words form no cycles, and looking for some among them takes a tenth of the time
        split = [lowered(text).split() for text in texts]
        missing = set(filterfalse(self.__contains__, chain.from_iterable(split)))
        if len(self) + len(missing) > WORDS_HELD or self.bytes > WORD_BYTES:
            self.clear()
            self.bytes, missing = 0, set().union(*split)
        self.bytes += len(b"".join(missing))
        try:
            self.learn(missing)
            return iter([b"".join(map(self.__getitem__, own)) for own in split])
        finally:
            gc.enable()

    def long(self, text: bytes) -> bytes:
        parts, at = [], 0
        while at < len(text):
            blank = _BLANK.search(text, at + STRETCH)
            stop = blank.start() if blank else len(text)
            parts += self.encoded([text[at:stop]])
            at = stop
        return b"".join(parts)

    def __call__(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > STRETCH:
                yield from self.encoded(held)
                held, size = [], 0
            if len(text) > STRETCH:
                yield self.long(text)
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self.encoded(held)


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """The sums of ``windows`` near-equal windows, the fullest first, and the items in each."""
    left, right = [], []  # windows are trees: a number below len(sizes) is an item, others join two
    heap = []
    for i, size in enumerate(sizes):
        sums, slots = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], slots[0] = size, i
        heap.append((-size if windows > 1 else 0, i, sums, slots))
    heapq.heapify(heap)
    number = nodes = len(sizes)
    while len(heap) > 1:
        _, _, sums, slots = heapq.heappop(heap)
        _, _, other_sums, other_slots = heapq.heappop(heap)
        sums, other_slots = sums + other_sums[::-1], other_slots[::-1]
        both = np.flatnonzero((slots >= 0) & (other_slots >= 0))
        joined = np.maximum(slots, other_slots)
        joined[both] = np.arange(nodes, nodes + len(both))
        left += slots[both].tolist()
        right += other_slots[both].tolist()
        nodes += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), number, sums, joined[order]))
        number += 1
    _, _, sums, slots = heap[0]
    filled = []
    for slot in slots.tolist():
        items, stack = [], [slot] if slot >= 0 else []
        while stack:
            node = stack.pop()
            if node < len(sizes):
                items.append(node)
            else:
                stack += (right[node - len(sizes)], left[node - len(sizes)])
        filled.append(items)
    return sums, filled


def balance(sizes: list[int], capacity: int, windows: int) -> list[list[int]]:
    """The items of as few near-equal windows as hold them, from ``windows`` on: one more whenever the capacity is exceeded."""
    windows = max(windows, -(-sum(sizes) // capacity))
    while True:
        sums, filled = difference(sizes, windows)
        if sums[0] <= capacity:
            return filled
        windows += 1


class Piece:
    """A run of a document's ids: ``ids`` from position ``start`` on."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


def laddered(pieces: list[Piece], windows: int, ladder: tuple[int, ...] = LADDER) -> list[Piece]:
    """The same ids, with the longest pieces cut to ``windows`` pieces of each size of the ladder."""
    kept = sorted(pieces, key=len)
    rungs = [size for size in sorted(ladder, reverse=True) for _ in range(windows)]
    fine: list[Piece] = []
    whole = None
    for size in rungs:
        while whole is None or len(whole) < size:
            if whole is not None and len(whole):
                fine.append(whole)
            if not kept:
                return fine
            whole = kept.pop()
        rung, whole = whole.cut(size)
        fine.append(rung)
    if whole is not None and len(whole):
        kept.append(whole)
    return kept + fine


def windows_of(pieces: list[Piece], total: int, capacity: int, windows: int) -> Iterator[list[Piece]]:
    items = laddered(pieces, windows) if windows > 1 else pieces
    for filled in balance([len(p) for p in items], capacity, windows):
        if filled:
            yield [items[i] for i in filled]


def taken(pool: list[Piece], goal: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``goal`` ids of the pool, whose last piece is cut there, and the rest."""
    had, held = [], 0
    for k, piece in enumerate(pool):
        if held + len(piece) > goal:
            first, rest = piece.cut(goal - held)
            return had + [first] * bool(len(first)), [rest, *pool[k + 1 :]]
        had.append(piece)
        held += len(piece)
    return had, []


def sequences(documents: Iterable[tuple[int | None, bytes]], capacity: int, windows: int = WINDOWS) -> Iterator[list[Piece]]:
    """The pieces of each sequence of one task's documents, given as (id, ids)."""
    fit, pool, held = max(1, capacity - SLACK), [], 0
    for doc_id, ids in documents:
        n = len(ids) // 4
        rest = n % capacity
        for start in range(0, n - rest, capacity):
            yield [Piece(doc_id, start, ids[4 * start : 4 * (start + capacity)], n)]
        if rest:
            pool.append(Piece(doc_id, n - rest, ids[4 * (n - rest) :], n))
            held += rest
        while held >= windows * fit:
            chosen, pool = taken(pool, windows * fit)
            held -= windows * fit
            yield from windows_of(chosen, windows * fit, capacity, windows)
    if whole := held // fit:
        chosen, pool = taken(pool, whole * fit)
        held -= whole * fit
        yield from windows_of(chosen, whole * fit, capacity, whole)
    for bit in reversed(range(held.bit_length())):
        if held >> bit & 1:
            chosen, pool = taken(pool, 1 << bit)
            yield chosen


def pack(docs: DataFrame, encoder: Callable[[], Encode], capacity: int = CAPACITY, end_id: int = END_ID, windows: int = WINDOWS) -> DataFrame:
    """The pieces of all documents with their ids and places: see PIECES. ``encoder`` is called once per task."""
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = Rows(arrow_schema(PIECES)), TaskContext.get().partitionId() << 36
        encode = encoder()
        ids: deque[int | None] = deque()

        def texts() -> Iterator[bytes]:
            for doc_id, text in rows_of(batches):
                ids.append(doc_id)
                yield text or b""

        # the encoder may read on before it hands on ids, so the documents' names wait in a queue
        documents = ((ids.popleft(), codes + end) for codes in encode(texts()))
        for sequence in sequences(documents, capacity, windows):
            offset = 0
            for piece in sequence:
                row = (piece.doc_id, piece.start, len(piece), piece.ids, piece.doc_tokens, number, offset)
                yield from out.add(row, len(piece.ids))
                offset += len(piece)
            number += 1
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, PIECES)


#: A worker's tokenizers with their words, by path: loading one takes longer than packing a small partition.
_codes: dict[str, WordCodes] = {}


def word_codes(path: str) -> WordCodes:
    if path not in _codes:
        _codes[path] = WordCodes(path)
    return _codes[path]


def pack_words(docs: DataFrame, path: str, **options) -> DataFrame:
    """Pieces of texts encoded with the word vocabulary at ``path``."""
    return pack(docs, lambda: word_codes(path), **options)
