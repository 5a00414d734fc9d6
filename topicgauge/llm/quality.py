"""A quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Features of a text are n-grams, of one and two words in lower case, and of one to three word
shapes (letters by case, digits, other characters as they are, runs shortened; a word that repeats
the one before has a shape of its own). Each n-gram is hashed to one of 2^BITS features; its value
is the square root of its share of the text's n-grams of that kind, so long and short texts weigh
the same.

Training runs over a bounded sample of labelled rows in SHARDS shards. In every round each shard
is one task that starts from the common state, applies per-coordinate FTRL-proximal updates row by
row in a fixed order, and returns its state in slices; the states are averaged slice by slice in tasks, and
the mean alone comes to the driver. A state has a fixed size (two numbers per feature) whatever the input. Scores are sparse dot products in the scan of the
whole texts; nothing but (id, score) leaves it.

Defined results: a null or empty text has only the constant feature; rows without an id or with a
null label teach nothing; conflicting labels of one id count as their majority, ties as 0; without
any label every score is 0.5; repeated rows are scored each on its own. Of rows that repeat an id one
teaches, that whose text has the smallest hash, in a table of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, grouped, rows_of
from topicgauge.sources.storage import materialize

BITS = 18
#: Labelled rows that are learned from at most, chosen by hash of the id.
TRAIN_ROWS = 16_000
SHARDS = 8
ROUNDS = 8
#: Slices of the state, in which the shards' states are averaged and the mean comes to the driver.
SLICES = 16
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.0
THRESHOLD = 0.3
#: Entries of a worker's memory of words; it starts anew when full.
WORDS_HELD = 150_000
#: Words of a text that are turned into features at a time.
STRETCH = 1 << 18

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_AGAIN = np.uint64(0x2545F4914F6CDD1D)


class Signs(dict):
    """Code point -> the sign of its kind."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = sign = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return sign


_signs = Signs()
_run = re.compile(r"([Aa0])\1+|([^Aa0])\2{2,}", re.S)


def shape(word: str) -> str:
    """``Hello!!!`` is ``Aa!!``: one sign per run of upper letters, lower letters or digits, up to two of other characters."""
    return _run.sub(lambda m: m[1] or m[2] * 2, word.translate(_signs))


class Words(dict):
    """word -> hashes of its lower-case form and of its shape, as 16 bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS_HELD:
            self.clear()
        text = word.decode("utf-8", "replace")
        value = xxhash.xxh3_64_digest(text.lower().encode()) + xxhash.xxh3_64_digest(shape(text).encode(), 7)
        self[word] = value
        return value


_words = Words()


def _mixed(parts: list[np.ndarray], kind: int) -> np.ndarray:
    """A hash of n neighbours, for every start; the kind tells equal n-grams of words and shapes apart."""
    n = len(parts[0]) - len(parts) + 1
    h = np.full(max(n, 0), _ODD[kind])
    for k, part in enumerate(parts):
        h = (h ^ part[k : k + n]) * _ODD[k]
        h ^= h >> np.uint64(29)
    return h


def counted(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs (how much, if ``n`` is given)."""
    if n is not None:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
    else:
        codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes))) if n is None else np.add.reduceat(n, first)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, the constant one (0) first, and their values."""
    words = text.split()
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(5)]
    for at in range(0, len(words), STRETCH):
        lead = min(at, 1)  # the word before tells whether the first one repeats it
        part = words[at - lead : at + STRETCH + 2]
        own = min(STRETCH, len(part) - lead)
        pair = np.frombuffer(b"".join(map(_words.__getitem__, part)), "<u8").reshape(-1, 2)
        word, form = pair[:, 0], pair[:, 1].copy()
        form[1:][word[1:] == word[:-1]] = _AGAIN
        word, form = word[lead:], form[lead:]
        for kind, grams in enumerate(([word], [word] * 2, [form], [form] * 2, [form] * 3)):
            found = (_mixed(grams, kind)[:own] >> np.uint64(64 - BITS)).astype(np.int32)
            if len(found):
                counts[kind].append(counted(found))
    index, value = [np.zeros(1, np.int32)], [np.ones(1)]
    for kind in counts:
        if kind:
            found = np.concatenate([i for i, _ in kind])
            n = np.concatenate([c for _, c in kind]).astype(float)
            if len(kind) > 1:
                found, n = counted(found, n)
            index.append(found)
            value.append(np.sqrt(n / n.sum()))
    return np.concatenate(index), np.concatenate(value)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probability(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def follow_leader(z: np.ndarray, n: np.ndarray, rows: Iterable[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """FTRL-proximal updates of the state (z, n), row by row."""
    for index, value, label in rows:
        w = weights_of(z[index], n[index])
        gradient = (probability(w @ value) - label) * value
        squared = gradient * gradient
        sigma = (np.sqrt(n[index] + squared) - np.sqrt(n[index])) / ALPHA
        np.add.at(z, index, gradient - sigma * w)
        np.add.at(n, index, squared)


def training_shards(docs: DataFrame, labels: DataFrame, may_learn: Column, limit: int = TRAIN_ROWS) -> DataFrame:
    """The features of the sampled labelled documents, stored: one packed row per shard, in training order."""
    label = (F.avg(F.col("quality").cast("double")) > 0.5).cast("int").alias("label")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(label)
    known = materialize(known.withColumn("turn", F.xxhash64("doc_id", F.lit(11))))
    # about twice the limit by hash, then exactly the limit: the sort sees a bounded number of rows
    share = min(1.0, 2.0 * limit / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    drawn = drawn.orderBy("turn", "doc_id").limit(limit)
    # at most `limit` rows of three numbers
    sample = docs.select(F.col("doc_id"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")
    # of each id one text, whatever the size of the table; rows that repeat an id are folded before the shuffle
    least = F.min(F.struct(F.xxhash64("text").alias("by"), "text"))
    sample = sample.groupBy("doc_id", "turn", "label").agg(least.alias("row")).select("turn", "label", "row.text")
    featured, packed = "shard int, turn long, label int, entries int, index binary, value binary", "shard int, labels binary, entries binary, index binary, value binary"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(featured))
        for turn, label_, text in rows_of(batches):
            index, value = features(text or b"")
            yield from out.add((turn % SHARDS, turn, label_, len(index), index.astype("<i4").tobytes(), value.astype("<f4").tobytes()), 8 * len(index))
        yield from out.flush()
        _words.clear()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(packed))
        for (shard,), run in grouped(rows_of(batches), 1):
            row = (shard, np.array([r[2] for r in run], "i1").tobytes(), np.array([r[3] for r in run], "<i4").tobytes(), b"".join(r[4] for r in run), b"".join(r[5] for r in run))
            yield from out.add(row, sum(map(len, row[1:])))
        yield from out.flush()

    rows = sample.select("turn", "label", "text").mapInArrow(scan, featured)
    return materialize(rows.repartitionById(SHARDS, "shard").sortWithinPartitions("turn", "index").mapInArrow(pack, packed))


def rows_of_shard(labels: bytes, entries: bytes, index: bytes, value: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    indices, values, at = np.frombuffer(index, "<i4"), np.frombuffer(value, "<f4").astype(float), 0
    for label, n in zip(np.frombuffer(labels, "i1").tolist(), np.frombuffer(entries, "<i4").tolist()):
        yield indices[at : at + n], values[at : at + n], label
        at += n


def averaged(states: DataFrame) -> DataFrame:
    """``part, z, n``: the mean of the shards' states, slice by slice, so that no task or row holds more than a slice of each."""
    schema = "part int, z binary, n binary"

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        # a fixed number of rows of a fixed size: no sort of Spark's, whose pages are far larger
        for (part,), run in grouped(sorted(rows_of(batches)), 1):
            both = [np.mean([np.frombuffer(row[at], "<f4") for row in run], axis=0, dtype=float).astype("<f8").tobytes() for at in (2, 3)]
            yield from out.add((part, *both), len(both[0]) + len(both[1]))
        yield from out.flush()

    return states.repartitionById(SLICES, "part").mapInArrow(mean, schema)


def train(shards: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The weights: one number per feature."""
    spark = shards.sparkSession
    size, width = 1 << BITS, (1 << BITS) // SLICES
    z, n = np.zeros(size), np.zeros(size)
    schema = "part int, shard int, z binary, n binary"
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def shard_round(batches: Iterable[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            out = Rows(arrow_schema(schema))
            for shard, *packed in rows_of(batches):
                own_z, own_n = state.value[0].copy(), state.value[1].copy()
                follow_leader(own_z, own_n, rows_of_shard(*packed))
                for part in range(SLICES):
                    both = [own[part * width : (part + 1) * width].astype("<f4").tobytes() for own in (own_z, own_n)]
                    yield from out.add((part, shard, *both), 8 * width)
            yield from out.flush()

        # one state, in SLICES rows: as the rows of all shards, it fills the driver's memory with copies
        means = averaged(shards.mapInArrow(shard_round, schema)).toArrow()
        z, n = z.copy(), n.copy()
        for part, part_z, part_n in rows_of(means.to_batches()):
            z[part * width : (part + 1) * width] = np.frombuffer(part_z, "<f8")
            n[part * width : (part + 1) * width] = np.frombuffer(part_n, "<f8")
        state.destroy()
    return weights_of(z, n).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` for every row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "doc_id long, score double"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(schema))
        w = shared.value
        for doc_id, text in rows_of(batches):
            index, value = features(text or b"")
            yield from out.add((doc_id, probability(w[index] @ value)))
        yield from out.flush()
        _words.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, with all their columns: a filter, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    text_at = docs.columns.index("text")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            good = []
            for (text,) in rows_of([batch.select([text_at])]):
                index, value = features(text or b"")
                good.append(probability(w[index] @ value) >= threshold)
            yield batch.filter(pa.array(good, pa.bool_()))
        _words.clear()  # the worker goes on with other work

    return docs.mapInArrow(scan, docs.schema)
