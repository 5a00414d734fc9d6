"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical after lower-casing A-Z. The index maps the 64-bit hash of
a normalised text to the records of its texts. A directory of 2^depth slots, addressed by the
leading bits of the hash, names the bucket of every key; a bucket that holds more bytes than its
capacity is split in two by its next bit, and the directory doubles when that bucket already used
all bits of the directory. Buckets are key ranges, and each range has one owner task: it reads the
texts of its range in key order, chains texts whose hashes collide, compares their bytes, and
writes the records to its index file in the shared folder. Documents then look their record up.

Copies are folded inside each scan task before the shuffle, so a group that holds a third of all
rows reaches its owner as at most a few rows per task. The lookup joins slim rows (id, hash,
digest), where adaptive execution can split the partition of a hot key.

Defined results: a null text counts as empty; a null id never wins against an id; a row repeated
with its id and text counts as a copy, and one of these rows is kept; an empty table gives none.
The table is read twice, so it must give the same rows each time (a file scan or stored table).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.llm.common import Rows, arrow_schema, ascii_lower, fresh, rows_of
from topicgauge.sources.storage import materialize

#: Bytes of distinct normalised texts that a bucket holds before it is split.
BUCKET_BYTES = 32 << 20
#: The directory has at most 2^16 slots: it is a fixed-size value on the driver and in tasks.
MAX_DEPTH = 16
#: Texts one scan task holds to fold copies, in bytes.
FOLD_BYTES = 32 << 20

Hash = Callable[[bytes], int]
PRINTS = "doc_id long, key long, digest binary, size long"
ENTRIES = "bucket int, key long, text binary, keep_id long, n long"
RECORDS = "key long, chain int, digest binary, keep_id long, group_size long"


def hash64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


@dataclass(frozen=True)
class Directory:
    """``slots[leading depth bits of the key]`` is the bucket; buckets are numbered in key order."""

    depth: int
    slots: np.ndarray

    @property
    def buckets(self) -> int:
        return int(self.slots[-1]) + 1

    def bucket(self, key: int) -> int:
        return int(self.slots[key >> (64 - self.depth)] if self.depth else 0)


def grow_directory(loads: np.ndarray, capacity: int) -> Directory:
    """Insert the loads of the 2^MAX_DEPTH finest cells, splitting overfull buckets and doubling the directory.

    A bucket of a single finest cell cannot be split any more; its owner chains what it holds.
    """
    finest = int(len(loads)).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(loads)])
    held = lambda prefix, bits: total[(prefix + 1) << (finest - bits)] - total[prefix << (finest - bits)]
    depth, slots = 0, [(0, 0)]  # a slot refers to its bucket: (prefix, local depth)
    while overfull := {b for b in slots if b[1] < finest and held(*b) > capacity}:
        if any(local == depth for _, local in overfull):
            depth, slots = depth + 1, [b for b in slots for _ in range(2)]
        for i, (prefix, local) in enumerate(slots):
            if (prefix, local) in overfull:
                bit = i >> (depth - local - 1) & 1
                slots[i] = (prefix << 1 | bit, local + 1)
    number = {b: k for k, b in enumerate(dict.fromkeys(slots))}
    return Directory(depth, np.array([number[b] for b in slots], np.int32))


def fingerprints(docs: DataFrame, hasher: Hash = hash64) -> DataFrame:
    """``doc_id, key, digest, size`` of every document's normalised text."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(PRINTS))
        for doc_id, text in rows_of(batches):
            data = (text or b"").lower()
            yield from out.add((doc_id, _signed(hasher(data)), hashlib.sha256(data).digest(), len(data)))
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, PRINTS)


def cell_loads(prints: DataFrame) -> np.ndarray:
    """Bytes of distinct keys per finest cell: at most 2^MAX_DEPTH numbers."""
    cells = (
        prints.groupBy("key").agg(F.max("size").alias("size"))
        .groupBy(F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int").alias("cell"))
        .agg(F.sum(F.col("size") + 64).alias("bytes"))
    )
    loads = np.zeros(1 << MAX_DEPTH, np.int64)
    for cell, size in cells.collect():
        loads[cell] = size
    return loads


def folded_entries(docs: DataFrame, directory: Directory, hasher: Hash = hash64) -> DataFrame:
    """One row per distinct text of a scan task (of a window of it, when its texts exceed FOLD_BYTES)."""
    shared = docs.sparkSession.sparkContext.broadcast(directory)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        out = Rows(arrow_schema(ENTRIES))
        window: dict[bytes, list] = {}
        held = 0

        def emit():
            for data, (keep, n) in window.items():
                key = hasher(data)
                yield from out.add((where.bucket(key), _signed(key), data, keep, n), len(data))

        for doc_id, text in rows_of(batches):
            data = (text or b"").lower()
            if seen := window.get(data):
                seen[0] = doc_id if seen[0] is None else seen[0] if doc_id is None else max(seen[0], doc_id)
                seen[1] += 1
                continue
            window[data] = [doc_id, 1]
            held += len(data) + 64
            if held >= FOLD_BYTES:
                yield from emit()
                window, held = {}, 0
        yield from emit()
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, ENTRIES)


def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's pass over its key range, sorted by key: equal bytes share a record, others are chained."""
    out = Rows(arrow_schema(RECORDS))
    current, records = None, []

    def emit():
        for k, (data, keep, n) in enumerate(records):
            yield from out.add((current, k, hashlib.sha256(data).digest(), keep, n))

    for key, data, keep, n in rows_of(batches):
        if key != current:
            yield from emit()
            current, records = key, []
        for record in records:
            if record[0] == data:
                if keep is not None:
                    record[1] = keep if record[1] is None else max(record[1], keep)
                record[2] += n
                break
        else:
            records.append([data, keep, n])
    yield from emit()
    yield from out.flush()


def build_index(docs: DataFrame, prints: DataFrame, capacity: int = BUCKET_BYTES, hasher: Hash = hash64) -> DataFrame:
    """The index table on shared files: one file per owner, records in key order."""
    directory = grow_directory(cell_loads(prints), capacity)
    owners = folded_entries(docs, directory, hasher).repartitionById(directory.buckets, "bucket")
    return materialize(owners.sortWithinPartitions("key").select("key", "text", "keep_id", "n").mapInArrow(chain, RECORDS))


def find_duplicates(docs: DataFrame, capacity: int = BUCKET_BYTES, hasher: Hash = hash64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; the largest id of equal texts stays."""
    prints = materialize(fingerprints(docs, hasher))
    index = build_index(docs, prints, capacity, hasher).select("key", "digest", "keep_id", "group_size")
    rows = prints.groupBy("doc_id", "key", "digest").agg(F.count(F.lit(1)).alias("repeats"))
    return (
        rows.join(index, ["key", "digest"])
        .select("doc_id", "keep_id", "group_size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("repeat"))
        .select(
            "doc_id", "keep_id", "group_size",
            ((F.col("repeat") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    digest, kept_id, kept_text = fresh(docs, "digest", "kept_id", "kept_text")
    kept = find_duplicates(docs).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_text))
    keyed = docs.withColumn(digest, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_text))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", digest]).select(*docs.columns)
