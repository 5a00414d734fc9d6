import hashlib
import string
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.data import documents, edge_rows
from topicgauge.llm import exact_dedup as E

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: i != keep):
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = E.find_duplicates(documents(spark, rows, ("key", "digest", "kept", "n")), **options)
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_edge_cases(spark):
    assert found(spark, edge_rows()) == brute(edge_rows())


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_colliding_hashes_are_chained_by_bytes(spark, bits):
    rows = [(i, f"Text {i % 37}") for i in range(200)]
    few = lambda data: E.hash64(data) >> 64 - bits << 64 - bits if bits else 0
    assert found(spark, rows, capacity=500, hasher=few) == brute(rows)


def test_directory_doubles_until_no_bucket_is_overfull():
    rng = np.random.default_rng(3)
    loads = rng.integers(0, 10, 1 << E.MAX_DEPTH)
    loads[5] = 10**6  # one cell alone exceeds the capacity and cannot be split
    directory = E.grow_directory(loads, 4000)
    cells = np.arange(1 << E.MAX_DEPTH)
    bucket = directory.slots[cells >> E.MAX_DEPTH - directory.depth]
    held = np.bincount(bucket, loads)
    assert (np.diff(bucket) >= 0).all() and directory.buckets == bucket[-1] + 1
    assert held.sum() == loads.sum() and (np.delete(held, bucket[5]) <= 4000).all()
    assert (bucket == bucket[5]).sum() == 1 and directory.depth == E.MAX_DEPTH
    assert E.grow_directory(np.zeros(1 << E.MAX_DEPTH), 10).buckets == 1


def test_kept_rows_come_whole(spark):
    rows = [(1, "A b", "en", "x"), (2, "a B", "fr", "y"), (3, "c"), (3, "c"), (3, "other")]
    kept = E.drop_duplicates(documents(spark, rows, ("digest", "kept_id")))
    assert kept.columns[-2:] == ["digest", "kept_id"]
    assert sorted((r.doc_id, r.text, r.lang) for r in kept.collect()) == [(2, "a B", "fr"), (3, "c", "en"), (3, "other", "en")]
