import functools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import documents, edge_rows
from topicgauge.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@functools.cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(pieces, texts, capacity):
    """Every id lies in one piece, sequences are gapless and fit."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        runs, at = sorted(own, key=lambda p: p.start), 0
        for p in runs:
            assert p.start == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at == runs[0].doc_tokens == runs[-1].doc_tokens
        assert b"".join(bytes(p.ids) for p in runs) == plain_ids(texts[doc_id]).tobytes()
    lengths = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        lengths.append(at)
    return lengths


def padding(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = P.pack_words(docs, PATH).collect()
    lengths = check(pieces, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, 2048)
    assert padding(lengths, 2048) < 0.002 * sum(lengths)
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, P.pack_words(docs, PATH).collect()))


def test_edge_cases(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    docs = documents(spark, [*dict(rows).items(), (8, "<|endoftext|> İstanbul ΣΑΣ á ﬁ \x85x\x1cy it's 42nd​!"), (9, "x" * 5000)], ("start", "ids", "length"))
    for partitions in (1, 5):
        texts = {r.doc_id: r.text for r in docs.collect()}
        check(P.pack_words(docs.repartition(partitions), PATH, capacity=128).collect(), texts, 128)
    both = P.pack_words(documents(spark, edge_rows()), PATH).collect()
    assert sum(p.length for p in both) == sum(len(plain_ids(t)) for _, t in edge_rows())
    assert P.pack_words(documents(spark, []), PATH).collect() == []


def test_words_that_do_not_fit_the_memory(monkeypatch):
    monkeypatch.setattr(P, "WORDS_HELD", 50)
    monkeypatch.setattr(P, "STRETCH", 300)
    rng, encode = random.Random(2), P.WordCodes(PATH)
    words = ["été,", "x1", "it's", "İ", "the", "the)..", "y" * 90, "日本語!", "\u0301a", "a\u0301?", "?", "don't,", "'s,", "é's", "x.y", "ﬁ;", "THE,", "H\u0331", "<|ENDOFTEXT|>", "É.", "I\u0307"]
    texts = [" ".join(rng.choice([*words, f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    assert list(encode(t.encode() for t in texts)) == [plain_ids(t)[:-1].tobytes() for t in texts]


def test_words_with_any_marks_behind_are_encoded_together():
    encode, calls = P.WordCodes(PATH), []
    plain, encode.ids = encode.ids, lambda texts: calls.append(len(texts)) or plain(texts)
    marks = ["***", "$$$", "%%%", "@", "#", "=", "--", "_", '"', "+!", "/", "~&"]
    text = " ".join(f"{a}{b}{m}" for a in "abcdefgh" for b in "éxyz" for m in marks)
    assert list(encode([text.encode()])) == [plain_ids(text)[:-1].tobytes()]
    assert sum(calls) <= 1 + len(marks)  # the letters in one go, and each run of marks


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    encode = P.word_codes(PATH)
    text = text.encode("utf-8", "replace").decode()
    assert list(encode([text.encode()])) == [plain_ids(text)[:-1].tobytes()]


def test_differencing_by_hand():
    """8 7 6 5 4 in two: 8-7=1, 6-5=1, 4-1=3, 3-1=2, so the halves differ by two (16 and 14)."""
    sums, filled = P.difference([8, 7, 6, 5, 4], 2)
    assert sums.tolist() == [16, 14] and sorted(sum(filled, [])) == [0, 1, 2, 3, 4]
    sums, filled = P.difference([5, 5, 5, 4, 4, 4, 3, 3, 3], 3)
    assert sums.tolist() == [12, 12, 12]
    assert [sum([5, 5, 5, 4, 4, 4, 3, 3, 3][i] for i in items) for items in filled] == [12, 12, 12]


@pytest.mark.parametrize("seed", range(5))
def test_count_rises_when_capacity_is_exceeded(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(40, 90) for _ in range(60)]
    filled = P.balance(sizes, 100, 1)
    assert len(filled) > -(-sum(sizes) // 100)
    assert all(sum(sizes[i] for i in items) <= 100 for items in filled) and sorted(sum(filled, [])) == list(range(60))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=80), st.sampled_from([1, 2, 7, 64, 256]), st.integers(1, 6))
def test_sequences_of_any_documents(sizes, capacity, windows):
    docs = [(k, np.arange(n, dtype="<u4").tobytes()) for k, n in enumerate(sizes)]
    seen = {k: [] for k in range(len(sizes))}
    for sequence in P.sequences(iter(docs), capacity, windows):
        assert 0 < sum(map(len, sequence)) <= capacity
        for p in sequence:
            seen[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
            assert np.frombuffer(p.ids, "<u4")[0] == p.start and p.doc_tokens == sizes[p.doc_id]
    assert all(sorted(ids) == list(range(n)) for ids, n in zip(seen.values(), sizes))
