import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tests.llm.data import documents, edge_rows
from topicgauge.llm import byte_bpe as B
from topicgauge.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
OWN = B.Vocabulary.parse(B.vocabulary_file(PATH), PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
SIGNS = ["a", "b", "'", "s", "l", " ", "\n", "\t", "é", "1", "ing", "the", "  ", "'ll", "日本", "🙂", "!", "²", "\u2003"]


def test_text_tree_cuts_like_one_scan():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choices(SIGNS, k=rng.randint(0, 50)))
        assert OWN.pieces(text, leaf=rng.choice([1, 2, 3, 7])) == OWN.cut(text)


def test_piece_tree_merges_like_the_library():
    rng = random.Random(2)
    for _ in range(200):
        piece = "".join(rng.choices(["a", "e", "th", "in", "x", "aa", "ing", "zz", "é", "日"], k=rng.randint(1, 600)))
        assert OWN.encode_piece(piece.encode()) == PLAIN.encode_ordinary(piece)
    assert OWN.encode_piece(b"a" * 50_000) == PLAIN.encode_ordinary("a" * 50_000)


def test_join_is_associative():
    rng = random.Random(3)
    for _ in range(200):
        a, b, c = ("".join(rng.choices("aeinthxg", k=rng.randint(1, 30))).encode() for _ in range(3))
        x, y, z = OWN.merge(a), OWN.merge(b), OWN.merge(c)
        assert OWN.join(OWN.join(x, y), z) == OWN.join(x, OWN.join(y, z)) == OWN.merge(a + b + c)


def test_round_trip_of_edge_cases(spark):
    rows = edge_rows() + [(9, "<|endoftext|> " + "x" * 5000)]
    df = B.decode(B.encode(documents(spark, rows, ("ids", "decoded")), PATH, PATTERN), PATH, PATTERN)
    got = df.select("doc_id", B.n_tokens(F.col("ids")), F.sha2("ids", 256), F.col("decoded").cast("string")).collect()
    want = []
    for doc_id, text in rows:
        ids = PLAIN.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), text or ""))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ids_as_arrays(spark):
    df = B.encode(documents(spark, [(1, "Hello the world"), (2, None)]), PATH, PATTERN)
    assert {r[0]: r[1] for r in df.select("doc_id", B.unpack_ids(F.col("ids"))).collect()} == {1: PLAIN.encode_ordinary("Hello the world"), 2: []}


def test_empty_table(spark):
    assert B.encode(documents(spark, []), PATH, PATTERN).collect() == []
