"""Folds over the pieces of one document, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from topicgauge.functions import arrays as A
from topicgauge.operators import chunking


def plain_pack(sizes, limit):
    firsts, filled = [], 0
    for i, size in enumerate(sizes):
        if i == 0 or filled + size > limit:
            firsts.append(i)
            filled = 0
        filled += size
    return firsts


def plain_macro(levels):
    macro, parents = None, []
    for i, level in enumerate(levels):
        if level == 2:
            macro = i
        parents.append(macro if level == 3 else None)
    return parents


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_folds_over_borders_of_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(A, "SEGMENT", segment)
    rng = random.Random(4)
    lists = [[rng.choice([2, 3, 3, 4, 40, 160]) for _ in range(n)] for n in (0, 1, 2, 3, 4, 255, 256, 257, 513, 700)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*lists, None])], "k int, x array<int>")
    x = F.col("x")
    rows = df.select("k", A.pack(x, 150).alias("p"), A.prefix_sums(x).alias("s"), A.nearest_macro(x).alias("m")).orderBy("k").collect()
    for row, sizes in zip(rows, lists):
        assert row.p == plain_pack(sizes, 150)
        assert row.s == [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        assert row.m == plain_macro(sizes)
    assert (rows[-1].p, rows[-1].s, rows[-1].m) == (None, None, None)


def test_gaps_run_on_over_blocks(spark):
    text = "a" + " " * 5000 + "b" * 2000 + "\n\t " * 1000
    df = spark.createDataFrame([(text,), ("x",), ("",)], "t string").withColumn("b", A.text_blocks(F.col("t")))
    for row in df.select("t", "b", A.block_gaps(F.reverse("b")).alias("g")).collect():
        starts = range(0, len(row.t), 1024)
        assert row.g == [len(row.t) - s - len(row.t[s:].lstrip(" \n\t")) for s in starts] + [0]
        assert sum(map(len, row.b)) == len(row.t)


def test_one_very_long_document(spark):
    """Work that grew with the square of its chunks would take many minutes here."""
    n = 200_000
    sentences = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("abc "), i.cast("string"), F.lit(" defg hij klm nop qrs tuv wxyz.")))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", sentences).alias("text"))
    rows = chunking.chunk_documents(docs, "flat")
    texts = [f"abc {i} defg hij klm nop qrs tuv wxyz." for i in range(1, n + 1)]
    firsts = plain_pack([len(t) // 4 for t in texts], 150)
    last = rows.orderBy(F.desc("chunk_index")).first()
    assert last.chunk_index == len(firsts) - 1 and last.text == " ".join(texts[firsts[-1] :])
    assert last.char_end == len(" ".join(texts)) and last.char_start == last.char_end - len(last.text)
