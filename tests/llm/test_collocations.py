import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.data import documents, edge_rows
from topicgauge.llm import collocations as C


def brute(rows, min_count, max_words=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        ranked = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in chosen.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in C.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(spark, rows):
    return documents(spark, [(k, text, lang) for k, (lang, text) in enumerate(rows)], ("rank", "name", "block", "word", "n", "f"))


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "x", "É", "new", "york", "city", "日本", "hall", "b\x00c"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(words) if rng.random() < 0.8 else rng.choice(["new york city hall", "a a a a a", "of the"]) for _ in range(rng.randrange(60))]
        texts.append((rng.choice(["en", "fr", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n"]) for p in parts)))
    return texts


@pytest.mark.parametrize("partitions,block_words", [(1, None), (5, 40)])
def test_random_texts(spark, partitions, block_words):
    rows = random_texts(5, 150)
    df = made(spark, rows).repartition(partitions)
    assert found(df, min_count=4, block_words=block_words) == brute(rows, 4)
    assert found(df, min_count=4, top=3, block_words=block_words) == brute(rows, 4, top=3)
    assert found(df, min_count=9, max_words=2, block_words=block_words) == brute(rows, 9, max_words=2)


def test_pieces_longer_than_blocks_and_stretches(spark, monkeypatch):
    """One text without any punctuation: every phrase over the border of a block counts, once."""
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "c", "def", "g" * 50]) for _ in range(3000))
    for size, least in ((1, 5), (7, 5), (100, 5), (64, 2)):
        parts = list(C.stretches((text + ". " + text).encode(), size, least))
        assert [w for _, ws in parts for w in ws] == 2 * text.encode().split() and sum(b for b, _ in parts) == 2
    rows = [("en", text), ("en", "ab c"), ("en", None)]
    assert found(made(spark, rows).coalesce(1), min_count=5, block_words=64) == brute(rows, 5)


def test_edge_cases(spark):
    rows = [("en", t) for _, t in edge_rows()] + [(None, "w1 w2 " * 3), ("und", "w1 w2")]
    df = documents(spark, [(i, t, lang) for (i, t), (lang, _) in zip(edge_rows() + [(None, "w1 w2 " * 3), (1, "w1 w2")], rows)], ("rank", "score", "lang_"))
    assert found(df, min_count=3) == brute(rows, 3)
    assert found(documents(spark, [])) == [] and found(documents(spark, [(1, None), (2, "...")]), min_count=1) == []


def test_products_beyond_64_bits(spark):
    """Frequencies near 10^12: the score keeps every digit."""
    a, n, left, right = 999_999_999_989, 10**13 - 27, 10**12 - 11, 10**12 + 39
    row = spark.createDataFrame([(a, n, [left, a + 7], [right, a + 1])], "f long, n long, firsts array<long>, rests array<long>")
    cut = row.select(C.weakest_cut(3).alias("c")).first().c
    scores = [1000 * a * n // (x * y) for x, y in ((left, a + 1), (a + 7, right))]
    assert (cut.score, cut.k) == min((s, k) for k, s in enumerate(scores, 1)) and isinstance(cut.score, int)


def test_registered_query_matches_sql(spark):
    from check_oracle import connect, difference
    from topicgauge.llm import queries

    sf = "/root/testdata/sf0.01"
    expected = connect(sf).execute(queries.ORACLES["op11_collocations"]).df()
    assert len(expected) > 50
    assert difference(queries.QUERIES["op11_collocations"](spark, sf), expected) is None
