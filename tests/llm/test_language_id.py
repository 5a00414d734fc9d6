from collections import Counter

from pyspark.sql import functions as F

from tests.llm.data import documents, edge_rows
from topicgauge.llm import language_id as L
from topicgauge.llm.common import crc_bucket

SF = "/root/testdata/sf0.01"


def profile(text, n):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " "
    grams = Counter(padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1))
    del grams[" "]
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[:n]]


def test_distance_is_out_of_place():
    texts = {"aa": "the cat sat on the mat the end", "bb": "der hund und die katze und der baum", "cc": "él año niño"}
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    judge = L.Profiles({k: [code(g) for g in profile(t, 20)] for k, t in texts.items()}, 20).judge
    for text in ("the hat", "und der", "Año!", "x", "cat und"):
        own = profile(text, 20)
        apart = {k: sum(abs(i - p.index(g)) if g in (p := profile(t, 20)) else 20 for i, g in enumerate(own)) for k, t in texts.items()}
        best = min(apart, key=lambda k: (apart[k], k))
        assert judge(text) == (best, 1 - apart[best] / (20 * len(own)))


def test_counting_in_stretches(monkeypatch):
    text = "Übung macht den Meister; " * 50
    whole = [x.tolist() for x in L.ngram_counts(text)]
    monkeypatch.setattr(L, "STRETCH", 7)
    assert [x.tolist() for x in L.ngram_counts(text)] == whole


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    profiles = L.learn(docs, ~held_out, per_language=60)
    judged = L.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out).collect()
    assert len(judged) > 200 and sum(r.lang == r.lang_pred for r in judged) >= 0.98 * len(judged)
    assert all(0 <= r.score <= 1 for r in judged)


def test_edge_cases(spark):
    train = documents(spark, [(1, "the end", "en"), (2, "das ende", "de"), (3, "x y", None), (4, None, "fr"), (None, "voilà", "fr")], ("n", "code"))
    profiles = L.learn(train, crc_bucket(F.col("doc_id"), 4) != 99)
    assert profiles.languages == ["de", "en"]
    rows = edge_rows() + [(30, "123 !?"), (30, "123 !?")]
    judged = L.identify(documents(spark, rows, ("score",)), profiles).collect()
    assert len(judged) == len(rows)
    unknown = {r.doc_id for r in judged if r.lang_pred == "und"}
    assert {1, 2, 3, 30} <= unknown and not {4, 5, 6, 7} & unknown
    assert all(r.score == 0 for r in judged if r.lang_pred == "und")


def test_nothing_learned(spark):
    nothing = L.learn(documents(spark, []), F.lit(True))
    assert [tuple(r) for r in L.identify(documents(spark, [(1, "abc")]), nothing).collect()] == [(1, "und", 0.0)]
    assert L.identify(documents(spark, []), nothing).collect() == []
