import pytest
from pyspark.sql import functions as F

from topicgauge.operators import plain_signals as P
from topicgauge.operators import signals as G
from topicgauge.sources.readers import make_queries

DOC = """# Guide

TL;DR: the short version

## What is widget tuning?
Widget tuning is a craft...

## Sources
- [Manual](https://example.com)

## FAQ
### What is a widget?
An answer, for example this.
"""


def signals_of(spark, texts, query="widget tuning craft"):
    docs = spark.createDataFrame([(i, t, "all") for i, t in enumerate(texts)], "doc_id long, text string, scope string")
    queries = G.with_query_facts(make_queries(spark, [(1, query, "all", None)]))
    return [r for r in G.content_signals(docs, queries).orderBy("doc_id").collect()]


def test_markdown_document(spark):
    (s,) = signals_of(spark, [DOC])
    assert (s.h2_count, s.h3_count, s.link_count) == (3, 1, 1)
    assert s.has_tldr and s.has_faq and s.has_sources_section and s.has_examples
    assert not (s.has_freshness_signals or s.has_steps or s.has_comparison_language)
    assert s.has_definition_near_top and s.intro_query_term_coverage == 1.0
    assert s.numeric_density == 0 and s.word_count == len(DOC.split())


def test_single_rules(spark):
    cases = [
        ("```\n## code\nFAQ\n```\n", "has_faq", False),
        ("éFAQ", "has_faq", False),
        ("our faq!", "has_faq", True),
        ("e.g. this", "has_examples", False),
        ("x e.g.this", "has_examples", True),
        ("example: this", "has_examples", False),
        ("FOR EXAMPLE x", "has_examples", True),
        ("this vs. that", "has_comparison_language", True),
        ("canvas", "has_comparison_language", False),
        ("ALTERNATIVES", "has_comparison_language", True),
        ("1. do", "has_steps", True),
        ("1.", "has_steps", False),
        ("  Step 3 do", "has_steps", True),
        ("Further Reading", "has_sources_section", True),
        ("   ### sources  ", "has_sources_section", True),
        ("    ### sources", "has_sources_section", False),
        ("sources of", "has_sources_section", False),
        ("ſources", "has_sources_section", True),
        ("In Summary", "has_tldr", True),
        ("x" * 800 + " Summary", "has_tldr", False),
        ("since 2024", "has_freshness_signals", True),
        ("since 2034", "has_freshness_signals", False),
        ("20249", "has_freshness_signals", False),
        ("As of now", "has_freshness_signals", True),
        ("a\u017f of now", "has_freshness_signals", True),
        ("NEW IN this", "has_freshness_signals", True),
        ("FREQUENTLY ASKED QUESTIONS", "has_faq", True),
        ("E.G. this, x E.G.y", "has_examples", True),
    ]
    rows = signals_of(spark, [c[0] for c in cases])
    assert [r[c[1]] for r, c in zip(rows, cases)] == [c[2] for c in cases]


def test_counts(spark):
    texts = ["| a | b |\n|x|\n| open", "a1\nb\n٣", "https://a.b and <h2>x</h2><H2 y><h2x> [t](http://c)", "```\nhttps://in.code\n```", ""]
    rows = signals_of(spark, texts)
    assert rows[0].table_like_lines == 2
    assert rows[1].numeric_density == pytest.approx(2 / 3)
    assert (rows[2].link_count, rows[2].h2_count) == (2, 2)
    assert rows[3].link_count == 1
    assert (rows[4].word_count, rows[4].numeric_density) == (0, 0.0)


def test_query_terms_and_intent(spark):
    cases = [
        ("How to choose a CRM", "how_to"), ("best crm software pricing", "commercial"),
        ("what is retrieval augmented generation", "informational"), ("  ", "informational"), (None, "informational"),
        ("steps and best tools", "how_to"), ("stopwatch", "informational"),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string")
    got = df.select(G.infer_intent(F.col("q")).alias("x")).collect()
    assert [r.x for r in got] == [c[1] for c in cases]
    terms = spark.createDataFrame([("With-your BIG data_lake, data Lake and this lake house x1x2 " + " ".join(f"word{i}" for i in range(9)),)], "q string")
    got = terms.select(G.query_terms(F.col("q")).alias("t")).first().t
    assert got == ["data", "lake", "house", "x1x2", "word0", "word1", "word2", "word3"]


def test_no_terms_means_no_coverage(spark):
    (s,) = signals_of(spark, ["This is with that"], "with that")
    assert s.intro_query_term_coverage == 0 and not s.has_definition_near_top


def by_expressions(docs):
    """What the expressions find, whatever the texts are made of."""
    opened = docs.withColumn("_rest", F.col("text")).withColumns(G._openings(F.col("_rest")))
    return opened.withColumns(G._rules(F.col("_rest"))).drop("text", "_rest", *G._openings(F.col("_rest")))


def test_batches_and_expressions_agree(spark):
    plain = [chr(c) for c in range(0x2100) if P.is_plain(chr(c))]
    assert {"a", "\x85", "\u00e9", "\u2019", "\u2028", "\u20ac"} <= set(plain)
    assert not set("\u00b2\u0130\u0131\u017f\u0301\u0395\u203f") & set(plain)
    around = [
        "{0}is{0} 1{0}2 <h2{0} {0}FAQ{0}\nvs{0}\n{0}step {0}1 x\n{0}## x{0}y\nSources{0}\n##{0}a\n{0}|a|{0}\n{0}```\nfaq\n{0}```{0}z\n"
        "as of{0} [a](http://b) http://a{0}b TL{0}DR", "{0}", "A{0}Summary{0}means{0}", "{0}e.g.{0} For Example{0}\nStep{0}2{0}do {0}201{0}2023",
    ]
    edges = [None, "", " \n", " ".join(["w"] * 220), "w " * 219 + "is x", "w " * 220 + "is x", "x" * 795 + " tldr", "a" * 1996 + " as of", DOC]
    others = ["\u017fources", "\u0661. x", "1\u0661\nx", "\u212a faq\u0301", "\u03a3 vs \u03a3", "x\U0001f600 is", "\u0130s is"]
    texts = [a.format(c) for c in plain for a in around] + edges + others + [DOC + o for o in others]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in G.document_signals(docs).collect()}
    assert found == {r.doc_id: r for r in by_expressions(docs).collect()}
    judged = docs.select("doc_id", P.plain_signals(F.col("text")).isNotNull().alias("here")).filter("here")
    assert judged.count() == len(texts) - 1 - 2 * len(others)


def test_broken_text_is_left_to_the_expressions(spark):
    docs = spark.createDataFrame([(1, bytearray(b"vs \xff 1")), (2, bytearray(b"vs 1"))], "doc_id long, raw binary")
    docs = docs.select("doc_id", F.col("raw").cast("string").alias("text"))
    assert G.document_signals(docs).orderBy("doc_id").collect() == by_expressions(docs).orderBy("doc_id").collect()
