import random

import pytest
from pyspark.sql import functions as F

from tests import model
from topicgauge.operators import chunking
from topicgauge.settings import ChunkOptions

RNG = random.Random(11)
TEXTS = [model.random_text(RNG, RNG.randint(1, 160)) for _ in range(500)]
#: A gap that ends exactly where a text block ends, and one that is longer than a block.
TEXTS += ["x" * 700 + ". " + "y" * 317 + "." + " " * 20 + "z" * 700 + ".", "a" * 640 + "." + " " * 2500 + "b" * 640 + "."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4, "doc_id")


def _by_doc(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(key(r))
    return out


def test_flat_chunks_and_offsets(docs):
    rows = chunking.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    got = _by_doc(rows, lambda r: (r.text, r.char_start, r.char_end, r.token_count))
    want = {i: model.flat(t) for i, t in enumerate(TEXTS) if t.strip()}
    assert got == want
    assert all(r.level == "flat" and r.depth == 0 and r.parent_index is None for r in rows)
    indexes = _by_doc(rows, lambda r: (r.chunk_index, r.chunk_count))
    assert all(v == [(i, len(v)) for i in range(len(v))] for v in indexes.values())


def test_small_target(docs):
    rows = chunking.chunk_documents(docs, "flat", ChunkOptions(target_tokens=10)).orderBy("doc_id", "chunk_index")
    got = _by_doc(rows.collect(), lambda r: r.text)
    assert got == {i: [c[0] for c in model.flat(t, 10)] for i, t in enumerate(TEXTS) if t.strip()}


@pytest.mark.parametrize("fmt", ["markdown", "html"])
def test_sections(docs, fmt):
    rows = chunking.sections(docs, fmt).orderBy("doc_id", "section_no").collect()
    got = _by_doc(rows, lambda r: (r.level, r.heading, r.content, r.char_start, r.char_end))
    parse = getattr(model, fmt)
    assert got == {i: parse(t) for i, t in enumerate(TEXTS) if t.strip() and parse(t)}


@pytest.mark.parametrize("fmt", ["markdown", "html"])
def test_hierarchy_invariants(docs, fmt):
    rows = chunking.chunk_documents(docs, fmt).orderBy("doc_id", "chunk_index").collect()
    for chunks in _by_doc(rows, lambda r: r).values():
        assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
        macro = None
        for c in chunks:
            assert c.parent_index == (macro if c.level == "micro" else None)
            assert c.depth == {"flat": 0, "macro": 0, "micro": 1, "atomic": 2}[c.level]
            macro = c.chunk_index if c.level == "macro" else macro


def _chunks(spark, text, strategy, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return chunking.chunk_documents(docs, strategy, ChunkOptions(**options)).orderBy("chunk_index").collect()


def test_parent_skips_empty_macro(spark):
    rows = _chunks(spark, "## One\nbody\n## Empty\n### Sub\nmore", "markdown")
    assert [(c.level, c.heading, c.parent_index) for c in rows] == [("macro", "One", None), ("micro", "Sub", 0)]


def test_first_level_heading_is_body(spark):
    rows = _chunks(spark, "# Title\nintro\n#### deep\nmore", "markdown")
    assert [(c.level, c.heading) for c in rows] == [("atomic", None)]


def test_bare_headings_fall_back_to_flat(spark):
    rows = _chunks(spark, "## A\n## B", "markdown")
    assert [(c.level, c.text) for c in rows] == [("flat", "## A\n## B")]


def test_bare_html_headings_give_no_chunk(spark):
    docs = spark.createDataFrame([(1, "<h2>A</h2><h3>B</h3>"), (2, " \n"), (3, "text")], "doc_id long, text string")
    chunked = chunking.with_chunks(docs, "html")
    assert {(r.doc_id, r.reason) for r in chunking.unchunkable(chunked).collect()} == {(1, "no chunks"), (2, "blank document")}


def test_nested_tags_in_heading(spark):
    rows = _chunks(spark, "<p>lead</p><H2 id='a'>A <b>bold</b></H2><p>x</p><p>y</p>", "html")
    assert [(c.level, c.heading, c.text) for c in rows] == [("atomic", None, "lead"), ("macro", "A bold", "x y")]


def test_long_lead_is_split_and_moves_parents(spark):
    lead = " ".join(["word " * 59 + "end."] * 4)
    text = f"{lead}\n## H\nbody\n### S\nsub"
    rows = _chunks(spark, text, "markdown")
    assert [c.level for c in rows] == ["atomic"] * 4 + ["macro", "micro"]
    assert rows[-1].parent_index == 4
    assert {(c.char_start, c.char_end) for c in rows[:4]} == {(0, len(lead))}
    whole = _chunks(spark, text, "markdown", split_long_paragraphs=False)
    assert [c.level for c in whole] == ["atomic", "macro", "micro"]
    pairs = _chunks(spark, text, "markdown", atomic_max_words=120)
    assert [c.level for c in pairs] == ["atomic"] * 2 + ["macro", "micro"]


def test_auto_detection(spark):
    texts = ["plain", "## A\nx", "<h2>A</h2>x", "## A\nx<h2>B</h2>", "##\n\nx", "<h2>a</h3>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.f for r in docs.select("doc_id", chunking.detect_format(F.col("text")).alias("f")).collect()}
    assert [found[i] for i in range(6)] == ["flat", "markdown", "html", "markdown", "markdown", "html"]


def test_strategy_per_row_and_bad_name(spark):
    docs = spark.createDataFrame([(1, "## A\nx", "flat"), (2, "## A\nx", "markdown")], "doc_id long, text string, how string")
    rows = chunking.chunk_documents(docs, F.col("how")).orderBy("doc_id").collect()
    assert [r.level for r in rows] == ["flat", "macro"]
    with pytest.raises(ValueError, match="strategy"):
        chunking.chunk_documents(docs, "paragraphs")


def test_a_filter_on_the_chunk_count_does_not_cut_again(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, "word " * 900)], "doc_id long, text string").repartition(2, "doc_id")
    rows = chunking.chunk_documents(docs, "flat").filter(F.col("chunk_count") >= 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert all("split(" not in line for line in plan.splitlines() if "Filter" in line)
