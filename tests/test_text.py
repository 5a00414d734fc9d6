import random

from pyspark.sql import functions as F

from tests import model
from topicgauge.functions import text as X
from workload import corpora


def _texts(n=400):
    rng = random.Random(5)
    odd = [c.join("ab") for c in model.SPACES] + ["", " ", "\n", "a\n", "a\r\nb", "x\x85"]
    return odd + [model.random_text(rng, rng.randint(1, 40)) for _ in range(n)]


def test_text_columns_follow_python(spark):
    texts = _texts()
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        X.strip(c).alias("strip"),
        X.word_count(c).alias("words"),
        X.collapse(c).alias("collapse"),
        X.lines(X.unify_line_ends(c)).alias("lines"),
        X.line_count(X.unify_line_ends(c)).alias("n_lines"),
        X.first_words(c, 3).alias("three"),
        X.preview(c, 10).alias("preview"),
        X.token_estimate(c).alias("tokens"),
    )
    for r in rows.collect():
        t = r.t
        assert r.strip == t.strip()
        assert r.words == len(t.split())
        assert r.collapse == " ".join(t.split())
        assert list(r.lines) == t.splitlines()
        assert r.n_lines == len(t.splitlines())
        assert r.three == " ".join(t.split()[:3])
        assert r.preview == (t if len(t) <= 10 else t[:10].rstrip() + "...")
        assert r.tokens == max(1, len(t) // 4)


def test_code_blocks_are_dropped(spark):
    text = "a\n```py\n## x\n```\nb\n  ```\nopen"
    row = spark.createDataFrame([(text,)], "t string").select(X.without_code_blocks(F.col("t")).alias("o")).first()
    assert row.o == "a\nb\n"


def test_long_texts_are_not_walked_to_be_stripped(spark):
    """``rtrim`` takes eight bytes for every byte of a text; only a text that ends with white space is handed to it."""
    df = spark.createDataFrame([("x y",), (" x\u3000",), ("\u2003",), ("",), (None,)], "t string")
    rows = df.select(X.strip(F.col("t")).alias("s"), X.is_blank(F.col("t")).alias("b")).collect()
    assert [(r.s, r.b) for r in rows] == [("x y", False), ("x", False), ("", True), ("", True), (None, None)]
    plan = df.select(X.is_blank(F.col("t")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ltrim(" in plan.lower() and "rtrim(" not in plan.lower() and " trim(" not in plan.lower()


def test_rewritten_texts(spark):
    """Texts are spared a pattern only where it cannot match."""
    lines = ["To go", "Of it", "In a", "And b", "With c", "Is d", "Or e", "It f", "A g", "That h", "By i", "Ab. c", "Ob. c", "Éa. b", "to x", " To y"]
    texts = [None, "", *lines, *(f"x\n{line}\n" for line in lines), "\n".join(lines), *(f"{a}\n{b}" for a in lines for b in lines), "x\rTo y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = F.col("text")
    for pattern, replacement in corpora.MARKDOWN_REWRITES:
        plain = F.regexp_replace(plain, "(?dm)" + pattern, replacement)
    rows = corpora._rewritten(docs.withColumn("want", plain), corpora.MARKDOWN_REWRITES).collect()
    assert all(r.text == r.want for r in rows) and sum(r.text != texts[r.doc_id] for r in rows) > 200
