import random

import pytest

from topicgauge.llm import url_filter as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("x.com", "", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://a.example.org/es/1", "https://EXAMPLE.org/en/12?q=/es/", "https://badexample.org/es/1",
    "http://org/", "http://a.org", "http://b.com/fr/x#y", "http://b.com/fr", "http://y.x.com", "http://x.com/fr/1", "ftp://x.com?://a.org/", "http://a.b://c.org/",
]


def brute(url, rules, default):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h.lower() + p, v) for h, p, v in rules if host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, rows, rules, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS block", "'z' AS rule")
    entries = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(r) for r in U.judge(pages, entries, **options).collect()), key=repr)


def test_edge_cases(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4]), (4, URLS[4])]
    assert judged(spark, rows, RULES) == sorted(((i, *brute(u, RULES, "allow")) for i, u in rows), key=repr)


def test_many_entries_and_false_positives(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_PER_ENTRY", 1)  # an overloaded filter passes much that the exact join must drop
    rng = random.Random(5)
    name = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    rules = sorted({(f"{name()}.{rng.choice(['com', 'org'])}", f"/{name()}" * rng.randint(0, 2)): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [(i, f"http://{name()}.{name()}.{rng.choice(['com', 'org'])}/{name()}/{name()}") for i in range(300)]
    assert judged(spark, rows, rules, default="none") == sorted(((i, *brute(u, rules, "none")) for i, u in rows), key=repr)


@pytest.mark.parametrize("rows, rules", [([], RULES), ([(1, "http://a.org/")], [])])
def test_empty_tables(spark, rows, rules):
    assert judged(spark, rows, rules) == [(i, *brute(u, rules, "allow")) for i, u in rows]
