import random

import pytest

from tests.llm.data import documents, edge_rows
from tests.llm.test_byte_bpe import OWN, PATH, PATTERN, PLAIN, SIGNS
from topicgauge.llm import token_counts as T


def spans(text):
    """(first character, bytes) of every token, one token at a time."""
    ids, at, out = PLAIN.encode_ordinary(text), 0, []
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    for i in ids:
        n = len(PLAIN.decode_single_token_bytes(i))
        out.append((owner[at], owner[at : at + n]))
        at += n
    return out


def brute(text, sections, rule):
    out = []
    for _, a, b in sections:
        if rule == "start":
            out.append(float(sum(a <= first < b for first, _ in spans(text))))
        else:
            out.append(sum(sum(a <= o < b for o in owners) / len(owners) for _, owners in spans(text)))
    return out


@pytest.mark.parametrize("rule", T.RULES)
def test_allocation(rule):
    rng = random.Random(6)
    for _ in range(150):
        text = "".join(rng.choices(SIGNS, k=rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(text) + 3) for _ in range(4))
        sections = [("a", 0, cuts[0]), ("b", cuts[0], cuts[2]), ("c", cuts[1], cuts[3]), ("d", 5, 2)]
        assert T.allocate(text, sections, OWN, rule) == pytest.approx(brute(text, sections, rule))
        assert sum(T.allocate(text, T.lines(text), OWN, rule)) == pytest.approx(len(PLAIN.encode_ordinary(text)))


def test_lines():
    assert T.lines("") == [("0", 0, 0)] and T.lines("a") == [("0", 0, 1)]
    assert T.lines("a\n\nb\n") == [("0", 0, 2), ("1", 2, 3), ("2", 3, 5)]


def test_tables(spark):
    rows = edge_rows() + [(8, "First line\nsecond line, longer\n")]
    got = T.attribute(documents(spark, rows, ("section", "char_start")), PATH, PATTERN).collect()
    want = [(i, *s, n) for i, t in rows for s, n in zip(T.lines(t or ""), brute(t or "", T.lines(t or ""), "start") if len(t or "") < 999 else [len(PLAIN.encode_ordinary(t))])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert T.attribute(documents(spark, []), PATH, PATTERN).collect() == []


def test_named_sections(spark):
    docs = spark.createDataFrame(
        [(1, "Title here\nbody of it", [("title", 0, 10), ("body", 11, 21), (None, 0, 5), ("late", 90, 95)]), (2, "x", None)],
        "doc_id long, text string, parts array<struct<name:string,a:long,b:long>>",
    )
    got = T.attribute(docs, PATH, PATTERN, "share", "parts").collect()
    assert [(r.section, round(r.n_tokens, 6)) for r in got] == [
        (s[0], round(n, 6)) for s, n in zip([("title", 0, 10), ("body", 11, 21), ("late", 90, 95)], brute("Title here\nbody of it", [("t", 0, 10), ("b", 11, 21), ("l", 90, 95)], "share"))
    ]
    with pytest.raises(ValueError):
        T.attribute(docs, PATH, PATTERN, "other")
