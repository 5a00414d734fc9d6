import random
from collections import defaultdict

import pytest

from tests.llm.data import documents, edge_rows
from topicgauge.llm import ngram_join as N
from topicgauge.llm.components import components


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def found(spark, rows, **options):
    df = N.near_duplicates(documents(spark, rows, ("class", "n", "first", "cluster")).repartition(3, "doc_id"), **options)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, groups, copies, words=60):
    """Families of edited copies, with passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, words))]
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text).upper() if rng.random() < 0.1 else " ".join(text))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_edge_cases(spark):
    rows = edge_rows() + [(20, "one two three four"), (21, "ONE two\nthree four"), (22, "one two three"), (23, "a b c d e"), (24, "a b c d e f")]
    assert found(spark, rows) == brute(rows)


def test_families_of_copies(spark):
    rows = corpus(1, 60, 6)
    assert found(spark, rows) == brute(rows)


def test_blocks_folds_and_split_products(spark, monkeypatch):
    """The same result when row blocks are tiny, frequent n-grams fold, and clusters are cut in blocks."""
    rows = corpus(2, 12, 40, 120)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    monkeypatch.setattr(N, "BLOCK_ENTRIES", 600)
    monkeypatch.setattr(N, "HOT_ROWS", 2)
    monkeypatch.setattr(N, "PRODUCT_COLUMNS", 16)
    assert found(spark, rows, block_rows=5) == brute(rows)


def test_percent_at_the_border(spark):
    base = [f"x{i}" for i in range(18)]  # 14 n-grams
    rows = [(1, " ".join(base)), (2, " ".join(base[:-2])), (3, " ".join(base[:-4])), (4, " ".join(base[:-3] + ["y"] * 3))]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_nothing_to_link(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (5, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_first_of_each_group_stays(spark):
    rows = [(7, "a b c d e f g"), (3, "A b c d e f g"), (9, "other words that stand here alone"), (10, None)]
    kept = N.drop_near_duplicates(documents(spark, rows, ("stays",)))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 10] and kept.columns[-1] == "stays"


def test_near_duplicates_without_ids_and_with_repeated_ones(spark):
    base = [f"x{i}" for i in range(40)]
    near = [" ".join(base[:k]) for k in (40, 39, 38)]
    other = [" ".join(w.replace("x", "y") for w in t.split()) for t in near]
    more = [" ".join(w.replace("x", "z") for w in t.split()) for t in near]
    rows = [(None, near[0]), (None, near[1]), (None, near[2].upper()), (None, near[2]), (None, "alone here"), (None, None), (None, "")]
    rows += [(5, other[0]), (None, other[1]), (2, other[2]), (2, other[2].upper()), (2, more[1]), (1, more[0]), (2, "alone as well")]
    assert found(spark, rows) == brute(rows)
    kept = N.drop_near_duplicates(documents(spark, rows, ("class", "rows", "of", "first_id"))).collect()
    alone = [(None, "alone here"), (None, None), (None, ""), (2, "alone as well"), (1, more[0]), (2, other[2].upper())]
    got = sorted(((r.doc_id, r.text) for r in kept), key=repr)
    (left,) = [r for r in got if r not in alone]
    assert left[0] is None and left[1].lower() in near and len(got) == len(alone) + 1
