import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import documents, edge_rows
from topicgauge.llm import quality as Q
from topicgauge.llm.common import crc_bucket

SF = "/root/testdata/sf0.1"


def test_shapes():
    assert [Q.shape(w) for w in ("Hello!!!", "THE!!", "a1-B22", "|", "", "日本", "ß***")] == ["Aa!!", "A!!", "a0-A0", "|", "", "a", "a**"]


def test_features_in_stretches(monkeypatch):
    text = ("some words and some more words " * 40 + "END. " * 9).encode()
    whole = Q.features(text)
    monkeypatch.setattr(Q, "STRETCH", 11)
    cut = Q.features(text)
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1])
    groups = [v for v in whole[1][1:] ** 2]
    assert np.isclose(sum(groups), 5)


def test_updates_follow_the_formula():
    z, n = np.zeros(4), np.zeros(4)
    rows = [(np.array([0, 2]), np.array([1.0, 0.5]), 1), (np.array([0, 1]), np.array([1.0, 2.0]), 0)]
    Q.follow_leader(z, n, rows)
    zz, nn = [0.0] * 4, [0.0] * 4
    for index, value, label in rows:
        w = [0.0 if abs(zz[i]) <= Q.L1 else (np.sign(zz[i]) * Q.L1 - zz[i]) / ((Q.BETA + nn[i] ** 0.5) / Q.ALPHA + Q.L2) for i in index]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, value))))
        for i, x, wi in zip(index, value, w):
            g = (p - label) * x
            zz[i] += g - ((nn[i] + g * g) ** 0.5 - nn[i] ** 0.5) / Q.ALPHA * wi
            nn[i] += g * g
    assert np.allclose(z, zz) and np.allclose(n, nn)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = crc_bucket(F.col("doc_id"), 5)
    rows = Q.training_shards(docs, labels, fold != 0, limit=1500)
    assert sum(len(r.labels) for r in rows.collect()) == 1500
    weights = Q.train(rows)
    assert (weights == Q.train(rows)).all()
    held = labels.filter(fold == 0).select("doc_id", "quality")
    judged = Q.score(docs.join(held, "doc_id", "left_semi"), weights).join(held, "doc_id").collect()
    good, bad = ([r.score for r in judged if r.quality == q] for q in (1, 0))
    assert len(good) > 500 and sum(s >= Q.THRESHOLD for s in good) >= 0.99 * len(good)
    assert sum(s < Q.THRESHOLD for s in bad) >= 0.9 * len(bad)


def test_driver_gets_one_state_in_slices(spark, monkeypatch):
    """The shards' states are averaged in tasks; the rows of all shards would stand in the driver in several copies."""
    docs = documents(spark, [(i, f"some words {i} and {i % 7}", None, None) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality long")
    shards = Q.training_shards(docs, labels, F.lit(True))
    z, n = np.zeros(1 << Q.BITS), np.zeros(1 << Q.BITS)
    for _ in range(2):
        states = []
        for row in sorted(shards.collect()):
            states.append((z.copy(), n.copy()))
            Q.follow_leader(*states[-1], Q.rows_of_shard(*row[1:]))
        z, n = (np.mean([s[k].astype("<f4") for s in states], axis=0, dtype=float) for k in (0, 1))
    kind, fetched = type(shards), []
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: fetched.append(plain(df)) or fetched[-1])
    monkeypatch.setattr(kind, "collect", lambda df: (_ for _ in ()).throw(AssertionError("collected")))
    assert (Q.train(shards, rounds=2) == Q.weights_of(z, n).astype(np.float32)).all()
    assert len(fetched) == 2
    for rows in fetched:
        assert rows.num_rows == Q.SLICES and rows.nbytes < 1.1 * 16 * (1 << Q.BITS)
        assert max(map(len, rows["z"].to_pylist())) == 8 * (1 << Q.BITS) // Q.SLICES


def test_edge_cases(spark):
    docs = documents(spark, edge_rows(), ("score", "turn", "label"))
    labels = spark.createDataFrame(
        [(1, 0, 0), (4, 1, 0), (4, 0, 0), (4, 1, 1), (5, None, 0), (None, 1, 0), (7, 1, 0), (99, 1, 0)], "doc_id long, quality long, toxic long"
    )
    rows = Q.training_shards(docs, labels, F.lit(True))
    # the two rows of document 4 teach once
    assert sorted(label for r in rows.collect() for label in r.labels) == [0, 1, 1]
    scored = Q.score(docs, Q.train(rows)).collect()
    assert len(scored) == len(edge_rows()) and all(0 < r.score < 1 for r in scored)


def test_nothing_to_learn_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality long")
    weights = Q.train(Q.training_shards(documents(spark, [(1, "a b")]), labels, F.lit(True)))
    assert [r.score for r in Q.score(documents(spark, [(1, "a b"), (2, None)]), weights).collect()] == [0.5, 0.5]
    assert Q.score(documents(spark, []), weights).collect() == []


def test_filter_keeps_whole_rows(spark):
    weights = np.zeros(1 << Q.BITS, np.float32)
    docs = documents(spark, edge_rows(), ("score",))
    assert sorted(map(repr, Q.keep_good(docs, weights).collect())) == sorted(map(repr, docs.collect()))
    weights[0] = -5
    assert Q.keep_good(docs, weights).collect() == [] and Q.keep_good(docs, weights).schema == docs.schema


def test_sample_and_slots_are_not_cut(spark):
    assert (Q.TRAIN_ROWS, Q.BITS) == (16_000, 18)
    ids = spark.range(7_000)
    rows = Q.training_shards(ids.selectExpr("id AS doc_id", "concat('w', id) AS text"), ids.selectExpr("id AS doc_id", "id % 2 AS quality"), F.lit(True))
    assert sum(len(r.labels) for r in rows.collect()) == 7_000


def test_repeated_ids_stay_within_the_bound(spark):
    docs = documents(spark, [(1, f"text {i % 7}") for i in range(60)] + [(i, f"own {i}") for i in range(2, 12)] + [(12, None), (12, None)])
    labels = spark.range(1, 13).selectExpr("id AS doc_id", "id % 2 AS quality")
    packed = Q.training_shards(docs, labels, F.lit(True), limit=20).collect()
    assert sorted(label for r in packed for label in r.labels) == [0] * 6 + [1] * 6
    again = Q.training_shards(docs.orderBy(F.desc("text")), labels, F.lit(True), limit=20).collect()
    assert sorted(map(repr, packed)) == sorted(map(repr, again))


def test_repeated_rows_weigh_the_same_in_tables_of_any_size(spark):
    """The same rows teach the same, whether or not unrelated ones bring the table to the bound."""
    few = [(1, "good words here")] * 5 + [(2, "BAD!!"), (1, "another text")]
    many = [(i, f"text {i}") for i in range(100, 130)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality long")

    def taught(rows, limit):
        packed = Q.training_shards(documents(spark, rows), labels, F.lit(True), limit=limit).collect()
        return sorted(repr((x.tobytes(), y)) for r in packed for x, _, y in Q.rows_of_shard(*map(bytes, r[1:])))

    assert taught(few, 100) == taught(few + many, 100) == taught(few, 2) and len(taught(few, 100)) == 2
