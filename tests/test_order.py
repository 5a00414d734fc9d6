"""Order-preserving keys of doubles and the first best chunk they choose."""

import math
import random
import struct

from pyspark.sql import functions as F

from tests.reports import by_doc, scored
from topicgauge.functions.order import order_key
from topicgauge.operators import diagnostics as D


def values():
    rng = random.Random(11)
    found = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1.0, -1.0]
    for exponent in [*range(-1074, 1024, 37), *range(-60, 3)]:
        edge = math.ldexp(1.0, exponent)
        found += [edge, math.nextafter(edge, 0.0), math.nextafter(edge, math.inf), -edge, math.nextafter(-edge, 0.0)]
    found += [rng.uniform(-1, 1) for _ in range(3000)]
    near = [rng.uniform(-1, 1) * 10.0 ** -rng.randrange(0, 12) for _ in range(1000)]
    found += near + [math.nextafter(x, 2.0) for x in near]
    found += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)) if math.isfinite(x)]
    return found


def test_keys_keep_the_order_of_all_doubles(spark):
    rows = spark.createDataFrame([(x,) for x in values()], "x double").select("x", order_key(F.col("x")).alias("k")).collect()
    rows.sort(key=lambda r: r.x)
    for a, b in zip(rows, rows[1:]):
        assert (a.k < b.k) if a.x < b.x else (a.k == b.k), (a, b)


def test_keys_of_what_has_no_order(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert [r.k for r in rows.select(order_key(F.col("x")).alias("k")).collect()] == [None] * 4


def test_first_best_chunk_between_neighbours(spark):
    rng = random.Random(5)
    reports, best = {}, {}
    for doc in range(300):
        top = rng.choice([1, -1]) * rng.random() * 2.0 ** -rng.randrange(0, 40)
        below = math.nextafter(top, -1.0)
        similarities = [rng.choice([top, below, math.nextafter(below, -1.0)]) for _ in range(rng.randrange(1, 9))]
        reports[doc], best[doc] = similarities, similarities.index(max(similarities))
    facts, compared = by_doc(D.report_numbers(scored(spark, reports))), by_doc(D.compare(scored(spark, reports)))
    assert {d: r.best_chunk_index for d, r in facts.items()} == best
    assert {d: r.max_similarity_chunk_index for d, r in compared.items()} == best


def test_aggregation_stays_hashed(spark):
    plan = D.report_numbers(scored(spark, {1: [0.1, 0.2]}))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
