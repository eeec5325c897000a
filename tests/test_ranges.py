"""Rows in ranges of time, against a comparison with every range."""

import random

import pytest
from pyspark.sql import functions as F

from ratewise.operators import leaderboard as lb
from ratewise.operators.ranges import in_any_range

DAY = 86_400


def stamp(second):
    return None if second is None else f"1970-01-{1 + second // DAY:02d} {second // 3600 % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


@pytest.mark.parametrize("buckets", [1, 2, 7, 1_000, 65_536])
def test_rows_in_ranges_equal_the_comparison_with_every_range(spark, buckets):
    rng = random.Random(buckets)
    times = [rng.choice([None, rng.randrange(20 * DAY), 7 * DAY, 7 * DAY + 1]) for _ in range(600)]
    spans = [(a, a + rng.choice([0, 1, 50, 4_000, DAY])) for a in (rng.randrange(20 * DAY) for _ in range(40))]
    spans += [(a, b) for a, b in [(7 * DAY + 1, 7 * DAY + 1), (None, 900), (19 * DAY + 80_000, None), (25 * DAY, 30 * DAY)]]
    typed = [(stamp(b), stamp(a)) if i % 3 == 0 and a is not None and b is not None else (stamp(a), stamp(b)) for i, (a, b) in enumerate(spans)]
    ranges = spark.createDataFrame([*typed, *typed[:5], ("", " "), (None, None)], "start string, end string")
    rows = spark.createDataFrame(list(enumerate(times)), "i int, s long").select("i", F.timestamp_seconds("s").alias("started"), F.lit("x").alias("lo"))
    got = in_any_range(rows, ranges, buckets=buckets)
    assert got.columns == rows.columns
    want = [i for i, t in enumerate(times) if t is not None and any((a is None or a <= t) and (b is None or t <= b) for a, b in spans)]
    assert sorted(r.i for r in got.collect()) == want
    assert 0 < len(want) < 600


def test_no_range_selects_all_and_no_row_none(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "i int, s long").select("i", F.timestamp_seconds("s").alias("started"))
    none = spark.createDataFrame([("", None)], "start string, end string")
    some = spark.createDataFrame([("1970-01-01", None)], "start string, end string")
    assert lb.filter_runs(rows, ranges=none).count() == 2
    assert [r.i for r in lb.filter_runs(rows, ranges=some).collect()] == [2]
    assert lb.filter_runs(rows.filter("started is null"), ranges=some).collect() == []


def test_many_ranges_without_an_or_chain_or_a_nested_loop(spark):
    ranges = spark.range(100_000).select(F.timestamp_seconds(F.col("id") * 60).cast("string").alias("start"), F.timestamp_seconds(F.col("id") * 60 + 19).cast("string").alias("end"))
    rows = spark.range(200_000).select("id", F.timestamp_seconds(F.col("id") * 30).alias("started"))
    got = in_any_range(rows, ranges)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert got.count() == 100_000
