"""Rows whose time lies in any range of a table of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratewise.functions.text import strip
from ratewise.functions.times import run_time
from ratewise.session import cut_lineage

BUCKETS = 65_536


def typed_ranges(ranges: DataFrame) -> DataFrame:
    """``lo, hi`` in microseconds from ``start, end`` text: blank ranges dropped, reversed ones turned round, open ends null.

    An end that is not a time counts as open.
    """
    texts = [F.coalesce(strip(F.col(c)), F.lit("")) for c in ("start", "end")]
    named = ranges.select(*[t.alias(c) for t, c in zip(texts, ("start", "end"))]).filter("start <> '' or end <> ''")
    lo, hi = (F.unix_micros(run_time(F.col(c))) for c in ("start", "end"))
    both = named.select(lo.alias("a"), hi.alias("b"))
    turned = F.col("a") > F.col("b")
    return both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("lo"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("hi"))


def in_any_range(rows: DataFrame, ranges: DataFrame, time: str = "started", buckets: int = BUCKETS) -> DataFrame:
    """Rows whose time lies in a range, ends included; all rows where no range is left after :func:`typed_ranges`.

    The time between the first and the last row is cut into equal buckets. A range covers whole buckets, which are only
    counted at both ends of the stretch, and has a piece in one or two others; pieces of a bucket that overlap become one. Rows
    find whole buckets and pieces by equality of the bucket, so a range is written at most four times however long it is, and
    rows are never held against all ranges: only against the separate pieces in a bucket, a 65,536th of the time.
    """
    spans = cut_lineage(typed_ranges(ranges), "ranges")
    if spans.isEmpty():
        return rows
    at = F.unix_micros(F.col(time).cast("timestamp"))
    # Two numbers reach the driver.
    ends = rows.agg(F.min(at).alias("first"), F.max(at).alias("last")).head()
    if ends["first"] is None:
        return rows.filter(F.lit(False))
    first, last = ends["first"], ends["last"]
    width = (last - first) // buckets + 1

    def bucket(micros: Column) -> Column:
        return F.floor((micros - first) / width).cast("long")

    inside = spans.select(
        F.greatest(F.coalesce("lo", F.lit(first)), F.lit(first)).alias("lo"), F.least(F.coalesce("hi", F.lit(last)), F.lit(last)).alias("hi")
    ).filter("lo <= hi")
    placed = inside.select("lo", "hi", bucket(F.col("lo")).alias("from"), bucket(F.col("hi")).alias("to"))
    whole = cut_lineage(_whole_buckets(placed), "whole")
    opens = F.struct(F.col("from").alias("__bucket"), "lo", F.least("hi", F.lit(first) + (F.col("from") + 1) * width - 1).alias("hi"))
    closes = F.struct(F.col("to").alias("__bucket"), (F.lit(first) + F.col("to") * width).alias("lo"), "hi")
    pieces = placed.select(F.explode(F.when(F.col("to") > F.col("from"), F.array(opens, closes)).otherwise(F.array(opens))).alias("p")).select("p.*")
    islands = _islands(pieces.join(F.broadcast(whole), "__bucket", "left_anti"))
    timed = rows.withColumn("__at", at).filter(F.col("__at").isNotNull()).withColumn("__bucket", bucket(F.col("__at")))
    # At most as many rows as there are buckets.
    covered = timed.join(F.broadcast(whole), "__bucket", "left_semi")
    rest = timed.join(F.broadcast(whole), "__bucket", "left_anti")
    named = islands.withColumnRenamed("__bucket", "__b")
    found = rest.join(named, (F.col("__bucket") == F.col("__b")) & F.col("__at").between(F.col("__lo"), F.col("__hi")), "left_semi")
    return covered.unionByName(found).drop("__at", "__bucket")


def _whole_buckets(placed: DataFrame) -> DataFrame:
    """Buckets that lie in a range as a whole, from the number of stretches that begin and end at each."""
    long = placed.filter(F.col("to") - F.col("from") > 1)
    steps = long.select(F.explode(F.array(F.struct((F.col("from") + 1).alias("b"), F.lit(1).alias("d")), F.struct(F.col("to").alias("b"), F.lit(-1).alias("d")))).alias("s"))
    changes = steps.groupBy("s.b").agg(F.sum("s.d").alias("d"))
    # One row a bucket at most: the running sum is over a table of bounded size.
    order = Window.partitionBy(F.lit(0)).orderBy("b")
    running = changes.select("b", F.sum("d").over(order).alias("open"), F.lead("b").over(order).alias("next"))
    return running.filter("open > 0").select(F.explode(F.sequence("b", F.col("next") - 1)).alias("__bucket"))


def _islands(pieces: DataFrame) -> DataFrame:
    """Pieces of a bucket that overlap as one; of pieces with the same start only the longest is ordered."""
    longest = pieces.groupBy("__bucket", "lo").agg(F.max("hi").alias("hi"))
    order = Window.partitionBy("__bucket").orderBy("lo")
    seen = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = longest.withColumn("__new", F.coalesce((F.col("lo") > seen).cast("int"), F.lit(1)))
    numbered = begins.withColumn("__island", F.sum("__new").over(order))
    return numbered.groupBy("__bucket", "__island").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi")).drop("__island")
