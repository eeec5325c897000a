"""Exact quantiles per group that no group has to be sorted or buffered whole for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratewise.operators.skew import TASK_ROWS, join_group_facts
from ratewise.session import cut_lineage

SLACK = 0.001
ACCURACY = 10_000
SMALL = 20_000
CELLS = 256


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float], small: int = SMALL, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Linear-interpolated quantiles (position (n-1)q) of the non-null values of each group.

    A mergeable sketch first brackets every quantile; values outside the brackets are then only counted. What is left is
    narrowed for all groups at once: its distinct values are cut into ranges, the ranges are counted, and only
    those that hold a wanted rank keep their values. This ends when no group has more than ``small`` distinct values left;
    no more than these ever meet in one task, and no group is ranked by a window. ``probs`` maps output names to probabilities.
    """
    names = sorted(probs, key=probs.get)
    bounds = [p for n in names for p in (max(0.0, probs[n] - SLACK), min(1.0, probs[n] + SLACK))]
    data = df.select(*group, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    sketch = cut_lineage(
        data.groupBy(*group).agg(
            F.count("*").alias("__total"),
            F.percentile_approx("__v", F.array(*[F.lit(p) for p in bounds]), ACCURACY).alias("__b"),
        ),
        "brackets",
    )
    located = join_group_facts(data, sketch, group, F.col("__v"), null_safe=True, count="__total", task_rows=task_rows)
    kept = located.groupBy(*group, "__total", _collapsed(len(names), small).alias("__v")).agg(F.count("*").alias("__c"))
    wanted = [rank for n in names for rank in _ranks(probs[n])]
    # One number reaches the driver. Brackets that cannot hold more values than a task may list need no round.
    top = sketch.agg(F.max("__total").alias("top")).head()["top"] or 0
    widest = top * (2 * SLACK + 2 / ACCURACY) * len(names) + 2 * len(names) + 1
    narrowed = kept if widest <= small else _narrowed(cut_lineage(kept, "bracketed"), group, wanted, small, task_rows)
    table = F.array_sort(F.collect_list(F.struct("__v", "__c")))
    listed = narrowed.groupBy(*group, "__total").agg(table.alias("__t"))
    outs = []
    for name in names:
        low, high = (_at(F.col("__t"), rank) for rank in _ranks(probs[name]))
        place = (F.col("__total") - 1) * F.lit(float(probs[name]))
        outs.append((low + F.when(high != low, (high - low) * (place - F.floor(place))).otherwise(0.0)).alias(name))
    return listed.select(*group, F.col("__total").alias("n"), *outs)


def _ranks(prob: float) -> tuple[Column, Column]:
    """The two ranks, from 1, between which the quantile of ``__total`` values lies."""
    place = (F.col("__total") - 1) * F.lit(float(prob))
    return F.floor(place) + 1, F.ceil(place) + 1


def _collapsed(brackets: int, small: int) -> Column:
    """The value itself inside a bracket, else the top of the bracket below it: ranks inside brackets stay exact."""
    v, b = F.col("__v"), F.col("__b")
    inner = F.when(v < b[0], F.lit(float("-inf")))
    for i in range(brackets):
        inner = inner.when(v <= b[2 * i + 1], v)
        if i + 1 < brackets:
            inner = inner.when(v < b[2 * i + 2], b[2 * i + 1])
    return F.when(F.col("__total") <= small, v).otherwise(inner.otherwise(b[2 * brackets - 1]))


def _at(table: Column, rank: Column) -> Column:
    """The value at a rank of a sorted array of values and their counts."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("found"))

    def step(state: Column, item: Column) -> Column:
        upto = state["upto"] + item["__c"]
        found = F.when(state["found"].isNull() & (upto >= rank), item["__v"]).otherwise(state["found"])
        return F.struct(upto.alias("upto"), found.alias("found"))

    return F.aggregate(table, start, step, lambda state: state["found"])


def _narrowed(kept: DataFrame, group: list[str], wanted: list[Column], small: int, task_rows: int) -> DataFrame:
    """Counted values per group, at most ``small`` of them, in which every wanted rank still has its own value.

    A round leaves a group the distinct values of the ranges with a wanted rank, some 1/256 each, and one value for all
    that lies between two such ranges. The number of rounds is logarithmic in the size of the largest group.
    """
    keys = [*group, "__total"]
    ranges = max(CELLS, 16 * len(wanted))
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    while True:
        sizes = kept.groupBy(*keys).agg(F.count("*").alias("__rows"))
        # One number reaches the driver. Fewer values than ranges need no further round.
        if (sizes.agg(F.max("__rows").alias("most")).head()["most"] or 0) <= max(small, 2 * ranges):
            return kept
        pivots = cut_lineage(
            kept.groupBy(*keys).agg(F.count("*").alias("__rows"), F.array_distinct(F.percentile_approx("__v", cuts, ACCURACY)).alias("__p")), "pivots"
        )
        # Cell 2i+1 is the value of pivot i, cell 2i what lies between pivots i-1 and i: a value is in one cell.
        below = F.size(F.filter("__p", lambda p: p < F.col("__v")))
        cell = 2 * below + F.array_contains("__p", F.col("__v")).cast("int")
        placed = join_group_facts(kept, pivots, keys, F.col("__v"), null_safe=True, count="__rows", task_rows=task_rows).select(*keys, "__v", "__c", cell.alias("__cell"))
        placed = cut_lineage(placed, "placed")
        counts = placed.groupBy(*keys, "__cell").agg(F.sum("__c").alias("__c"))
        # At most two cells a range and group; the ranks pick theirs from the running counts.
        cells = F.array_sort(F.collect_list(F.struct(F.col("__cell").cast("double").alias("__v"), F.col("__c"))))
        listed = counts.groupBy(*keys).agg(cells.alias("__t"))
        open_cells = listed.select(*keys, F.array_distinct(F.array(*[_at(F.col("__t"), r).cast("int") for r in wanted])).alias("__open"))
        facts = cut_lineage(open_cells.join(pivots.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__rows"), _same(keys)).drop(*[f"__k_{k}" for k in keys]), "cells")
        chosen = join_group_facts(placed, facts, keys, F.col("__v"), null_safe=True, count="__rows", task_rows=task_rows)
        inside = F.array_contains("__open", F.col("__cell"))
        rows = chosen.withColumn("__own", F.when(inside, F.col("__v"))).withColumn("__gap", F.size(F.filter("__open", lambda o: o < F.col("__cell"))))
        merged = rows.groupBy(*keys, "__gap", "__own").agg(F.max("__v").alias("__v"), F.sum("__c").alias("__c"))
        kept = cut_lineage(merged.select(*keys, "__v", "__c"), "narrowed")


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return cond
