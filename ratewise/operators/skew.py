"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32
HOT_SHARE = 1000  # a key is hot above this fraction (1/1000) of all rows, so at most that many keys are
TASK_ROWS = 4_000_000  # rows of one group that one task may read


def salts_for(largest: int, task_rows: int = TASK_ROWS) -> int:
    """Number of tasks that a group of that many rows is spread over."""
    return max(1, -(-largest // task_rows))


def join_group_facts(
    rows: DataFrame, facts: DataFrame, group: list[str], salt: Column, salts: int = SALTS, null_safe: bool = False,
    count: str | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Inner join of rows to one small row per group, each group spread over several tasks.

    The facts are repeated once per salt; what follows is then never bound to one task per group, as it would be
    where an aggregate reuses the partitioning of a plain join. ``count`` names a column of the facts with the rows of the
    group: ``salts`` then rises with the largest group. If that is too large for ``salts`` tasks and has more than 1/1000 of all
    rows, groups of that size (1000 at most) are broadcast and their rows stay where they are. Facts with a count should be a
    written table.
    """
    if count is None:
        return _salted(rows, facts, group, salt, salts, null_safe)
    # Two numbers reach the driver: all rows and those of the largest group.
    seen = facts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("all"), F.coalesce(F.max(count), F.lit(0)).alias("top")).head()
    total, top = seen["all"], seen["top"]
    if top * HOT_SHARE <= total or salts_for(top, task_rows) <= salts:
        return _salted(rows, facts, group, salt, max(salts, salts_for(top, task_rows)), null_safe)
    hot = F.col(count) * HOT_SHARE > total
    large = _keyed(rows, F.broadcast(facts.filter(hot)), group, null_safe)
    return large.unionByName(_salted(rows, facts.filter(~hot), group, salt, max(salts, salts_for(total // HOT_SHARE, task_rows)), null_safe))


def _salted(rows: DataFrame, facts: DataFrame, group: list[str], salt: Column, salts: int, null_safe: bool) -> DataFrame:
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _keyed(left, right, [*group, "__salt"], null_safe).drop("__salt")


def _keyed(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, keys)
    named = right.select(*[F.col(c).alias(f"__f_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__f_{c}"))
    return left.join(named, cond).drop(*[f"__f_{c}" for c in keys])


def join_by_identity(rows: DataFrame, verdicts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows to one row per distinct key that knows how many rows have the key.

    Keys with more than 1/1000 of all rows, of which there can be 1000 at most, are broadcast; the others are
    shuffled and none of them is large.
    """
    total = verdicts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).scalar()
    hot = F.col(count) * HOT_SHARE > total
    large = F.broadcast(verdicts.filter(hot).drop(count))
    few = F.broadcast(verdicts.filter(hot).select(*keys))
    return rows.join(large, keys).unionByName(rows.join(few, keys, "left_anti").join(verdicts.filter(~hot).drop(count), keys))
