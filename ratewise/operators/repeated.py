"""Repeated runs of the same task and model: spread, drift with latency and hour, outliers, bad days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ratewise.functions.text import slug
from ratewise.functions.times import HOUR_BUCKETS, hour_bucket, local_time, zone_offset
from ratewise.operators.skew import join_group_facts

GROUP = ["task", "provider", "model"]
CORRELATES = [
    "overall_time_seconds", "attempt_mean_seconds", "timeout_examples", "timeout_attempts", "final_timeout_examples",
]


def with_local_time(runs: DataFrame, utc: str = "started") -> DataFrame:
    t = local_time(F.col(utc))
    return (
        runs.withColumn("local_minute", F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm"), zone_offset(F.col(utc), t)))
        .withColumn("local_date", F.date_format(t, "yyyy-MM-dd"))
        .withColumn("local_hour", F.hour(t))
        .withColumn("hour_bucket", hour_bucket(F.hour(t)))
    )


def with_runtime(runs: DataFrame) -> DataFrame:
    """Seconds per evaluated example; null without examples."""
    n = F.when(F.col("evaluated") > 0, F.col("evaluated"))
    return runs.withColumn("runtime_per_example_seconds", F.try_divide("overall_time_seconds", n))


def join_telemetry(metrics: DataFrame, telemetry: DataFrame, key: str) -> DataFrame:
    """Left join of run metrics to their log counters; runs without a log count zero events."""
    counters = [
        "success_attempts", "error_attempts", "timeout_attempts", "timeout_examples", "final_timeout_examples",
        "non_timeout_error_attempts", "log_example_records",
    ]
    out = metrics.join(telemetry.withColumn("has_log", F.lit(True)), key, "left").withColumn("has_log", F.coalesce("has_log", F.lit(False)))
    for c in counters:
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    return out


def repeated_groups(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Groups with at least two runs."""
    return runs.groupBy(*group).agg(F.count("*").alias("run_count")).filter("run_count >= 2")


def repeated_runs(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """The runs of repeated groups; group keys match null-safe."""
    g = repeated_groups(runs, group).select(*[F.col(c).alias(f"g_{c}") for c in group])
    on = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return runs.join(g, cond, "left_semi")


def _group_stats(runs: DataFrame, group: list[str], *aggs) -> DataFrame:
    """Runs with aggregates of their group. Aggregated first and joined back, so a large group is not one window."""
    stats = runs.groupBy(*group).agg(*aggs)
    return join_group_facts(runs, stats, group, F.struct(*[c for c in runs.columns if c not in group]), null_safe=True)


def details(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Every repeated run with its distance to the mean and the best of its group."""
    return (
        _group_stats(repeated_runs(runs, group), group, F.avg("accuracy").alias("__mean"), F.max("accuracy").alias("__best"))
        .withColumn("accuracy_delta_vs_group_mean", F.col("accuracy") - F.col("__mean"))
        .withColumn("accuracy_drop_vs_group_best", F.col("__best") - F.col("accuracy"))
        .drop("__mean", "__best")
    )


def details_order(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    return df.orderBy(*group, F.coalesce("local_minute", "base_name"))


def group_summary(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Run count, span of accuracy and run time, worst timeouts; a span needs two values."""
    def span(c: str, prefix: str, suffix: str = ""):
        return [
            F.min(c).alias(f"{prefix}_min{suffix}"),
            F.max(c).alias(f"{prefix}_max{suffix}"),
            F.when(F.count(c) >= 2, F.max(c) - F.min(c)).alias(f"{prefix}_spread{suffix}"),
        ]

    return (
        runs.groupBy(*group)
        .agg(
            F.count("*").alias("run_count"),
            *span("accuracy", "accuracy"),
            *span("overall_time_seconds", "runtime", "_seconds"),
            F.max("timeout_examples").alias("max_timeout_examples"),
            F.max("final_timeout_examples").alias("max_final_timeout_examples"),
            F.count_if("has_log").alias("runs_with_log_telemetry"),
        )
        .filter("run_count >= 2")
    )


def within_group_correlations(runs: DataFrame, metrics: list[str] = CORRELATES, group: list[str] = GROUP) -> DataFrame:
    """Pearson correlation of accuracy with each metric after removing group means; with the number of points.

    Groups need two runs that have both values. Unknown below two points or without variance.
    """
    long = repeated_runs(runs, group).select(
        *group, F.col("accuracy").alias("y"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m"),
    ).select(*group, "y", "m.metric", "m.x").filter(F.col("y").isNotNull() & F.col("x").isNotNull())
    centred = _group_stats(long, [*group, "metric"], F.count("*").alias("__n"), F.avg("y").alias("__y"), F.avg("x").alias("__x")).filter("__n >= 2")
    dy, dx = F.col("y") - F.col("__y"), F.col("x") - F.col("__x")
    sums = centred.groupBy("metric").agg(
        F.count("*").alias("points"),
        F.sum(dy).alias("sy"), F.sum(dx).alias("sx"),
        F.sum(dy * dy).alias("syy"), F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"),
    )
    n = F.col("points")
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    known = (n >= 2) & (var_y > 0) & (var_x > 0)
    pooled = sums.select("metric", "points", F.when(known, F.try_divide(cov, F.sqrt(F.when(known, var_x * var_y)))).alias("correlation"))
    spark = runs.sparkSession
    all_metrics = spark.createDataFrame([(m,) for m in metrics], "metric string")
    return all_metrics.join(pooled, "metric", "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long")))


def hour_bucket_deltas(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Distance to the group mean by time of day; all four buckets are shown."""
    usable = repeated_runs(runs, group).filter(F.col("accuracy").isNotNull() & F.col("local_hour").isNotNull())
    c = _group_stats(usable, group, F.count("*").alias("__n"), F.avg("accuracy").alias("__mean")).filter("__n >= 2")
    delta = F.col("accuracy") - F.col("__mean")
    per = c.groupBy(hour_bucket(F.col("local_hour")).alias("hour_bucket")).agg(
        F.count("*").alias("n"), F.avg(delta).alias("mean_delta"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta")
    )
    buckets = runs.sparkSession.createDataFrame([(b,) for b in HOUR_BUCKETS], "hour_bucket string")
    return buckets.join(per, "hour_bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def worst_runs(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Worst run of each repeated group with two known accuracies; the first base name on ties."""
    valid = repeated_runs(runs, group).filter(F.col("accuracy").isNotNull())
    worst = F.min(F.struct("accuracy", "base_name", "local_date"))
    return (
        valid.groupBy(*group)
        .agg(F.count("*").alias("n"), F.max("accuracy").alias("best_accuracy"), worst.alias("w"))
        .filter("n >= 2")
        .select(
            *group, F.col("w.base_name").alias("base_name"), F.col("w.accuracy").alias("accuracy"),
            F.col("w.local_date").alias("local_date"), (F.col("best_accuracy") - F.col("w.accuracy")).alias("drop"),
        )
    )


def bad_days(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Per task: the date that holds most of the groups' worst runs, its share and the drops on it.

    Of equally common dates the one that comes first in group order (the group's first base name) counts.
    """
    rep = repeated_runs(runs, group)
    members = rep.groupBy(*group).agg(F.min("base_name").alias("first_name"))
    per_task = members.groupBy("task").agg(F.count("*").alias("repeated_groups"))
    worst = worst_runs(runs, group)
    on = [worst[c].eqNullSafe(members[c]) for c in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    w = worst.join(members, cond).select(worst["task"], worst["local_date"], worst["drop"], members["first_name"])
    totals = w.groupBy("task").agg(F.count("*").alias("groups_with_valid_comparison"))
    dates = w.filter(F.col("local_date").isNotNull()).groupBy("task", "local_date").agg(
        F.count("*").alias("c"), F.avg("drop").alias("mean_drop"), F.max("drop").alias("max_drop"), F.min("first_name").alias("seen")
    )
    top = dates.groupBy("task").agg(F.min(F.struct((-F.col("c")).alias("r"), "seen", "local_date", "c", "mean_drop", "max_drop")).alias("t"))
    return (
        top.join(totals, "task").join(per_task, "task")
        .filter((F.col("repeated_groups") >= 2) & (F.col("groups_with_valid_comparison") >= 2))
        .select(
            "task", "repeated_groups", "groups_with_valid_comparison",
            F.col("t.local_date").alias("dominant_worst_date"),
            F.col("t.c").alias("dominant_worst_group_count"),
            (F.col("t.c") / F.col("groups_with_valid_comparison")).alias("dominant_worst_group_share"),
            F.col("t.mean_drop").alias("mean_drop_on_dominant_date"),
            F.col("t.max_drop").alias("max_drop_on_dominant_date"),
        )
    )


def bad_day_report(clusters: DataFrame, top: int = 10) -> DataFrame:
    """Clusters by share, then drop, then task."""
    drop = F.coalesce("mean_drop_on_dominant_date", F.lit(0.0))
    return clusters.orderBy(F.desc("dominant_worst_group_share"), drop.desc(), "task").limit(top)


def outliers(runs: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Every run of a group next to its best run (which is listed too, with a drop of 0)."""
    valid = repeated_runs(runs, group).filter(F.col("accuracy").isNotNull())
    best = F.min(F.struct((-F.col("accuracy")).alias("r"), "base_name", "local_minute", "accuracy"))
    return (
        _group_stats(valid, group, F.count("*").alias("__n"), best.alias("__b"))
        .filter("__n >= 2")
        .withColumn("group_best_accuracy", F.col("__b.accuracy"))
        .withColumn("best_run_timestamp", F.col("__b.local_minute"))
        .withColumn("accuracy_drop_vs_group_best", F.col("__b.accuracy") - F.col("accuracy"))
        .drop("__n", "__b")
    )


def outlier_report(rows: DataFrame, top: int = 12) -> DataFrame:
    return rows.orderBy(
        F.desc("accuracy_drop_vs_group_best"), "task", F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit("")), "base_name"
    ).limit(top)


def provider_mismatches(runs: DataFrame, file_provider: str, provider: str) -> DataFrame:
    """Runs whose file name names another provider than their metrics."""
    a, b = slug(F.col(file_provider), None), slug(F.col(provider), None)
    both = (F.coalesce(F.col(file_provider), F.lit("")) != "") & (F.coalesce(F.col(provider), F.lit("")) != "")
    return runs.filter(both & (a != b))
