"""Leaderboards over run tables: filters, sorts, balanced means with intervals, profiles, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratewise.functions import numbers
from ratewise.operators.quantiles import exact_quantiles
from ratewise.operators.ranges import in_any_range

# Which metrics fall, are percentages, or have an approximate interval.
LOWER_IS_BETTER = {"calibration_ece", "estimated_cost_usd"}
PERCENT = {"accuracy", "macro_f1", "macro_precision", "macro_recall", "calibration_ece"}
WITH_INTERVAL = {"accuracy", "macro_f1", "macro_precision", "macro_recall"}
METRICS = [
    "estimated_cost_usd", "accuracy", "cohen_kappa", "repeat_alpha", "macro_f1", "macro_precision", "macro_recall", "calibration_ece",
]
PAGE = {"leaderboard": 60, "token_profile": 16, "profile": 8}

Range = tuple[str | None, str | None]


def sample_size() -> Column:
    """First known count above 1: examples, predictions, truth labels."""
    counts = [F.col(c) for c in ("total_examples", "prediction_count", "truth_label_count")]
    return F.coalesce(*[F.when(c > 1, c) for c in counts])


def prediction_count() -> Column:
    return F.coalesce("prediction_count", "total_examples", "truth_label_count", F.lit(0).cast("long"))


def with_interval(runs: DataFrame, metric: str) -> DataFrame:
    """Approximate 95 % interval of a percentage; null for other metrics and for samples of one."""
    n = sample_size()
    if metric not in WITH_INTERVAL:
        none = F.lit(None).cast("double")
        return runs.withColumn("ci_low", none).withColumn("ci_high", none).withColumn("ci_n", F.lit(None).cast("long"))
    m = F.col(metric)
    return (
        runs.withColumn("ci_low", numbers.wald_low(m, n))
        .withColumn("ci_high", numbers.wald_high(m, n))
        .withColumn("ci_n", F.when(m.isNotNull(), n).cast("long"))
    )


def tidy_ranges(ranges: list[Range]) -> list[Range]:
    """Ranges typed by a user: blank ones dropped, reversed ones turned round; either end may be open."""
    out = []
    for start, end in ranges:
        start, end = (start or "").strip() or None, (end or "").strip() or None
        if start or end:
            out.append((start, end))
    return out


def in_ranges(time: Column, ranges: list[Range]) -> Column:
    """True inside any range, ends included; a missing time is in none."""
    from ratewise.functions.times import run_time

    hit = F.lit(False)
    for start, end in tidy_ranges(ranges):
        lo, hi = run_time(F.lit(start)), run_time(F.lit(end))
        # A bound that is not a time counts as open; a range without any is ignored by the caller's list.
        low, high = F.when(lo.isNotNull() & hi.isNotNull(), F.least(lo, hi)).otherwise(lo), F.when(lo.isNotNull() & hi.isNotNull(), F.greatest(lo, hi)).otherwise(hi)
        hit = hit | (F.coalesce(time >= low, F.lit(True)) & F.coalesce(time <= high, F.lit(True)))
    return time.isNotNull() & hit


def filter_runs(
    runs: DataFrame,
    tasks: list[str] = (),
    models: list[str] = (),
    tags: list[str] = (),
    need_accuracy: bool = False,
    ranges: list[Range] | DataFrame = (),
) -> DataFrame:
    """Selected runs: any listed task, any listed model, any listed tag, any time range. Empty lists select all.

    Ranges that a user typed come as a list; a table ``start, end`` of any size is joined.
    """
    out = runs
    if tasks:
        out = out.filter(F.col("task").isin(*tasks))
    if models:
        out = out.filter(F.col("model").isin(*models))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if need_accuracy:
        out = out.filter(F.col("accuracy").isNotNull())
    if isinstance(ranges, DataFrame):
        return in_any_range(out, ranges)
    if tidy_ranges(list(ranges)):
        out = out.filter(in_ranges(F.col("started"), list(ranges)))
    return out


def search_options(options: DataFrame, text: str, selected: list[str], column: str = "value") -> DataFrame:
    """Facet values that contain the search text, and those already selected."""
    needle = text.strip().lower()
    keep = F.contains(F.lower(column), F.lit(needle))
    if selected:
        keep = keep | F.col(column).isin(*selected)
    return options if not needle else options.filter(keep)


def metric_order(metric: str, column: str | None = None) -> Column:
    """Better values first, unknown ones last."""
    c = F.col(column or metric)
    return c.asc_nulls_last() if metric in LOWER_IS_BETTER else c.desc_nulls_last()


def default_direction(metric: str) -> str:
    return "asc" if metric in LOWER_IS_BETTER else "desc"


def leaderboard_order(metric: str) -> list[Column]:
    """By metric, then macro F1, then newest; runs without a time come last."""
    return [metric_order(metric), metric_order("macro_f1"), F.col("started").desc_nulls_last()]


def table_order(column: str, direction: str | None = None, name: str = "file_name") -> list[Column]:
    """Sort of the metrics table: unknown values last when ascending but first when descending."""
    direction = direction or default_direction(column)
    c = F.col(column)
    first = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()
    return [first, F.col("started").desc_nulls_last(), F.col(name).asc()]


def page(df: DataFrame, shown: int | None, default: int) -> DataFrame:
    """The first rows of a sorted report; at least one."""
    return df.limit(max(1, shown if shown and shown > 0 else default))


def metric_values(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per run and metric."""
    return runs.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def preferred_values(values: DataFrame) -> DataFrame:
    """Best value per metric: the smallest of falling metrics, the largest of others."""
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    falling = F.col("metric").isin(*LOWER_IS_BETTER)
    return known.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(
        "metric", F.when(falling, F.col("lo")).otherwise(F.col("hi")).alias("preferred")
    )


def highlighted(values: DataFrame) -> DataFrame:
    """Metric values with a mark on those that equal the preferred value."""
    return values.join(preferred_values(values), "metric", "left").withColumn(
        "is_preferred", F.coalesce(F.col("value") == F.col("preferred"), F.lit(False))
    )


def balanced_aggregate(df: DataFrame, group: list[str], unit: str, metric: str, price: str | None = None) -> DataFrame:
    """Mean of unit means, so that units with many runs do not dominate.

    Units without any metric value drop out, with their prices; the price mean is over units with a known one.
    ``df`` may carry ``ci_low, ci_high, ci_n`` per row; intervals are then combined per unit and again per group.
    """
    has_ci = {"ci_low", "ci_high", "ci_n"} <= set(df.columns)
    m = numbers.finite(F.col(metric))
    p = numbers.finite(F.col(price)) if price else F.lit(None).cast("double")
    aggs = [F.avg(m).alias("u_metric"), F.avg(p).alias("u_price"), F.count("*").alias("u_items")]
    if has_ci:
        known = F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull()
        aggs += [
            F.sum(F.when(known, numbers.half_width_variance(F.col("ci_low"), F.col("ci_high")))).alias("u_var"),
            F.count_if(known).alias("u_cis"),
            F.sum(F.when(known, F.coalesce("ci_n", F.lit(0).cast("long")))).alias("u_n"),
        ]
    units = df.groupBy(*group, F.trim(F.coalesce(F.col(unit), F.lit(""))).alias("unit")).agg(*aggs)
    used = F.col("u_metric").isNotNull()
    out = [
        F.avg("u_metric").alias("metric_value"),
        F.avg(F.when(used, F.col("u_price"))).alias("price_value"),
        F.count_if(used).alias("unit_count"),
        F.count_if(used & F.col("u_price").isNotNull()).alias("priced_unit_count"),
        F.sum("u_items").alias("item_count"),
    ]
    if has_ci:
        have = used & (F.col("u_cis") > 0)
        lo = numbers.combined_low(F.col("u_metric"), F.col("u_var"), F.col("u_cis"))
        hi = numbers.combined_high(F.col("u_metric"), F.col("u_var"), F.col("u_cis"))
        units = units.withColumn("u_low", F.when(have, lo)).withColumn("u_high", F.when(have, hi))
        var = F.sum(numbers.half_width_variance(F.col("u_low"), F.col("u_high")))
        n, mean = F.count("u_low"), F.avg("u_metric")
        out += [
            F.when(n > 0, numbers.combined_low(mean, var, n)).alias("ci_low"),
            F.when(n > 0, numbers.combined_high(mean, var, n)).alias("ci_high"),
            F.sum(F.when(F.col("u_low").isNotNull(), F.col("u_n"))).alias("ci_n"),
        ]
    return units.groupBy(*group).agg(*out)


def group_entries(aggregates: DataFrame, metric: str, label: str) -> DataFrame:
    """Grouped bars: by metric, then label."""
    return aggregates.orderBy(metric_order(metric, "metric_value"), label)


def distribution(runs: DataFrame, group: list[str], metric: str) -> DataFrame:
    """Minimum, quartiles and maximum of a metric per group."""
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return exact_quantiles(runs, group, metric, probs)


def kpis(runs: DataFrame) -> DataFrame:
    """One row: runs, tasks, best accuracy, requests."""
    return runs.agg(
        F.count("*").alias("runs"),
        F.count_distinct("task").alias("tasks"),
        F.max("accuracy").alias("best_accuracy"),
        F.sum(F.coalesce("requests_total", F.lit(0))).alias("requests"),
    )


def facets(runs: DataFrame) -> DataFrame:
    """Distinct tasks, models and tags with their number of runs, sorted."""
    def of(kind: str, c: Column) -> DataFrame:
        return runs.select(F.lit(kind).alias("facet"), c.alias("value"))

    tags = runs.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value"))
    rows = of("task", F.col("task")).union(of("model", F.col("model"))).union(tags)
    return rows.groupBy("facet", "value").agg(F.count("*").alias("runs")).orderBy("facet", "value")


def joined_labels(runs: DataFrame, group: list[str], column: str) -> DataFrame:
    """Sorted distinct names of a group in one text, joined by `` + ``."""
    names = F.array_sort(F.collect_set(F.when(F.trim(column) != "", F.trim(column))))
    return runs.groupBy(*group).agg(F.array_join(names, " + ").alias("label"))


def shared_suffix(suffix: Column) -> Column:
    """Aggregate: the suffix if every run of the group has the same non-empty one, else empty."""
    s = F.coalesce(suffix, F.lit(""))
    return F.when(F.min(s) == F.max(s), F.min(s)).otherwise(F.lit(""))


def top_run(runs: DataFrame, metric: str) -> DataFrame:
    """Best run of a metric, the newest among equals."""
    return runs.orderBy(metric_order(metric), F.col("started").desc_nulls_last(), "file_name").limit(1)


def _rank_key(metric: str, column: Column) -> Column:
    """Smaller is better."""
    return column if metric in LOWER_IS_BETTER else -column


def best_per_task(runs: DataFrame, metric: str) -> DataFrame:
    """First run of each task in leaderboard order among those with a value."""
    known = runs.filter(F.col(metric).isNotNull())
    f1 = F.coalesce(-F.col("macro_f1"), F.lit(float("inf")))
    when = F.coalesce(-F.col("started").cast("double"), F.lit(float("inf")))
    key = F.struct(_rank_key(metric, F.col(metric).cast("double")).alias("k"), f1.alias("f"), when.alias("t"), F.col("file_name"))
    best = F.min(F.struct(key.alias("key"), F.col(metric).cast("double").alias("metric_value"), "model"))
    return (
        known.groupBy("task").agg(best.alias("b"))
        .select("task", F.col("b.key.file_name").alias("file_name"), F.col("b.model").alias("model"), F.col("b.metric_value").alias("metric_value"))
        .orderBy(metric_order(metric, "metric_value"), "task")
    )


def last_per_file(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """One row per file; the last loaded wins."""
    last = F.max(F.struct(*order, F.struct(*[c for c in rows.columns if c != path]).alias("row")))
    return rows.groupBy(path).agg(last.alias("l")).select(path, "l.row.*")


def time_series(runs: DataFrame, metric: str) -> DataFrame:
    """Runs with time and value, oldest first, better first at the same time."""
    known = runs.filter(F.col("started").isNotNull() & F.col(metric).isNotNull())
    return known.orderBy(F.col("started").asc(), metric_order(metric))


def cost_per_prediction(cost: Column) -> Column:
    n = numbers.non_negative(prediction_count())
    return F.when(n > 0, F.try_divide(cost, n))


def scatter(runs: DataFrame, metric: str, group_by: str = "none", per_prediction: bool = False) -> DataFrame:
    """Price against metric, per run or balanced per model or task.

    ``runs`` has ``file_name, task, model, suffix, started, estimated_cost_usd``, the counts and the metric.
    Groups without a known price come first, then by price, metric and label.
    """
    cost = numbers.finite(F.col("estimated_cost_usd"))
    base = with_interval(runs.filter(numbers.finite(F.col(metric)).isNotNull()), metric)
    base = base.withColumn("__price", cost_per_prediction(cost) if per_prediction else cost)
    other = {"task": "model", "model": "task", "none": "task"}[group_by]

    def named(c: str) -> Column:
        t = F.trim(F.coalesce(F.col(c), F.lit("")))
        return F.when(t == "", F.lit(f"Unknown {c}")).otherwise(t)

    key = F.col("file_name") if group_by == "none" else named(group_by)
    rows = base.withColumn("__key", key).withColumn("__unit", named(other))
    label_of_run = F.concat_ws(" / ", "task", F.when(F.col("suffix") != "", F.concat_ws(" ", "model", "suffix")).otherwise(F.col("model")))
    when = F.coalesce(-F.col("started").cast("double"), F.lit(float("inf")))
    best = F.min(F.struct(
        _rank_key(metric, F.col(metric).cast("double")).alias("k"), when.alias("t"), F.col("file_name"),
        label_of_run.alias("label"), F.col("ci_low").alias("lo"), F.col("ci_high").alias("hi"),
    ))
    shape = rows.groupBy("__key").agg(
        F.count("*").alias("count"),
        F.count_if(F.col("__price").isNull()).alias("unknown_price_count"),
        shared_suffix(F.col("suffix")).alias("__suffix"),
        best.alias("__best"),
    )
    balanced = balanced_aggregate(rows, ["__key"], "__unit", metric, "__price")
    if group_by == "model":
        label = F.when(F.col("__suffix") != "", F.concat_ws(" ", "__key", "__suffix")).otherwise(F.col("__key"))
    else:
        label = F.col("__best.label") if group_by == "none" else F.col("__key")
    single = F.col("count") == 1
    return (
        shape.join(balanced, "__key")
        .select(
            F.col("__key").alias("group_key"), label.alias("label"), "count", "unit_count", "unknown_price_count",
            (F.col("unknown_price_count") < F.col("count")).alias("has_known_price"), "price_value", "metric_value",
            F.when(single, F.col("__best.lo")).otherwise(F.col("ci_low")).alias("ci_low"),
            F.when(single, F.col("__best.hi")).otherwise(F.col("ci_high")).alias("ci_high"),
            F.col("__best.file_name").alias("representative"),
        )
        .orderBy("has_known_price", F.col("price_value").asc_nulls_first(), metric_order(metric, "metric_value"), "label")
    )


def profile_matrix(runs: DataFrame, metric: str, axis: str = "task", top: int | None = None, models: list[str] = ()) -> DataFrame:
    """Mean metric per model and task (or tag) with the mean of the axis means; a run counts under each of its tags.

    With ``top`` and no model selection only so many models by that mean are kept (a dashboard shows 8).
    """
    rows = runs.select("model", F.explode("tags").alias("axis"), metric) if axis == "tag" else runs.select("model", F.col("task").alias("axis"), metric)
    if models:
        rows = rows.filter(F.col("model").isin(*models))
    cells = rows.groupBy("model", "axis").agg(F.avg(numbers.finite(F.col(metric))).alias("value"))
    means = cells.groupBy("model").agg(F.avg("value").alias("model_mean")).filter(F.col("model_mean").isNotNull())
    if not models and top:
        means = means.orderBy(metric_order(metric, "model_mean"), "model").limit(top)
    return cells.join(means, "model")


def profile_ratios(matrix: DataFrame, metric: str, contrast: bool = False) -> DataFrame:
    """Profile cells scaled to 0..1; percentages against 100, kappa against -1..1, others against the largest value."""
    if metric in PERCENT:
        top = F.lit(100.0)
        return matrix.withColumn("ratio", numbers.profile_ratio(F.col("value"), top, metric, contrast))
    peak = matrix.agg(F.max("value").alias("axis_max")).scalar()
    return matrix.withColumn("ratio", numbers.profile_ratio(F.col("value"), peak, metric, contrast))


def token_profile(runs: DataFrame) -> DataFrame:
    """Average tokens per prediction by kind; 0 without predictions."""
    n = numbers.non_negative(prediction_count())
    kinds = {
        "input": F.col("input_tokens"),
        "cached": F.coalesce("cached_input_tokens", "cached_tokens"),
        "output": F.col("output_tokens"),
        "thinking": F.col("thinking_tokens"),
    }
    out = runs
    for kind, c in kinds.items():
        out = out.withColumn(f"avg_{kind}", F.when(n > 0, numbers.non_negative(c) / F.when(n > 0, n)).otherwise(0.0))
    total = F.col("avg_input") + F.col("avg_cached") + F.col("avg_output") + F.col("avg_thinking")
    return out.withColumn("avg_total", total)


def token_profile_order(name: str = "file_name") -> list[Column]:
    return [F.col("model").asc(), F.col("model_display").asc(), F.col("started").desc_nulls_last(), F.col(name).asc()]
