"""Queries on attempt logs and on repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions import names
from ratewise.operators import repeated, telemetry
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import ATTEMPTS, PREDICTIONS, RUNS, SCORES, with_views
from ratewise.plans.registry import query
from ratewise.plans.scores import rd, rounded, scores_of
from ratewise.session import cut_lineage

TELEMETRY = """
examples AS (SELECT run_id, example_id, bool_or(status = 'error' AND error_category = 'request_timeout') AS timed_out,
    bool_or(coalesce(validator_status = 'accepted_after_request_timeout', false)) AS final FROM attempts GROUP BY ALL),
example_counts AS (SELECT run_id, count(*) FILTER (WHERE coalesce(timed_out, false) OR final) AS timeout_examples,
    count(*) FILTER (WHERE final) AS final_timeout_examples, count(*) AS log_example_records FROM examples GROUP BY ALL),
telemetry AS (SELECT run_id, avg(duration_seconds) AS attempt_mean_seconds, median(duration_seconds) AS attempt_median_seconds,
    avg(duration_seconds) FILTER (WHERE status = 'success') AS success_mean_seconds,
    avg(duration_seconds) FILTER (WHERE status = 'error' AND error_category = 'request_timeout') AS timeout_mean_seconds,
    count(*) FILTER (WHERE status = 'success') AS success_attempts, count(*) FILTER (WHERE status = 'error') AS error_attempts,
    count(*) FILTER (WHERE status = 'error' AND error_category = 'request_timeout') AS timeout_attempts,
    count(*) FILTER (WHERE status = 'error' AND error_category <> 'request_timeout') AS non_timeout_error_attempts,
    max(timeout_examples) AS timeout_examples, max(final_timeout_examples) AS final_timeout_examples, max(log_example_records) AS log_example_records
  FROM attempts JOIN example_counts USING (run_id) GROUP BY run_id),
active AS (SELECT run_id, sum(epoch(hi) - epoch(lo)) AS overall_time_seconds, min(lo) AS first_prompt, max(hi) AS last_prompt, count(*) AS invocations
  FROM (SELECT run_id, invocation, min(ts) AS lo, max(ts) AS hi FROM attempts GROUP BY ALL) GROUP BY run_id)"""

# Repeated-run table: scores, times and counters per run; every ninth run has no accuracy.
REPEAT_RUNS = """
run_table AS (
  SELECT r.run_id, run_stem AS base_name, task, provider, model, evaluated, overall_time_seconds,
    CASE WHEN r.run_id % 9 <> 4 THEN accuracy END AS accuracy,
    strftime(started + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M+02:00') AS local_minute, strftime(started + INTERVAL 2 HOUR, '%Y-%m-%d') AS local_date,
    CAST(hour(started + INTERVAL 2 HOUR) AS INTEGER) AS local_hour,
    CASE WHEN hour(started + INTERVAL 2 HOUR) <= 5 THEN '00-05' WHEN hour(started + INTERVAL 2 HOUR) <= 11 THEN '06-11'
         WHEN hour(started + INTERVAL 2 HOUR) <= 17 THEN '12-17' ELSE '18-23' END AS hour_bucket,
    overall_time_seconds / evaluated AS runtime_per_example_seconds, attempt_mean_seconds, t.run_id IS NOT NULL AS has_log,
    coalesce(timeout_examples, 0) AS timeout_examples, coalesce(timeout_attempts, 0) AS timeout_attempts, coalesce(final_timeout_examples, 0) AS final_timeout_examples
  FROM runs r JOIN scores s USING (run_id) LEFT JOIN telemetry t USING (run_id) LEFT JOIN active a USING (run_id)),
repeated AS (SELECT * FROM run_table SEMI JOIN (SELECT task, provider, model FROM run_table GROUP BY ALL HAVING count(*) >= 2) USING (task, provider, model))"""

VIEWS = (PREDICTIONS, SCORES, RUNS, ATTEMPTS, TELEMETRY, REPEAT_RUNS)


def telemetry_of(spark, sf_dir):
    return telemetry.attempt_telemetry(fx.attempts(spark, sf_dir))


def run_table(spark, sf_dir):
    scores = scores_of(spark, sf_dir).select("run_id", "evaluated", "accuracy")
    times = telemetry.active_time(fx.attempts(spark, sf_dir)).select("run_id", "overall_time_seconds")
    runs = fx.runs(spark, sf_dir).withColumnRenamed("run_stem", "base_name").join(scores, "run_id").join(times, "run_id", "left")
    runs = runs.withColumn("accuracy", F.when(F.col("run_id") % 9 != 4, F.col("accuracy")))
    table = repeated.with_runtime(repeated.with_local_time(repeated.join_telemetry(runs, telemetry_of(spark, sf_dir), "run_id")))
    # One row per run, read several times by what follows: written once instead of counted again.
    return cut_lineage(table, "runs")


@query(
    "attempt_telemetry", "A11",
    with_views(ATTEMPTS, TELEMETRY, select=f"""
SELECT run_id, {rd('attempt_mean_seconds')} AS attempt_mean_seconds, {rd('attempt_median_seconds')} AS attempt_median_seconds,
  {rd('success_mean_seconds')} AS success_mean_seconds, {rd('timeout_mean_seconds')} AS timeout_mean_seconds, success_attempts, error_attempts,
  timeout_attempts, non_timeout_error_attempts, timeout_examples, final_timeout_examples, log_example_records FROM telemetry"""),
)
def attempt_telemetry(spark, sf_dir):
    return rounded(telemetry_of(spark, sf_dir))


@query(
    "attempt_errors", "A32",
    with_views(ATTEMPTS, select="""
SELECT run_id, status, coalesce(error_category, '') AS error_category, count(*) AS attempts FROM attempts GROUP BY ALL"""),
)
def attempt_errors(spark, sf_dir):
    return telemetry.error_summary(fx.attempts(spark, sf_dir))


@query(
    "failing_examples", "A32 S19",
    with_views(ATTEMPTS, select="""
SELECT run_id, example_id, count(*) AS errors, string_agg(DISTINCT error_category, ', ' ORDER BY error_category) AS categories
FROM attempts WHERE status = 'error' GROUP BY run_id, example_id ORDER BY errors DESC, run_id, example_id LIMIT 20"""),
)
def failing_examples(spark, sf_dir):
    return telemetry.failing_examples(fx.attempts(spark, sf_dir), 20)


@query(
    "active_time", "A33",
    with_views(ATTEMPTS, TELEMETRY, select=f"""
SELECT run_id, {rd('overall_time_seconds')} AS overall_time_seconds, strftime(first_prompt, '%Y-%m-%d %H:%M:%S') AS first_prompt,
  strftime(last_prompt, '%Y-%m-%d %H:%M:%S') AS last_prompt, invocations FROM active"""),
)
def active_time(spark, sf_dir):
    out = telemetry.active_time(fx.attempts(spark, sf_dir))
    for c in ("first_prompt", "last_prompt"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return rounded(out)


@query(
    "active_time_by_gap", "A33",
    with_views(ATTEMPTS, select=f"""
, marked AS (SELECT run_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM attempts),
sessions AS (SELECT run_id, ts, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
spans AS (SELECT run_id, s, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM sessions GROUP BY ALL)
SELECT run_id, {rd('sum(seconds)')} AS overall_time_seconds, count(*) AS invocations FROM spans GROUP BY run_id"""),
)
def active_time_by_gap(spark, sf_dir):
    return rounded(telemetry.active_time_by_gap(fx.attempts(spark, sf_dir), "12 hours"))


@query(
    "cache_totals", "A40",
    with_views(ATTEMPTS, select="""
SELECT run_id, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens_total,
  CAST(sum(CASE WHEN cached_tokens % 2 = 0 THEN cached_tokens // 2 ELSE 0 END) AS BIGINT) AS cache_write_tokens_total,
  count(cached_tokens) AS responses_with_cache_data FROM attempts GROUP BY run_id"""),
)
def cache_totals(spark, sf_dir):
    a = fx.attempts(spark, sf_dir)
    half = F.when(F.col("cached_tokens") % 2 == 0, F.floor(F.col("cached_tokens") / 2))
    return telemetry.cache_totals(a.withColumn("cache_write_tokens", half))


@query(
    "control_acceptance", "A41",
    with_views(ATTEMPTS, select="""
, controls AS (
  SELECT run_id, 'effort' AS control, CASE cached_tokens % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS requested,
         CASE WHEN cached_tokens % 2 = 0 THEN 'high' ELSE 'low' END AS applied FROM attempts
  UNION ALL SELECT run_id, 'thinking_level', CASE WHEN cached_tokens > 40 THEN 'on' END, CASE WHEN status = 'success' THEN 'on' END FROM attempts)
SELECT run_id, control, count(requested) AS requested, count(*) FILTER (WHERE requested = applied) AS accepted FROM controls GROUP BY ALL"""),
)
def control_acceptance(spark, sf_dir):
    a = fx.attempts(spark, sf_dir)
    k = F.col("cached_tokens")
    effort = F.struct(
        F.lit("effort").alias("control"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "high").alias("requested"),
        F.when(k % 2 == 0, "high").otherwise("low").alias("applied"),
    )
    thinking = F.struct(
        F.lit("thinking_level").alias("control"), F.when(k > 40, "on").alias("requested"), F.when(F.col("status") == "success", "on").alias("applied")
    )
    return telemetry.control_acceptance(a.select("run_id", F.explode(F.array(effort, thinking)).alias("c")).select("run_id", "c.*"))


@query(
    "repeated_groups", "A10",
    with_views(RUNS, select="SELECT task, provider, model, count(*) AS run_count FROM runs GROUP BY ALL HAVING count(*) >= 2"),
)
def repeated_groups(spark, sf_dir):
    return repeated.repeated_groups(fx.runs(spark, sf_dir))


DETAIL_COLUMNS = ["task", "provider", "model", "base_name", "local_minute", "local_date", "local_hour", "hour_bucket", "accuracy",
                  "accuracy_delta_vs_group_mean", "accuracy_drop_vs_group_best", "overall_time_seconds", "runtime_per_example_seconds"]


@query(
    "repeated_run_details", "W1 O11 P15 P16 P27 J1 S18",
    with_views(*VIEWS, select=f"""
SELECT task, provider, model, base_name, local_minute, local_date, local_hour, hour_bucket, {rd('accuracy')} AS accuracy,
  {rd('accuracy - avg(accuracy) OVER g')} AS accuracy_delta_vs_group_mean, {rd('max(accuracy) OVER g - accuracy')} AS accuracy_drop_vs_group_best,
  {rd('overall_time_seconds')} AS overall_time_seconds, {rd('runtime_per_example_seconds')} AS runtime_per_example_seconds
FROM repeated WINDOW g AS (PARTITION BY task, provider, model)"""),
)
def repeated_run_details(spark, sf_dir):
    return rounded(repeated.details_order(repeated.details(run_table(spark, sf_dir))).select(*DETAIL_COLUMNS))


@query(
    "repeated_group_summary", "A12 S18",
    with_views(*VIEWS, select=f"""
SELECT task, provider, model, count(*) AS run_count, {rd('min(accuracy)')} AS accuracy_min, {rd('max(accuracy)')} AS accuracy_max,
  {rd('CASE WHEN count(accuracy) >= 2 THEN max(accuracy) - min(accuracy) END')} AS accuracy_spread,
  {rd('min(overall_time_seconds)')} AS runtime_min_seconds, {rd('max(overall_time_seconds)')} AS runtime_max_seconds,
  {rd('CASE WHEN count(overall_time_seconds) >= 2 THEN max(overall_time_seconds) - min(overall_time_seconds) END')} AS runtime_spread_seconds,
  max(timeout_examples) AS max_timeout_examples, max(final_timeout_examples) AS max_final_timeout_examples,
  count(*) FILTER (WHERE has_log) AS runs_with_log_telemetry
FROM repeated GROUP BY ALL"""),
)
def repeated_group_summary(spark, sf_dir):
    return rounded(repeated.group_summary(run_table(spark, sf_dir)))


def correlation_sql() -> str:
    parts = []
    for m in repeated.CORRELATES:
        parts.append(f"""
SELECT '{m}' AS metric, count(*) AS points, corr(dy, dx) AS correlation FROM (
  SELECT accuracy - avg(accuracy) OVER g AS dy, {m} - avg({m}) OVER g AS dx, count(*) OVER g AS n FROM repeated
  WHERE accuracy IS NOT NULL AND {m} IS NOT NULL WINDOW g AS (PARTITION BY task, provider, model)) WHERE n >= 2""")
    return " UNION ALL ".join(parts)


@query(
    "within_group_correlations", "A13",
    with_views(*VIEWS, select=f"SELECT metric, points, {rd('correlation')} AS correlation FROM ({correlation_sql()})"),
)
def within_group_correlations(spark, sf_dir):
    return rounded(repeated.within_group_correlations(run_table(spark, sf_dir)))


@query(
    "hour_bucket_deltas", "A14 P16",
    with_views(*VIEWS, select=f"""
, d AS (SELECT hour_bucket, accuracy - avg(accuracy) OVER g AS delta, count(*) OVER g AS n FROM repeated WHERE accuracy IS NOT NULL
  WINDOW g AS (PARTITION BY task, provider, model))
SELECT b AS hour_bucket, count(delta) AS n, {rd('avg(delta)')} AS mean_delta, {rd('min(delta)')} AS min_delta, {rd('max(delta)')} AS max_delta
FROM (SELECT unnest(['00-05', '06-11', '12-17', '18-23']) AS b) LEFT JOIN (SELECT * FROM d WHERE n >= 2) ON b = hour_bucket GROUP BY b"""),
)
def hour_bucket_deltas(spark, sf_dir):
    return rounded(repeated.hour_bucket_deltas(run_table(spark, sf_dir)))


WORST_SQL = """
, valid AS (SELECT *, count(*) OVER (PARTITION BY task, provider, model) AS n, max(accuracy) OVER (PARTITION BY task, provider, model) AS best FROM repeated WHERE accuracy IS NOT NULL),
worst AS (SELECT *, best - accuracy AS fall FROM valid WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY task, provider, model ORDER BY accuracy, base_name) = 1)
"""


@query(
    "worst_runs", "W3",
    with_views(*VIEWS, select=WORST_SQL + f"""
SELECT task, provider, model, base_name, {rd('accuracy')} AS accuracy, local_date, {rd('fall')} AS drop FROM worst"""),
)
def worst_runs(spark, sf_dir):
    return rounded(repeated.worst_runs(run_table(spark, sf_dir)))


@query(
    "bad_days", "A15 W11 O5",
    with_views(*VIEWS, select=WORST_SQL + f"""
, firsts AS (SELECT task, provider, model, min(base_name) AS first_name FROM repeated GROUP BY ALL),
per_task AS (SELECT task, count(*) AS repeated_groups FROM firsts GROUP BY task),
days AS (SELECT task, local_date, count(*) AS c, avg(fall) AS mean_fall, max(fall) AS max_fall, min(first_name) AS seen,
    sum(count(*)) OVER (PARTITION BY task) AS total FROM worst JOIN firsts USING (task, provider, model) GROUP BY task, local_date)
SELECT task, repeated_groups, CAST(total AS BIGINT) AS groups_with_valid_comparison, local_date AS dominant_worst_date, c AS dominant_worst_group_count,
  {rd('c / total')} AS dominant_worst_group_share, {rd('mean_fall')} AS mean_drop_on_dominant_date, {rd('max_fall')} AS max_drop_on_dominant_date
FROM days JOIN per_task USING (task) WHERE repeated_groups >= 2 AND total >= 2
QUALIFY row_number() OVER (PARTITION BY task ORDER BY c DESC, seen) = 1"""),
)
def bad_days(spark, sf_dir):
    return rounded(repeated.bad_day_report(repeated.bad_days(run_table(spark, sf_dir))))


@query(
    "outlier_report", "W2 O5 S19",
    with_views(*VIEWS, select=f"""
, valid AS (SELECT *, count(*) OVER (PARTITION BY task, provider, model) AS n FROM repeated WHERE accuracy IS NOT NULL),
o AS (SELECT *, first_value(accuracy) OVER w AS best, first_value(local_minute) OVER w AS best_time FROM valid WHERE n >= 2
  WINDOW w AS (PARTITION BY task, provider, model ORDER BY accuracy DESC, base_name))
SELECT task, provider, model, base_name, local_minute, {rd('accuracy')} AS accuracy, {rd('best - accuracy')} AS accuracy_drop_vs_group_best,
  {rd('best')} AS group_best_accuracy, best_time AS best_run_timestamp
FROM o ORDER BY best - accuracy DESC, task, provider, model, base_name LIMIT 12"""),
)
def outlier_report(spark, sf_dir):
    rows = repeated.outlier_report(repeated.outliers(run_table(spark, sf_dir)))
    return rounded(rows.select(
        "task", "provider", "model", "base_name", "local_minute", "accuracy", "accuracy_drop_vs_group_best", "group_best_accuracy", "best_run_timestamp"
    ))


@query(
    "provider_mismatches", "P40 P3 P18",
    with_views(RUNS, select="""
SELECT run_stem, split_part(run_stem, '__', 2) AS file_provider, upper(CASE WHEN run_id % 4 = 0 THEN 'other' ELSE ' LAB-' || (run_id % 2) END) AS provider
FROM runs WHERE run_id % 4 = 0"""),
)
def provider_mismatches(spark, sf_dir):
    r = fx.runs(spark, sf_dir)
    stated = F.upper(F.when(F.col("run_id") % 4 == 0, "other").otherwise(F.concat(F.lit(" LAB-"), (F.col("run_id") % 2).cast("string"))))
    table = r.select("run_stem", names.split_stem_from_right(F.col("run_stem"))["provider"].alias("file_provider"), stated.alias("provider"))
    return repeated.provider_mismatches(table, "file_provider", "provider")
