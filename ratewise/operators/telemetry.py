"""Request attempts: per-run counters, errors, active time, cache and control totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratewise.operators.quantiles import exact_quantiles

TIMEOUT = "request_timeout"
TIMEOUT_ACCEPTED = "accepted_after_request_timeout"


def attempt_telemetry(attempts: DataFrame, run: str = "run_id", example: str = "example_id") -> DataFrame:
    """Durations and outcomes per run.

    Two aggregations: examples first (so that an example with several timeouts counts once), then runs.
    """
    is_ok, is_error = F.col("status") == "success", F.col("status") == "error"
    is_timeout = is_error & F.col("error_category").eqNullSafe(TIMEOUT)
    seconds = F.col("duration_seconds")
    per_example = attempts.groupBy(run, example).agg(
        F.count(seconds).alias("n"), F.sum(seconds).alias("s"),
        F.count(F.when(is_ok, seconds)).alias("ok_n"), F.sum(F.when(is_ok, seconds)).alias("ok_s"),
        F.count(F.when(is_timeout, seconds)).alias("to_n"), F.sum(F.when(is_timeout, seconds)).alias("to_s"),
        F.count_if(is_ok).alias("ok"), F.count_if(is_error).alias("err"), F.count_if(is_timeout).alias("timeouts"),
        F.coalesce(F.bool_or(F.col("validator_status") == TIMEOUT_ACCEPTED), F.lit(False)).alias("final"),
    )
    counts = per_example.groupBy(run).agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("attempt_mean_seconds"),
        F.try_divide(F.sum("ok_s"), F.sum("ok_n")).alias("success_mean_seconds"),
        F.try_divide(F.sum("to_s"), F.sum("to_n")).alias("timeout_mean_seconds"),
        F.sum("ok").alias("success_attempts"),
        F.sum("err").alias("error_attempts"),
        F.sum("timeouts").alias("timeout_attempts"),
        (F.sum("err") - F.sum("timeouts")).alias("non_timeout_error_attempts"),
        F.count_if((F.col("timeouts") > 0) | F.col("final")).alias("timeout_examples"),
        F.count_if("final").alias("final_timeout_examples"),
        F.count("*").alias("log_example_records"),
    )
    medians = exact_quantiles(attempts, [run], "duration_seconds", {"attempt_median_seconds": 0.5}).drop("n")
    return counts.join(medians, run, "left")


def error_summary(attempts: DataFrame, run: str = "run_id") -> DataFrame:
    """Attempts per run, outcome and error category."""
    return attempts.groupBy(run, "status", F.coalesce("error_category", F.lit("")).alias("error_category")).agg(
        F.count("*").alias("attempts")
    )


def failing_examples(attempts: DataFrame, top: int, run: str = "run_id", example: str = "example_id") -> DataFrame:
    """Report of the examples with most failed attempts."""
    failed = attempts.filter(F.col("status") == "error").groupBy(run, example).agg(
        F.count("*").alias("errors"), F.array_join(F.array_sort(F.collect_set("error_category")), ", ").alias("categories")
    )
    return failed.orderBy(F.desc("errors"), run, example).limit(top)


def active_time(attempts: DataFrame, run: str = "run_id", invocation: str = "invocation") -> DataFrame:
    """First-to-last time within each invocation, summed: idle time between invocations does not count."""
    spans = attempts.groupBy(run, invocation).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    seconds = F.col("hi").cast("double") - F.col("lo").cast("double")
    return spans.groupBy(run).agg(
        F.sum(seconds).alias("overall_time_seconds"),
        F.min("lo").alias("first_prompt"),
        F.max("hi").alias("last_prompt"),
        F.count("*").alias("invocations"),
    )


def active_time_by_gap(attempts: DataFrame, gap: str, run: str = "run_id") -> DataFrame:
    """Active time where invocations are not marked: a pause longer than ``gap`` ends one."""
    sessions = attempts.groupBy(run, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    seconds = F.col("hi").cast("double") - F.col("lo").cast("double")
    return sessions.groupBy(run).agg(F.sum(seconds).alias("overall_time_seconds"), F.count("*").alias("invocations"))


def cache_totals(attempts: DataFrame, run: str = "run_id") -> DataFrame:
    """Cached and written tokens over the responses of a run."""
    return attempts.groupBy(run).agg(
        F.sum(F.coalesce("cached_tokens", F.lit(0).cast("long"))).alias("cached_tokens_total"),
        F.sum(F.coalesce("cache_write_tokens", F.lit(0).cast("long"))).alias("cache_write_tokens_total"),
        F.count("cached_tokens").alias("responses_with_cache_data"),
    )


def control_acceptance(controls: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and control: attempts that asked for it, and that had it applied."""
    return controls.groupBy(run, "control").agg(
        F.count("requested").alias("requested"),
        F.count_if(F.col("requested").isNotNull() & F.col("applied").eqNullSafe(F.col("requested"))).alias("accepted"),
    )


def log_totals(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Totals of a prompt log: records ``run_id, record_type, attempts array, provider, model``.

    Attempts count from every record that has a list of them, example records only from example results.
    """
    has_list = F.col("attempts").isNotNull()
    meta = F.col("record_type") == "run_metadata"

    def named(c: str):
        return F.array_sort(F.collect_set(F.when(meta & (F.trim(c) != ""), F.trim(c))))

    n = F.coalesce(F.size("attempts"), F.lit(0))
    ok = F.coalesce(F.size(F.filter("attempts", lambda a: a["status"] == "success")), F.lit(0))
    used = F.coalesce(F.size(F.filter("attempts", lambda a: a["has_usage"])), F.lit(0))
    zero = F.lit(0)
    return records.groupBy(run).agg(
        F.count_if(has_list & (F.col("record_type") == "example_result")).alias("example_records"),
        F.sum(F.when(has_list, n).otherwise(zero)).alias("attempts_total"),
        F.sum(F.when(has_list, used).otherwise(zero)).alias("attempts_with_usage_metadata"),
        F.sum(F.when(has_list, ok).otherwise(zero)).alias("success_attempts"),
        named("provider").alias("provider_values"),
        named("model").alias("model_values"),
    )
