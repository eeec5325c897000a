"""Consistency of stored run metrics with their outputs and logs, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratewise.functions import names
from ratewise.functions.numbers import text_to_int
from ratewise.functions.text import blank_to_null

TOTALS_NOTE = "total_tokens - prompt_tokens (or completion_tokens + thinking_tokens fallback)"  # fixed value
REPAIRABLE = [
    "attempts_with_token_usage", "attempts_with_output_tokens", "input_tokens_total", "non_cached_input_tokens_total", "output_tokens_total",
]


def token_totals(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """Token sums of prediction rows; output is total minus prompt (not below 0), else completion."""
    p, c, t = (text_to_int(F.col(n).cast("string")) for n in ("prompt_tokens", "completion_tokens", "total_tokens"))
    r = rows.select(key, p.alias("p"), c.alias("c"), t.alias("t"))
    out = F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), F.greatest(F.col("t") - F.col("p"), F.lit(0))).otherwise(F.col("c"))
    zero = F.lit(0).cast("long")
    return r.withColumn("o", out).groupBy(key).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.coalesce("p", "c", "t").isNotNull()).alias("rows_with_token_usage"),
        F.count_if(F.col("o") > 0).alias("rows_with_output_tokens"),
        F.sum(F.coalesce("p", zero)).alias("prompt_tokens_total"),
        F.sum(F.coalesce("c", zero)).alias("completion_tokens_total"),
        F.sum(F.coalesce("t", zero)).alias("total_tokens_total"),
        F.sum(F.coalesce("o", zero)).alias("output_tokens_total"),
    )


def artifact_keys(metrics: DataFrame) -> DataFrame:
    """Adds ``stem``: name of the output a metrics file stems from, else its own base name."""
    output = blank_to_null(F.col("source_output_csv"))
    stem = F.when(output.isNotNull(), F.regexp_replace(names.file_name(output), r"(?<=.)\.[^.]*$", ""))
    return metrics.withColumn("stem", F.coalesce(stem, names.metrics_base(F.col("metrics_file"))))


def join_artifacts(metrics: DataFrame, csv_totals: DataFrame, log_totals: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Metrics next to the totals of their output and log, both keyed by ``stem``.

    Where names repeat, ``within`` lists columns that must be equal besides, such as the run; without it, every metrics file meets
    all outputs and logs of its name.
    """
    keys = [*(within or []), "stem"]
    csv = csv_totals.select(*keys, F.struct(*[c for c in csv_totals.columns if c not in keys]).alias("csv"))
    log = log_totals.select(*keys, F.struct(*[c for c in log_totals.columns if c not in keys]).alias("log"))
    return artifact_keys(metrics).join(csv, keys, "left").join(log, keys, "left")


def _numeric(code: str, label: str, stored: Column, derived: Column) -> Column:
    text = F.concat(F.lit(f"{label}: metrics="), stored.cast("string"), F.lit(", derived="), derived.cast("string"))
    return F.when(stored != derived, F.struct(F.lit(code).alias("code"), text.alias("detail")))


def _not_in(code: str, label: str, plural: str, value: Column, values: Column) -> Column:
    listed = F.concat(F.lit("['"), F.array_join(F.array_sort(values), "', '"), F.lit("']"))
    text = F.concat(F.lit(f"{label}="), value, F.lit(f", log {plural}="), listed)
    bad = (F.coalesce(value, F.lit("")) != "") & (F.size(values) > 0) & ~F.array_contains(values, value)
    return F.when(bad, F.struct(F.lit(code).alias("code"), text.alias("detail")))


def artifact_issues(joined: DataFrame) -> DataFrame:
    """One row per finding: missing files, numbers that differ, names the log does not know. Unknown numbers are skipped."""
    m = F.col
    rules = [
        F.when(m("csv").isNull(), F.struct(F.lit("missing_output_csv").alias("code"), F.lit("No output CSV could be resolved for this metrics file.").alias("detail"))),
        F.when(m("log").isNull(), F.struct(F.lit("missing_prompt_log").alias("code"), F.lit("No prompt log could be resolved for this metrics file.").alias("detail"))),
        _numeric("prediction_count_mismatch_csv_rows", "prediction_count vs output rows", m("prediction_count"), m("csv.row_count")),
        _numeric("attempts_with_token_usage_mismatch_csv", "attempts_with_token_usage vs rows with token columns", m("attempts_with_token_usage"), m("csv.rows_with_token_usage")),
        _numeric("input_tokens_total_mismatch_csv", "input_tokens_total vs CSV promptTokens sum", m("input_tokens_total"), m("csv.prompt_tokens_total")),
        _numeric("output_tokens_total_mismatch_csv", "output_tokens_total vs CSV-derived output token sum", m("output_tokens_total"), m("csv.output_tokens_total")),
        _numeric("attempts_total_mismatch_log", "request_control_summary.attempts_total vs prompt-log attempts", m("control_attempts_total"), m("log.attempts_total")),
        _numeric("usage_attempts_mismatch_log", "usage_metadata_summary.attempts_with_usage_metadata vs prompt-log attempts with usage", m("usage_attempts"), m("log.attempts_with_usage_metadata")),
        _not_in("provider_mismatch_log", "metrics provider", "providers", m("provider"), m("log.provider_values")),
        _not_in("model_requested_mismatch_log", "metrics model_requested", "models", m("model_requested"), m("log.model_values")),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return joined.select("metrics_file", F.explode(found).alias("i")).select("metrics_file", "i.*")


def backfill_totals(joined: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Token totals rebuilt from the output rows; cached and thinking tokens are kept. ``within``: see ``join_artifacts``."""
    have = joined.filter(F.col("csv").isNotNull())
    cached = F.coalesce("cached_input_tokens_total", F.lit(0).cast("long"))
    return have.select(
        *(within or []), "metrics_file",
        F.col("csv.rows_with_token_usage").alias("attempts_with_token_usage"),
        F.col("csv.rows_with_output_tokens").alias("attempts_with_output_tokens"),
        F.col("csv.prompt_tokens_total").alias("input_tokens_total"),
        cached.alias("cached_input_tokens_total"),
        F.greatest(F.col("csv.prompt_tokens_total") - cached, F.lit(0).cast("long")).alias("non_cached_input_tokens_total"),
        F.col("csv.output_tokens_total").alias("output_tokens_total"),
        F.coalesce("thinking_tokens_total", F.lit(0).cast("long")).alias("thinking_tokens_total"),
        F.lit(TOTALS_NOTE).alias("output_tokens_definition"),
    )


def repair_totals(joined: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Stored totals, replaced where a derived count is lower, with the reasons. ``within``: see ``join_artifacts``.

    Token totals change together as soon as one of them is too high; attempt totals one by one.
    """
    keys = [*(within or []), "metrics_file"]
    new = backfill_totals(joined, within)
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys])
    j = joined.join(renamed, keys, "left")
    lower = F.array(*[
        F.when(F.col(f"new_{c}") < F.col(c), F.concat(F.lit(f"{c}: metrics="), F.col(c).cast("string"), F.lit(", csv="), F.col(f"new_{c}").cast("string")))
        for c in REPAIRABLE
    ])
    j = j.withColumn("token_reasons", F.filter(lower, lambda x: x.isNotNull()))
    token = F.size("token_reasons") > 0
    for c in [*REPAIRABLE, "cached_input_tokens_total", "thinking_tokens_total"]:
        j = j.withColumn(c, F.when(token, F.col(f"new_{c}")).otherwise(F.col(c)))
    seen = F.col("log.attempts_total")
    sections = {
        "control_attempts_total": "request_control_summary.attempts_total",
        "usage_attempts_total": "usage_metadata_summary.attempts_total",
        "token_attempts_total": "token_usage_totals.attempts_total",
    }
    attempts = F.array(*[
        F.when(seen < F.col(c), F.concat(F.lit(f"{label}: metrics="), F.col(c).cast("string"), F.lit(", prompt_log="), seen.cast("string")))
        for c, label in sections.items()
    ])
    j = j.withColumn("attempt_reasons", F.filter(attempts, lambda x: x.isNotNull()))
    for c in sections:
        j = j.withColumn(c, F.when(seen < F.col(c), seen).otherwise(F.col(c)))
    reasons = F.concat("token_reasons", "attempt_reasons")
    return j.select(
        "metrics_file", *REPAIRABLE, *sections, F.array_join(reasons, "; ").alias("repair_reasons"), (F.size(reasons) > 0).alias("repaired"),
    )


def issue_counts(metrics: DataFrame, issues: DataFrame, repaired: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Files checked, files with findings, files repaired. Files of one name are told apart by ``within``, findings and repairs are not."""
    bad = issues.select("metrics_file").distinct().withColumn("bad", F.lit(True))
    fixed = repaired.filter("repaired").select("metrics_file").distinct().withColumn("fixed", F.lit(True))
    return metrics.select(*(within or []), "metrics_file").distinct().join(bad, "metrics_file", "left").join(fixed, "metrics_file", "left").agg(
        F.count("*").alias("files"), F.count("bad").alias("mismatched"), F.count("fixed").alias("repaired")
    )


def issue_report(issues: DataFrame, top: int) -> DataFrame:
    """Most frequent findings."""
    return issues.groupBy("code").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "code").limit(top)
