"""Queries on consistency checks, repairs and resumed runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.operators import quality, resume, telemetry
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import ATTEMPTS, PREDICTIONS, RUNS, TOKENS, with_views
from ratewise.plans.registry import query
from ratewise.session import cut_lineage

CSV = """
csv AS (SELECT run_id, count(*) AS row_count, count(coalesce(prompt_tokens, completion_tokens, total_tokens)) AS rows_with_token_usage,
    count(*) FILTER (WHERE o > 0) AS rows_with_output_tokens, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens_total,
    CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens_total, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens_total,
    CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens_total
  FROM (SELECT *, CASE WHEN total_tokens IS NOT NULL AND prompt_tokens IS NOT NULL THEN greatest(total_tokens - prompt_tokens, 0) ELSE completion_tokens END AS o FROM tokens) GROUP BY run_id)"""

LOG = """
log AS (SELECT run_id, count(DISTINCT example_id) AS example_records, count(*) AS attempts_total, count(*) FILTER (WHERE cached_tokens % 2 = 0) AS attempts_with_usage_metadata,
    count(*) FILTER (WHERE status = 'success') AS success_attempts, 'lab' || (run_id % 2) AS provider, 'm' || (run_id % 3) AS model FROM attempts GROUP BY run_id)"""

# Stored metrics: the derived numbers with errors in some runs and gaps in others.
METRICS = """
metrics AS (SELECT run_id, run_stem || '__metrics.json' AS metrics_file, run_id % 10 <> 7 AS has_csv, run_id % 10 <> 8 AND l.run_id IS NOT NULL AS has_log,
    row_count + CASE WHEN run_id % 5 = 1 THEN 1 ELSE 0 END AS prediction_count,
    CASE WHEN run_id % 9 <> 0 THEN rows_with_token_usage + CASE WHEN run_id % 11 = 3 THEN 2 ELSE 0 END END AS attempts_with_token_usage,
    rows_with_output_tokens AS attempts_with_output_tokens, prompt_tokens_total + CASE run_id % 6 WHEN 2 THEN 10 WHEN 3 THEN -10 ELSE 0 END AS input_tokens_total,
    prompt_tokens_total - 100 AS non_cached_input_tokens_total, CAST(CASE WHEN run_id % 2 = 0 THEN 100 ELSE 50 END AS BIGINT) AS cached_input_tokens_total,
    output_tokens_total, run_id AS thinking_tokens_total, attempts_total + CASE WHEN run_id % 4 = 3 THEN 1 ELSE 0 END AS control_attempts_total,
    attempts_with_usage_metadata - CASE WHEN run_id % 4 = 2 THEN 1 ELSE 0 END AS usage_attempts, attempts_total + 1 AS usage_attempts_total, attempts_total AS token_attempts_total,
    'lab' || (run_id % 2) AS m_provider, 'm' || (run_id % 2) AS m_model, c.*, l.* EXCLUDE (run_id)
  FROM runs JOIN csv c USING (run_id) LEFT JOIN log l USING (run_id))"""

VIEWS = (TOKENS, RUNS, ATTEMPTS, CSV, LOG, METRICS)


@query("token_totals", "A21 P11", with_views(TOKENS, CSV, select="SELECT * FROM csv"))
def token_totals(spark, sf_dir):
    return quality.token_totals(fx.tokens(spark, sf_dir))


def log_of(spark, sf_dir):
    """Totals of logs rebuilt as records: one per example with its attempts, and one with the run's names."""
    a = fx.attempts(spark, sf_dir)
    one = F.struct("status", (F.col("cached_tokens") % 2 == 0).alias("has_usage"))
    none = F.lit(None).cast("string")
    examples = a.groupBy("run_id", "example_id").agg(F.collect_list(one).alias("attempts")).select(
        "run_id", F.lit("example_result").alias("record_type"), "attempts", none.alias("provider"), none.alias("model")
    )
    meta = a.select("run_id").distinct().select(
        "run_id", F.lit("run_metadata").alias("record_type"), F.lit(None).cast(examples.schema["attempts"].dataType).alias("attempts"),
        F.concat(F.lit(" lab"), (F.col("run_id") % 2).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("run_id") % 3).cast("string")).alias("model"),
    )
    return telemetry.log_totals(examples.unionByName(meta))


@query(
    "log_totals", "A22",
    with_views(ATTEMPTS, LOG, select="SELECT run_id, example_records, attempts_total, attempts_with_usage_metadata, success_attempts, provider AS providers, model AS models FROM log"),
)
def log_totals(spark, sf_dir):
    t = log_of(spark, sf_dir)
    return t.select(
        "run_id", "example_records", "attempts_total", "attempts_with_usage_metadata", "success_attempts",
        F.array_join("provider_values", ",").alias("providers"), F.array_join("model_values", ",").alias("models"),
    ).select("*").withColumns({c: F.col(c).cast("long") for c in ("attempts_total", "attempts_with_usage_metadata", "success_attempts")})


RUN = ["run_id"]


def joined(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).select("run_id", "run_stem")
    csv, log = quality.token_totals(fx.tokens(spark, sf_dir)), log_of(spark, sf_dir)
    run = F.col("run_id")
    base = runs.join(csv, "run_id").join(log, "run_id", "left")
    plus = lambda c, cond, n: F.col(c) + F.when(cond, n).otherwise(0)
    metrics = base.select(
        "run_id", F.concat("run_stem", F.lit("__metrics.json")).alias("metrics_file"),
        F.when(run % 4 == 0, F.concat(F.lit("data/output/"), "run_stem", F.lit(".csv"))).otherwise(" ").alias("source_output_csv"),
        plus("row_count", run % 5 == 1, 1).alias("prediction_count"),
        F.when(run % 9 != 0, plus("rows_with_token_usage", run % 11 == 3, 2)).alias("attempts_with_token_usage"),
        F.col("rows_with_output_tokens").alias("attempts_with_output_tokens"),
        (F.col("prompt_tokens_total") + F.when(run % 6 == 2, 10).when(run % 6 == 3, -10).otherwise(0)).alias("input_tokens_total"),
        (F.col("prompt_tokens_total") - 100).alias("non_cached_input_tokens_total"),
        F.when(run % 2 == 0, 100).otherwise(50).cast("long").alias("cached_input_tokens_total"),
        "output_tokens_total", run.alias("thinking_tokens_total"),
        plus("attempts_total", run % 4 == 3, 1).alias("control_attempts_total"),
        (F.col("attempts_with_usage_metadata") - F.when(run % 4 == 2, 1).otherwise(0)).alias("usage_attempts"),
        (F.col("attempts_total") + 1).alias("usage_attempts_total"), F.col("attempts_total").alias("token_attempts_total"),
        F.concat(F.lit("lab"), (run % 2).cast("string")).alias("provider"), F.concat(F.lit("m"), (run % 2).cast("string")).alias("model_requested"),
    )
    stems = runs.withColumnRenamed("run_stem", "stem")
    csv_side = csv.filter("run_id % 10 <> 7").join(stems, "run_id")
    log_side = log.filter("run_id % 10 <> 8").join(stems, "run_id")
    # Many runs share a name, since it holds no key.
    return quality.join_artifacts(metrics, csv_side, log_side, RUN)


ISSUES = """
issues AS (
  SELECT metrics_file, 'missing_output_csv' AS code, 'No output CSV could be resolved for this metrics file.' AS detail FROM metrics WHERE NOT has_csv
  UNION ALL SELECT metrics_file, 'missing_prompt_log', 'No prompt log could be resolved for this metrics file.' FROM metrics WHERE NOT has_log
  UNION ALL SELECT metrics_file, 'prediction_count_mismatch_csv_rows', 'prediction_count vs output rows: metrics=' || prediction_count || ', derived=' || row_count FROM metrics WHERE has_csv AND prediction_count <> row_count
  UNION ALL SELECT metrics_file, 'attempts_with_token_usage_mismatch_csv', 'attempts_with_token_usage vs rows with token columns: metrics=' || attempts_with_token_usage || ', derived=' || rows_with_token_usage FROM metrics WHERE has_csv AND attempts_with_token_usage <> rows_with_token_usage
  UNION ALL SELECT metrics_file, 'input_tokens_total_mismatch_csv', 'input_tokens_total vs CSV promptTokens sum: metrics=' || input_tokens_total || ', derived=' || prompt_tokens_total FROM metrics WHERE has_csv AND input_tokens_total <> prompt_tokens_total
  UNION ALL SELECT metrics_file, 'attempts_total_mismatch_log', 'request_control_summary.attempts_total vs prompt-log attempts: metrics=' || control_attempts_total || ', derived=' || attempts_total FROM metrics WHERE has_log AND control_attempts_total <> attempts_total
  UNION ALL SELECT metrics_file, 'usage_attempts_mismatch_log', 'usage_metadata_summary.attempts_with_usage_metadata vs prompt-log attempts with usage: metrics=' || usage_attempts || ', derived=' || attempts_with_usage_metadata FROM metrics WHERE has_log AND usage_attempts <> attempts_with_usage_metadata
  UNION ALL SELECT metrics_file, 'model_requested_mismatch_log', 'metrics model_requested=' || m_model || ', log models=[''' || model || ''']' FROM metrics WHERE has_log AND m_model <> model)"""


@query("artifact_issues", "D1 D2 D3 J3", with_views(*VIEWS, ISSUES, select="SELECT * FROM issues"))
def artifact_issues(spark, sf_dir):
    return quality.artifact_issues(joined(spark, sf_dir))


@query(
    "issue_report", "S19 D1",
    with_views(*VIEWS, ISSUES, select="SELECT code, count(*) AS files FROM issues GROUP BY code ORDER BY files DESC, code LIMIT 5"),
)
def issue_report(spark, sf_dir):
    return quality.issue_report(quality.artifact_issues(joined(spark, sf_dir)), 5)


@query(
    "backfilled_totals", "D4",
    with_views(*VIEWS, select="""
SELECT metrics_file, rows_with_token_usage AS attempts_with_token_usage, rows_with_output_tokens AS attempts_with_output_tokens, prompt_tokens_total AS input_tokens_total,
  cached_input_tokens_total, greatest(prompt_tokens_total - cached_input_tokens_total, 0) AS non_cached_input_tokens_total, output_tokens_total, thinking_tokens_total
FROM metrics WHERE has_csv"""),
)
def backfilled_totals(spark, sf_dir):
    return quality.backfill_totals(joined(spark, sf_dir)).drop("output_tokens_definition")


REPAIRS = """
checked AS (SELECT *, greatest(prompt_tokens_total - cached_input_tokens_total, 0) AS new_non_cached FROM metrics),
reasons AS (SELECT *, CASE WHEN has_csv THEN concat_ws('; ',
    CASE WHEN rows_with_token_usage < attempts_with_token_usage THEN 'attempts_with_token_usage: metrics=' || attempts_with_token_usage || ', csv=' || rows_with_token_usage END,
    CASE WHEN prompt_tokens_total < input_tokens_total THEN 'input_tokens_total: metrics=' || input_tokens_total || ', csv=' || prompt_tokens_total END,
    CASE WHEN new_non_cached < non_cached_input_tokens_total THEN 'non_cached_input_tokens_total: metrics=' || non_cached_input_tokens_total || ', csv=' || new_non_cached END) ELSE '' END AS token_reasons,
  CASE WHEN has_log THEN concat_ws('; ',
    CASE WHEN attempts_total < control_attempts_total THEN 'request_control_summary.attempts_total: metrics=' || control_attempts_total || ', prompt_log=' || attempts_total END,
    'usage_metadata_summary.attempts_total: metrics=' || usage_attempts_total || ', prompt_log=' || attempts_total) ELSE '' END AS attempt_reasons FROM checked),
repairs AS (SELECT metrics_file, concat_ws('; ', nullif(token_reasons, ''), nullif(attempt_reasons, '')) AS repair_reasons,
  CASE WHEN token_reasons <> '' THEN prompt_tokens_total ELSE input_tokens_total END AS input_tokens_total,
  CASE WHEN token_reasons <> '' THEN new_non_cached ELSE non_cached_input_tokens_total END AS non_cached_input_tokens_total,
  CASE WHEN token_reasons <> '' THEN rows_with_token_usage ELSE attempts_with_token_usage END AS attempts_with_token_usage,
  CASE WHEN has_log AND attempts_total < control_attempts_total THEN attempts_total ELSE control_attempts_total END AS control_attempts_total FROM reasons)"""


@query("repaired_totals", "D5 S20", with_views(*VIEWS, REPAIRS, select="SELECT *, repair_reasons <> '' AS repaired FROM repairs"))
def repaired_totals(spark, sf_dir):
    return quality.repair_totals(joined(spark, sf_dir), RUN).select(
        "metrics_file", "repair_reasons", "input_tokens_total", "non_cached_input_tokens_total", "attempts_with_token_usage", "control_attempts_total", "repaired"
    )


@query(
    "issue_counts", "A35",
    with_views(*VIEWS, ISSUES, REPAIRS, select="""
SELECT count(*) AS files, count(*) FILTER (WHERE metrics_file IN (SELECT metrics_file FROM issues)) AS mismatched,
  count(*) FILTER (WHERE metrics_file IN (SELECT metrics_file FROM repairs WHERE repair_reasons <> '')) AS repaired FROM metrics"""),
)
def issue_counts(spark, sf_dir):
    # Three measures read the joined artifacts: written once instead of derived three times.
    j = cut_lineage(joined(spark, sf_dir), "joined")
    return quality.issue_counts(j, quality.artifact_issues(j), quality.repair_totals(j, RUN), RUN)


@query(
    "overridden_truth", "J4 S13",
    with_views(PREDICTIONS, select="""
SELECT run_id, count(*) FILTER (WHERE prediction = CASE WHEN p_size % 4 = 0 THEN 'R' ELSE truth END) AS correct, count(*) AS rows_of_run FROM predictions JOIN part ON id = p_partkey GROUP BY run_id"""),
)
def overridden_truth(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    labels = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, " R").otherwise(" ").alias("truth"))
    rows = resume.override_truth(fx.predictions(spark, sf_dir), labels)
    return rows.groupBy("run_id").agg(F.count_if(F.col("prediction") == F.col("truth")).alias("correct"), F.count("*").alias("rows_of_run"))


# First pass: items of some sizes are still open; second pass: fewer are.
PASSES = """
, first_pass AS (SELECT run_id, id, truth, CASE WHEN confidence > 0.85 THEN 'Unclassified ' ELSE prediction END AS prediction FROM predictions),
second_pass AS (SELECT run_id, id, CASE WHEN run_id % 4 = 1 THEN 'unclassified' ELSE truth END AS truth,
  CASE WHEN confidence > 0.85 AND (run_id % 3 = 0 OR confidence > 0.95) AND run_id % 7 <> 5 THEN 'unclassified' ELSE prediction END AS prediction FROM predictions)
"""


def first_pass(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    return p.withColumn("prediction", F.when(F.col("confidence") > 0.85, "Unclassified ").otherwise(F.col("prediction")))


def second_pass(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    still = (F.col("confidence") > 0.85) & ((F.col("run_id") % 3 == 0) | (F.col("confidence") > 0.95)) & (F.col("run_id") % 7 != 5)
    return p.withColumn("truth", F.when(F.col("run_id") % 4 == 1, "unclassified").otherwise(F.col("truth"))).withColumn(
        "prediction", F.when(still, "unclassified").otherwise(F.col("prediction"))
    )


@query(
    "open_inputs", "J5",
    with_views(PREDICTIONS, select=PASSES + "SELECT run_id, id FROM predictions ANTI JOIN (FROM first_pass WHERE id % 5 <> 2) USING (run_id, id)"),
)
def open_inputs(spark, sf_dir):
    inputs = fx.predictions(spark, sf_dir).select("run_id", "id")
    return resume.not_yet_predicted(inputs, first_pass(spark, sf_dir).filter("id % 5 <> 2"), ["run_id", "id"])


@query(
    "unclassified_inputs", "J6",
    with_views(PREDICTIONS, select=PASSES + "SELECT run_id, id FROM first_pass WHERE trim(lower(prediction)) = 'unclassified'"),
)
def unclassified_inputs(spark, sf_dir):
    inputs = fx.predictions(spark, sf_dir).select("run_id", "id")
    return resume.unclassified_inputs(inputs, first_pass(spark, sf_dir), ["run_id", "id"])


@query(
    "resume_stop_test", "U7 J6",
    with_views(PREDICTIONS, select=PASSES + """
, a AS (SELECT run_id, list(id ORDER BY id) FILTER (WHERE trim(lower(prediction)) = 'unclassified') AS ids FROM first_pass GROUP BY run_id),
b AS (SELECT run_id, list(id ORDER BY id) FILTER (WHERE prediction = 'unclassified') AS ids, count(*) FILTER (WHERE prediction = 'unclassified') AS open_now,
  count(*) FILTER (WHERE prediction = 'unclassified' AND truth <> 'unclassified') AS wanted FROM second_pass GROUP BY run_id)
SELECT run_id, open_now, open_now = 0 OR a.ids = b.ids OR wanted = 0 AS stop FROM b JOIN a USING (run_id)"""),
)
def resume_stop_test(spark, sf_dir):
    return resume.should_stop(first_pass(spark, sf_dir), second_pass(spark, sf_dir), "run_id", "id")


@query(
    "few_shot_examples", "W14",
    """SELECT l.doc_id, CAST(quality AS VARCHAR) AS truth, n_chars FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL ORDER BY n_chars, l.doc_id LIMIT 12""",
)
def few_shot_examples(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")
    return resume.few_shot(d.select("doc_id", F.col("quality").cast("string").alias("truth"), "n_chars"), 12, ["n_chars", "doc_id"])
