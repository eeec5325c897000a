"""JSON files: run metrics, prompt logs, agreement files, price catalogues, file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratewise import schemas
from ratewise.functions import names
from ratewise.functions.text import blank_to_null, split_tags, unique_non_empty

SUFFIXES = ["__metrics.json", "_metrics.json"]


def discover(spark: SparkSession, folders: list[str], pattern: str = "*_metrics.json", manifest: DataFrame | None = None) -> DataFrame:
    """Paths below the folders, each once; a manifest (``name``) decides where it is given."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folders).select("path")
    )
    files = distinct_paths(found)
    if manifest is None:
        return files
    wanted = manifest.select(names.file_name(F.col("name")).alias("file")).distinct()
    return files.withColumn("file", names.file_name(F.col("path"))).join(wanted, "file", "left_semi").select("path")


def distinct_paths(files: DataFrame) -> DataFrame:
    return files.withColumn("path", names.forward_slashes(F.col("path"))).dropDuplicates(["path"])


def manifest_of(files: DataFrame) -> DataFrame:
    """Sorted metrics file names with the time of the listing, one row per file."""
    name = names.file_name(F.col("path"))
    return files.select(name.alias("file")).filter(F.col("file").endswith("_metrics.json")).distinct().orderBy("file").withColumn("generated_at", F.current_timestamp())


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, text`` of small files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _is_object(text: Column) -> Column:
    v = F.try_parse_json(text)
    return v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def parse_metrics(files: DataFrame) -> DataFrame:
    """Metrics objects as ``path, text, m``; files that are no JSON object are left out (see :func:`metrics_warnings`)."""
    return files.filter(_is_object(F.col("text"))).withColumn("m", F.from_json("text", schemas.METRICS))


def metrics_warnings(files: DataFrame) -> DataFrame:
    """``path, message`` of files that could not be used."""
    parsed = F.try_parse_json(F.col("text"))
    message = F.when(parsed.isNull(), "Invalid JSON").when(
        ~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "Unexpected JSON structure (expected object)."
    )
    return files.select("path", message.alias("message")).filter(F.col("message").isNotNull())


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, line_no, text`` of line-wise logs; files stay splittable."""
    meta = F.col("_metadata")
    return spark.read.text(paths).select(
        meta["file_path"].alias("path"), F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"), F.col("value").alias("text")
    )


def legacy_log_lines(files: DataFrame) -> DataFrame:
    """Old logs, one JSON array per file (``path, text``), as the lines of a new one."""
    parsed = F.from_json("text", "array<string>")
    return files.select("path", F.posexplode(parsed).alias("line_no", "text"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Records of log lines; blank and broken lines and lines that are no object are skipped."""
    ok = (F.trim("text") != "") & _is_object(F.col("text"))
    return lines.filter(ok).withColumn("r", F.from_json("text", schemas.LOG_RECORD)).select("path", "line_no", "r.*")


def run_metadata(records: DataFrame) -> DataFrame:
    """First ``run_metadata`` record per file."""
    meta = records.filter("record_type = 'run_metadata'")
    first = meta.groupBy("path").agg(F.min_by(F.struct("run_config", "model_details"), "line_no").alias("m"))
    return first.select("path", "m.*")


def log_attempts(records: DataFrame) -> DataFrame:
    """One row per attempt of an example result: ``path, example, attempt, status, …, validator_status``."""
    ex = records.filter("record_type = 'example_result'")
    return ex.select(
        "path", F.col("line_no").alias("example"), F.col("final_prediction.validator_status").alias("validator_status"), F.posexplode_outer("attempts").alias("attempt", "a")
    ).select(
        "path", "example", "attempt", "validator_status", F.col("a.status").alias("status"), F.col("a.error_category").alias("error_category"),
        F.col("a.duration_seconds").alias("duration_seconds"), F.col("a.response.usage_metadata").isNotNull().alias("has_usage"),
    )


def flatten_runs(parsed: DataFrame) -> DataFrame:
    """Dashboard run per metrics file, each field from the first place that has it.

    Input as from :func:`parse_metrics`. Percentages are scaled, names fall back to the file name.
    """
    from ratewise.functions.numbers import finite, to_percent
    from ratewise.functions.text import effort_suffix
    from ratewise.functions.times import run_time

    path = names.metrics_path(F.col("path"))
    file = names.file_name(path)
    df = parsed.withColumn("__path", path).withColumn("__file", file).withColumn("__n", names.parse_run_name(names.run_stem(file)))

    def text(*paths: str) -> Column:
        return F.coalesce(*[blank_to_null(F.col(p)) for p in paths])

    def num(*paths: str) -> Column:
        return F.coalesce(*[finite(F.col(p)) for p in paths])

    def tags(where: str) -> Column:
        raw = F.get_json_object("text", where)
        listed = F.filter(F.transform(F.from_json(raw, "array<string>"), lambda t: F.trim(t)), lambda t: t != "")
        return F.when(F.startswith(raw, F.lit("[")), listed).otherwise(split_tags(raw))

    own, outer = tags("$.run_config.tags"), tags("$.tags")
    empty = F.lit("")
    stamp = F.coalesce(blank_to_null(F.col("m.first_prompt_timestamp")), F.col("__n.timestamp"))
    conf = "m.request_control_summary.configured"
    scores = ["m.accuracy", "m.cohen_kappa", "m.macro_precision", "m.macro_recall", "m.macro_f1"]
    return df.select(
        F.col("__path").alias("file_path"), F.col("__file").alias("file_name"), names.run_stem(F.col("__file")).alias("run_stem"),
        F.col("__n.model").alias("file_model_slug"),
        F.coalesce(text("m.run_config.task_name", "m.task_name"), F.col("__n.task")).alias("task"),
        F.coalesce(text("m.run_config.task_description", "m.task_description"), empty).alias("task_description"),
        F.when(F.size(own) > 0, own).otherwise(outer).alias("tags"),
        F.coalesce(text("m.model_details.provider", "m.provider"), F.col("__n.provider"), empty).alias("provider"),
        F.coalesce(text("m.model_details.model_requested", "m.model_details.model_for_requests", "m.model_requested", "m.model"), F.col("__n.model")).alias("model"),
        stamp.alias("timestamp"), run_time(stamp).alias("started"),
        *[to_percent(F.col(f"m.{c}")).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")],
        num("m.cohen_kappa").alias("stored_kappa"),
        to_percent(F.col("m.calibration_metrics.ece")).alias("calibration_ece"), to_percent(F.col("m.calibration_metrics.mce")).alias("calibration_mce"),
        num("m.calibration_metrics.brier_score").alias("calibration_brier_score"), num("m.calibration_metrics.sample_count").alias("calibration_sample_count"),
        (F.coalesce(F.col("m.calibration_metrics.available"), F.lit(False)) & num("m.calibration_metrics.ece").isNotNull()).alias("calibration_available"),
        num("m.total_examples", "m.evaluated_example_count", "m.prediction_count").alias("total_examples"),
        num("m.prediction_count").alias("prediction_count"), num("m.truth_label_count").alias("truth_label_count"),
        num("m.request_control_summary.attempts_total", "m.usage_metadata_summary.attempts_total").alias("requests_total"),
        num("m.usage_metadata_summary.attempts_with_usage_metadata").alias("attempts_with_usage"),
        num("m.usage_metadata_summary.cached_tokens_total_estimate", "m.usage_metadata_summary.cache_read_tokens_total").alias("cached_tokens"),
        num("m.token_usage_totals.input_tokens_total").alias("input_tokens"),
        num("m.token_usage_totals.cached_input_tokens_total", "m.usage_metadata_summary.cached_tokens_total_estimate", "m.usage_metadata_summary.cache_read_tokens_total").alias("cached_input_tokens"),
        num("m.token_usage_totals.output_tokens_total").alias("output_tokens"), num("m.token_usage_totals.thinking_tokens_total").alias("thinking_tokens"),
        num("m.token_usage_totals.non_cached_input_tokens_total").alias("non_cached_tokens"),
        num("m.overall_time_seconds").alias("overall_time_seconds"),
        F.coalesce(text("m.run_config.service_tier"), F.lit("standard")).alias("service_tier"),
        (F.coalesce(F.col("m.label_metrics_available"), F.lit(True)) & num(*scores).isNotNull()).alias("label_metrics_available"),
        effort_suffix(F.col(f"{conf}.thinking_level"), F.col(f"{conf}.reasoning_effort"), F.col(f"{conf}.effort")).alias("suffix"),
        F.col("m.model_details.model_requested").alias("requested"), F.col("m.model_details.model_for_requests").alias("for_requests"),
        F.col("m.labels").alias("labels"), F.col("m.confusion_matrix").alias("confusion_matrix"), F.col("m.confusion_matrix_sparse").alias("confusion_matrix_sparse"),
    )


def with_derived_kappa(runs: DataFrame) -> DataFrame:
    """Kappa as stored, else from the stored matrix."""
    from ratewise.operators.metrics import triplets_to_confusion

    derived = triplets_to_confusion(runs, "run_stem")
    return runs.join(derived, "run_stem", "left").withColumn("cohen_kappa", F.coalesce("stored_kappa", "derived_kappa")).drop("derived_kappa", "stored_kappa", "labels", "confusion_matrix", "confusion_matrix_sparse")


def agreement_groups(files: DataFrame) -> DataFrame:
    """Groups of agreement files (``path, text``): repeat groups and, per policy, groups across models."""
    group = f"array<struct<{_fields(schemas.AGREEMENT_GROUP)}>>"

    def part(where: str, scope: str, policy: str) -> DataFrame:
        rows = F.from_json(F.get_json_object("text", where), group)
        out = files.select("path", F.posexplode(rows).alias("position", "g")).filter(F.col("g").isNotNull())
        chosen = F.coalesce(blank_to_null(F.col("g.representative_policy")), F.lit(policy))
        return out.select("path", "position", F.lit(scope).alias("scope"), chosen.alias("policy"), "g.*").drop("representative_policy")

    rows = part("$.repeat_groups", "repeat", "").unionByName(part("$.cross_model.latest", "cross_model", "latest")).unionByName(
        part("$.cross_model.best_accuracy", "cross_model", "best_accuracy")
    )
    whole = lambda c: (c == F.floor(c)) & (c >= 0)
    pairs = F.filter("pairwise", lambda p: F.coalesce(whole(p["a"]) & whole(p["b"]) & (p["a"] != p["b"]), F.lit(False)))
    steps = F.filter("linkage", lambda s: (F.size(s) >= 4) & F.coalesce(whole(s[0]) & whole(s[1]) & s[2].isNotNull() & (s[3] == F.floor(s[3])), F.lit(False)))
    stems = unique_non_empty(F.coalesce("run_stems", "representative_run_stems", F.array().cast("array<string>")))
    return rows.withColumn("run_stems", stems).withColumn("pairwise", pairs).withColumn("linkage", steps).drop("representative_run_stems")


def _fields(ddl: str) -> str:
    """Column list as struct fields."""
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def price_rows(files: DataFrame) -> DataFrame:
    """Catalogue rows of a price file (JSON, perhaps inside a script): one row per context and tier, one for entries without tiers.

    ``context`` is ``base`` or ``long``; long-context rows name the threshold they begin at.
    """
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    models = files.select(F.explode(F.from_json(body, schemas.PRICE_CATALOG)["providers"]).alias("provider", "p")).select("provider", F.explode("p.models").alias("model", "e"))
    none = F.lit(None).cast("double")
    tiers = models.select("provider", "model", "e", F.lit("base").alias("context"), none.alias("threshold_input_tokens"), F.explode_outer("e.service_tiers").alias("tier", "t"))
    longer = models.select("provider", "model", "e", F.lit("long").alias("context"), F.col("e.long_context.threshold_input_tokens").alias("threshold_input_tokens"), F.explode("e.long_context.service_tiers").alias("tier", "t"))
    tiers = tiers.unionByName(longer)
    return tiers.select(
        "provider", "model", "tier", F.col("t.input_usd_per_mtokens").alias("input_rate"), F.col("t.cached_input_usd_per_mtokens").alias("cached_rate"),
        F.col("t.output_usd_per_mtokens").alias("output_rate"), F.col("e.pricing_ref").alias("pricing_ref"), F.col("e.reason").alias("reason"),
        F.coalesce("e.needs_manual_update", F.lit(False)).alias("needs_manual"), F.col("e.alias_kind").alias("alias_kind"), F.col("e.sources").alias("sources"), F.col("e.notes").alias("notes"),
        "context", "threshold_input_tokens",
    )
