"""Writing results: fixed column order, versions instead of overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Column order of the report tables.
RUN_COLUMNS = [
    "base_name", "stamp", "provider", "model", "temperature", "status", "fail_reason", "output_rows", "total_examples", "accuracy", "macro_f1", "cohen_kappa", "has_metrics", "has_log",
]
PRICE_COLUMNS = [
    "provider", "model", "pricing_key", "service_tier_used_for_price", "observed_service_tiers", "output_count", "metrics_count", "input_rate", "cached_rate", "output_rate", "priced", "notes",
]


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, format: str = "csv") -> None:
    """Writes to a new folder; an existing one is an error, so nothing is lost."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode("errorifexists")
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(format).save(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Repaired rows as a version below ``root``; the earlier ones stay as they are."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Newest version of every row."""
    rows = spark.read.parquet(root)
    newest = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(newest, [key, "version"], "left_semi").drop("version")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("errorifexists").json(path)
