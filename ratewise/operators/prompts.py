"""Prompt targets, payloads, token estimates and even samples of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratewise.functions import text
from ratewise.functions.numbers import estimated_tokens
from ratewise.session import cut_lineage

SAMPLE = 100
# Notes that go with a target, and characters per token for the estimates.
NOTES = {
    "marked_subspan": "Classify only the marked sub-span; use the rest of the node plus contexts as supporting evidence.",
    "node": "Classify the entire node; left/right contexts simply provide supporting evidence.",
}
CHARS_PER_TOKEN = {"mid": 4.0, "low": 4.5, "high": 3.5}


def payload(layout: str) -> Column:
    """Struct sent for one example (columns ``left_context, node, right_context, info``)."""
    left, node, right, info = (F.coalesce(c, F.lit("")) for c in ("left_context", "node", "right_context", "info"))
    focus, target = text.target_focus(F.col("node")), text.target_text(F.col("node"))
    parts = [left.alias("left_context"), node.alias("node"), right.alias("right_context")]
    if layout == "compact":
        return F.struct(
            *parts, F.struct(focus.alias("focus"), target.alias("text")).alias("classification_target"),
            F.nullif(info, F.lit("")).alias("info"),
        )
    note = F.when(focus == "node", NOTES["node"]).otherwise(NOTES["marked_subspan"])
    return F.struct(
        *parts, info.alias("info"), text.mark_in_context(F.col("left_context"), F.col("node"), F.col("right_context")).alias("marked_example"),
        F.struct(focus.alias("focus"), target.alias("text"), note.alias("note")).alias("classification_target"),
    )


def payload_json(layout: str) -> Column:
    return F.to_json(payload(layout))


def with_token_estimates(df: DataFrame, column: str) -> DataFrame:
    for name, ratio in CHARS_PER_TOKEN.items():
        df = df.withColumn(f"tokens_{name}", estimated_tokens(F.length(column), ratio))
    return df


def with_row_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``row_index`` from 0 in the given order without sorting everything in one task.

    A range sort gives partitions in order; the rows before each partition come from one count per partition.
    """
    ranged = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    stored = cut_lineage(ranged, "ordered").withColumn("__part", F.shiftright("__id", 33))
    # One row per partition of the sort.
    counts = {r["__part"]: r["n"] for r in stored.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before))
        before += counts[part]
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __before long")
    index = F.col("__before") + F.col("__id") - F.shiftleft(F.col("__part"), 33)
    return stored.join(F.broadcast(offsets), "__part").withColumn("row_index", index).drop("__part", "__before", "__id")


def sample_evenly(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Rows floor(i * n / size) for i = 0..size-1; all rows of a small table."""
    indexed = with_row_index(df, order)
    n = indexed.count()
    if n <= size:
        return indexed.drop("row_index")
    i = F.ceil(F.col("row_index") * F.lit(size) / F.lit(n))
    return indexed.filter((i < size) & (F.floor(i * F.lit(n) / F.lit(size)) == F.col("row_index"))).drop("row_index")


def import_config(metrics: DataFrame, fields: dict[str, list[str]], explicit: dict[str, str] | None = None) -> DataFrame:
    """Settings taken over from a stored run: the first non-blank of the listed columns; explicit values win."""
    out = []
    for name, columns in fields.items():
        value = F.coalesce(*[text.blank_to_null(F.col(c)) for c in columns])
        if explicit and name in explicit:
            value = F.lit(explicit[name])
        out.append(value.alias(name))
    return metrics.select(*[c for c in metrics.columns if c == "run_stem"], *out)
