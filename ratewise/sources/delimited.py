"""Prediction tables and example files with a header, whatever their delimiter and column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratewise.functions.text import header_key, header_name, strip
from ratewise.session import cut_lineage

RULES = ("two", "three", "header")
CANDIDATES = {"two": [";", ","], "three": [";", ",", "\t"], "header": [";", ","]}


def delimiter_of(header: Column, rule: str = "two") -> Column:
    """Delimiter of a file from its header line.

    ``two``: semicolon unless commas are more frequent. ``three``: also tabs. ``header``: semicolon if it splits the
    header at all, else comma.
    """
    semi, comma, tab = (F.regexp_count(header, F.lit(p)) for p in (";", ",", "\\t"))
    if rule == "two":
        return F.when(semi >= comma, ";").otherwise(",")
    if rule == "three":
        return F.when(semi >= F.greatest(comma, tab), ";").when(tab > comma, "\t").otherwise(",")
    return F.when(semi >= 1, ";").otherwise(",")


def header_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, header`` of every file; only first blocks are kept."""
    meta = F.col("_metadata")
    rows = spark.read.text(paths).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    ).filter("block = 0")
    first = rows.groupBy("path").agg(F.min_by("value", "row").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\\uFEFF", ""))


def scan_delimited(spark: SparkSession, paths: str | list[str], rule: str = "two", multi_line: bool = True) -> DataFrame:
    """Data rows of all files as ``path, row, cells``: ``cells`` maps header to value, ``row`` sorts within a file.

    One pass per candidate delimiter, keeping the files sniffed with it, so file lists never pass through the driver.
    Of equal headers the first counts. ``multi_line`` reads quoted line breaks (a file is then one task).
    """
    # One row per file, read by every pass below: sniffed once.
    sniffed = cut_lineage(header_lines(spark, paths).withColumn("sep", delimiter_of(F.col("header"), rule)), "sniffed")
    counts = [F.max(F.regexp_count("header", F.lit(s if s != "\t" else "\\t"))) for s in CANDIDATES[rule]]
    width = max([c or 0 for c in sniffed.agg(*counts).head()] or [0]) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    parts = []
    for sep in CANDIDATES[rule]:
        rows = spark.read.csv(paths, schema=schema, sep=sep, header=False, multiLine=multi_line, escape='"', encoding="UTF-8")
        meta = F.col("_metadata")
        cells = F.array(*[F.col(f"c{i}") for i in range(width)])
        rows = rows.select(meta["file_path"].alias("path"), F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id")).alias("row"), cells.alias("cells"))
        parts.append(rows.join(sniffed.filter(F.col("sep") == sep).select("path"), "path", "left_semi"))
    data = parts[0]
    for p in parts[1:]:
        data = data.unionByName(p)
    first = data.groupBy("path").agg(F.min(F.struct("row", "cells")).alias("first"))
    names = F.transform("first.cells", lambda c: strip(F.regexp_replace(c, "^\\uFEFF", "")))
    keyed = first.select("path", F.col("first.row").alias("header_row"), names.alias("names"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(F.get("names", i).alias("k"), F.get("cells", i).alias("v"), (F.array_position("names", F.get("names", i)) == i + 1).alias("lead")))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & (p["k"] != "") & p["lead"])
    as_map = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))
    return data.join(keyed, "path").filter(F.col("row") > F.col("header_row")).select("path", "row", as_map.alias("cells"))


def cell(*names: str) -> Column:
    """First non-blank cell among the given headers, as trimmed text; empty where none has a value."""
    options = [F.nullif(strip(F.element_at("cells", F.lit(n))), F.lit("")) for n in names]
    return F.coalesce(*options, F.lit(""))


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, id, prediction``; rows without id are dropped, the last row of an id counts."""
    rows = scan_delimited(spark, paths).select("path", "row", cell("ID", "id").alias("id"), cell("prediction").alias("prediction"))
    return rows.filter("id <> ''").groupBy("path", "id").agg(F.max_by("prediction", "row").alias("prediction"))


def count_rows(spark: SparkSession, paths: str | list[str], expected: DataFrame | None = None) -> DataFrame:
    """Data rows per file; null for expected files that are not there."""
    files = header_lines(spark, paths).select("path")
    counts = scan_delimited(spark, paths).groupBy("path").agg(F.count("*").alias("n"))
    out = files.join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0).cast("long")).alias("output_rows"))
    return out if expected is None else expected.select("path").join(out, "path", "left")


def read_examples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Input examples: columns found by normalised header, blank rows dropped, other columns kept in ``cells``.

    Raises on the first row of a file that has no node column.
    """
    rows = scan_delimited(spark, paths, "header")
    some = F.exists(F.map_values("cells"), lambda v: strip(F.coalesce(v, F.lit(""))) != "")
    rows = rows.filter(some)
    keys = F.transform(F.map_entries("cells"), lambda e: F.struct(header_key(e["key"]).alias("k"), e["value"].alias("v")))
    found = rows.withColumn("e", keys)

    def by(name: str) -> Column:
        return F.get(F.transform(F.filter("e", lambda x: x["k"] == name), lambda x: x["v"]), F.lit(0))

    has = lambda name: F.exists("e", lambda x: x["k"] == name)
    node = F.when(has("node"), F.coalesce(by("node"), F.lit(""))).otherwise(F.raise_error(F.lit("CSV must include a node column.")).cast("string"))
    info = F.when(has("info"), by("info")).otherwise(by("metadata"))
    blank = F.lit("")
    return found.select(
        "path", "row", F.coalesce(by("id"), blank).alias("id"), F.coalesce(by("leftcontext"), blank).alias("left_context"), node.alias("node"),
        F.coalesce(by("rightcontext"), blank).alias("right_context"), F.coalesce(info, blank).alias("info"), by("truth").alias("truth"), "cells",
    )


def read_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Label overrides ``id, truth``; the last row of an id counts."""
    rows = scan_delimited(spark, paths, "header").select("path", "row", cell("ID", "id").alias("id"), cell("truth").alias("truth"))
    return rows.filter("id <> ''").groupBy("id").agg(F.max_by("truth", F.struct("path", "row")).alias("truth"))


def normalised_columns(df: DataFrame) -> DataFrame:
    """Table with normalised column names; of equal names the first stays."""
    seen: dict[str, str] = {}
    for c in df.columns:
        key = header_name(c)
        if key and key not in seen:
            seen[key] = c
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in seen.items()])


def drop_blank_rows(df: DataFrame) -> DataFrame:
    text = F.concat_ws("", *[strip(F.col(f"`{c}`").cast("string")) for c in df.columns])
    return df.filter(text != "")
