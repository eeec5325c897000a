"""Lexicon files: one lemma per line, or tables with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratewise.functions.text import clean_pos, strip

SEPARATORS = {"tab": "\t", "semicolon": ";", "space": r"(?U)\s+"}


def line_order() -> Column:
    """Sorts lines as they stand in their file, without reading a file in one piece."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``line, line_no`` of text files; ``line_no`` only sorts."""
    df = spark.read.text(paths).select(F.regexp_replace("value", "^﻿", "").alias("line"), line_order().alias("line_no"))
    return df


def split_lexicon_lines(lines: DataFrame, separator: str = "auto") -> DataFrame:
    """``lemma, pos, line_no`` of lexicon lines; ``auto`` takes a tab before a semicolon before blanks."""
    raw = strip(F.col("line"))
    if separator == "auto":
        parts = (
            F.when(F.contains(raw, F.lit("\t")), F.split(raw, "\t"))
            .when(F.contains(raw, F.lit(";")), F.split(raw, ";"))
            .otherwise(F.split(raw, SEPARATORS["space"]))
        )
    else:
        parts = F.split(raw, SEPARATORS[separator])
    rows = lines.withColumn("__f", F.transform(parts, strip)).filter(raw != "")
    return rows.select(F.get("__f", F.lit(0)).alias("lemma"), F.coalesce(F.get("__f", F.lit(1)), F.lit("")).alias("pos"), "line_no")


def read_lexicon(spark: SparkSession, paths: str | list[str], separator: str = "auto") -> DataFrame:
    return split_lexicon_lines(read_lines(spark, paths), separator)


def read_header_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``;`` table that must have a ``lemma`` column; tags are cleaned."""
    df = spark.read.csv(path, sep=";", header=True, escape='"', multiLine=True)
    if "lemma" not in df.columns:
        raise ValueError("the lexicon needs a 'lemma' column")
    pos = clean_pos(F.col("pos")) if "pos" in df.columns else F.lit("")
    return df.select(F.lower(strip(F.coalesce("lemma", F.lit("")))).alias("lemma"), pos.alias("pos"), line_order().alias("line_no"))


def read_headwords(spark: SparkSession, path: str) -> DataFrame:
    """Headword list: with a header the column ``headword``, else ``lemma``, else the first; without one every line."""
    first = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v")).head()
    header = (first["v"] if first else "").lower()
    if "lemma" not in header and "headword" not in header:
        return read_lines(spark, path).select(F.lower(strip(F.col("line"))).alias("lemma"), F.lit("").alias("pos"), "line_no")
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    names = {c.strip().lower(): c for c in df.columns}
    column = names.get("headword") or names.get("lemma") or df.columns[0]
    return df.select(F.lower(strip(F.coalesce(F.col(f"`{column}`"), F.lit("")))).alias("lemma"), F.lit("").alias("pos"), line_order().alias("line_no"))
