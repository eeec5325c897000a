"""Temporal URL filter: every capture is judged by the list entries in force when it was fetched.

Dated entries (pattern, action, day) become validity intervals: an entry holds from its day until the next day on which its pattern
has one; the action ``remove`` ends a listing. A pattern is a host, which covers its subdomains, or a host with
leading path segments. A capture asks for each of its host suffixes and path prefixes by an equality join on the pattern and an
interval test; of the entries in force the longest pattern decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratewise.session import cut_lineage


def host(url: Column) -> Column:
    """Lower-cased host without user, port or a final dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def path_segments(url: Column) -> Column:
    """Non-empty path segments, as written."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys(url: Column, segments: int) -> Column:
    """All patterns that cover a URL: host suffixes of one label or more, and the host with up to ``segments`` leading path segments."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    parts = F.slice(path_segments(url), 1, segments)
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.concat_ws("/", host(url), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from (pattern, action, listed_on); ``valid_to`` is null while an entry is in force.

    Patterns are lower-cased in the host. Rows with a null are skipped and repeated rows count once; of several actions on
    one day the last by name holds (``remove`` over ``block`` over ``allow``).
    """
    whole = F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("listed_on").isNotNull()
    cut = F.instr("pattern", "/")
    named = F.when(cut == 0, F.lower("pattern")).otherwise(F.concat(F.lower(F.substring(F.col("pattern"), F.lit(1), cut)), F.substring(F.col("pattern"), cut + 1, F.length("pattern"))))
    days = entries.filter(whole).select(named.alias("pattern"), "action", "listed_on").groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    until = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    return days.withColumn("valid_to", until).filter("action <> 'remove'").select("pattern", "action", F.col("listed_on").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_on") -> DataFrame:
    """One row per capture: id, url, time, ``pattern`` and ``action`` of the deciding entry (null if none), ``blocked``.

    Patterns may have any number of path segments: captures ask for as many as the longest listed one has. A capture without a
    URL, host or time meets no entry and is not blocked. Repeated captures are joined once and returned as often as
    given. The interval table is written before the join, so both sides are exchanged by pattern and a pattern with a large
    share of the captures can be split; the joined rows are summed up per capture by a maximum.
    """
    found = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("at")).groupBy("id", "url", "at").agg(F.count("*").alias("copies"))
    valid = cut_lineage(intervals(entries), "intervals")
    # One number reaches the driver: the path segments of the longest pattern.
    segments = valid.agg(F.max(F.size(F.split("pattern", "/")) - 1).alias("segments")).head()["segments"] or 0
    asked = found.withColumn("pattern", F.explode_outer(keys(F.col("url"), segments)))
    active = (F.col("a.pattern") == F.col("v.pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    met = asked.alias("a").join(valid.alias("v"), active, "left")
    rank = F.when(F.col("action").isNotNull(), F.struct(F.length("v.pattern").alias("size"), F.col("v.pattern").alias("pattern"), "action"))
    judged = met.groupBy("id", "url", "at", "copies").agg(F.max(rank).alias("entry"))
    out = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    blocked = F.coalesce(F.col("entry.action") == "block", F.lit(False))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(at_col), F.col("entry.pattern").alias("pattern"), F.col("entry.action").alias("action"), blocked.alias("blocked"))
