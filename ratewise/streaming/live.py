"""Live logs and requests as streams. Every job gives what the batch operator gives over the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratewise.operators.telemetry import TIMEOUT
from ratewise.session import scratch_path
from ratewise.streaming import levels


@dataclass(frozen=True)
class LiveTable:
    """A table kept by a stream: what a micro-batch adds to it, and how the added rows make up the result.

    Each micro-batch is summed up by itself and appended; reading merges the parts. So rows may arrive in any order and as
    late as they like, nothing is dropped, no state grows in the stream, and the result equals the batch result over the same rows.
    ``compact`` makes one part of several where ``merge`` gives other columns than a part has.
    """

    part: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    compact: Callable[[DataFrame], DataFrame] | None = None


def _timeout() -> Column:
    return (F.col("status") == "error") & F.col("error_category").eqNullSafe(TIMEOUT)


def live_counters(window: str = "1 hour") -> LiveTable:
    """Attempts, outcomes and seconds per run and time window."""
    def part(attempts: DataFrame) -> DataFrame:
        is_error = F.col("status") == "error"
        return attempts.groupBy("run_id", F.window("ts", window)["start"].alias("window_start")).agg(
            F.count("*").alias("attempts"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(is_error).alias("errors"),
            F.count_if(_timeout()).alias("timeouts"), F.sum("duration_seconds").alias("seconds"),
        )

    counted = ["attempts", "successes", "errors", "timeouts", "seconds"]
    return LiveTable(part, lambda parts: parts.groupBy("run_id", "window_start").agg(*[F.sum(c).alias(c) for c in counted]))


def timeout_alerts(window: str = "1 day", share: float = 0.05) -> LiveTable:
    """Windows in which the share of timed-out attempts is above a limit."""
    def part(attempts: DataFrame) -> DataFrame:
        return attempts.groupBy(F.window("ts", window)["start"].alias("window_start")).agg(F.count("*").alias("attempts"), F.count_if(_timeout()).alias("timeouts"))

    def total(parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start").agg(F.sum("attempts").alias("attempts"), F.sum("timeouts").alias("timeouts"))

    def merge(parts: DataFrame) -> DataFrame:
        return total(parts).withColumn("timeout_share", F.col("timeouts") / F.col("attempts")).withColumn("alert", F.col("timeout_share") > share)

    return LiveTable(part, merge, total)


def active_sessions(gap: str) -> LiveTable:
    """First and last attempt of every session of a run; a pause of ``gap`` or longer ends a session.

    A micro-batch adds its spans; on reading, spans that lie less than the gap apart become one.
    """
    ends = {"first_ts": F.min, "last_ts": F.max, "attempts": F.sum}

    def part(attempts: DataFrame) -> DataFrame:
        spans = attempts.groupBy("run_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("attempts"))
        return spans.drop("session_window")

    def merge(parts: DataFrame) -> DataFrame:
        length = F.concat((F.unix_micros("last_ts") - F.unix_micros("first_ts")).cast("string"), F.lit(f" microseconds {gap}"))
        return parts.groupBy("run_id", F.session_window("first_ts", length)).agg(*[f(c).alias(c) for c, f in ends.items()]).drop("session_window")

    return LiveTable(part, merge)


def first_predictions() -> LiveTable:
    """Rows of a resumed run once per run and item: the earliest, whenever it arrives."""
    def earliest(rows: DataFrame) -> DataFrame:
        rest = ["ts", *[c for c in rows.columns if c not in ("run_id", "id", "ts")]]
        return rows.groupBy("run_id", "id").agg(F.min(F.struct(*rest)).alias("r")).select("run_id", "id", "r.*")

    return LiveTable(earliest, earliest)


def keep_table(stream: DataFrame, table: LiveTable, checkpoint: str, path: str, fan_in: int = levels.FAN_IN) -> DataFrame:
    """Runs a stream over all available files into a table of few folders (see ``levels``) and returns the merged rows."""
    spark = stream.sparkSession
    schema = table.part(spark.createDataFrame([], stream.schema)).schema

    def append(batch: DataFrame, batch_id: int) -> None:
        levels.add_batch(table.part(batch), batch_id, path, table.compact or table.merge, fan_in)

    # Without a single batch the table is empty, not missing.
    levels.commit(spark, path, 0)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    return table.merge(levels.read_table(spark, path, schema, fan_in))


def validate_stream(requests: DataFrame, decide: Callable[[DataFrame], DataFrame], checkpoint: str, path: str) -> DataFrame:
    """Decisions for a stream of requests: each micro-batch is decided against the static lexicon."""
    return keep_table(requests, LiveTable(decide, lambda decisions: decisions), checkpoint, path)


def places(spark: SparkSession, name: str) -> tuple[str, str]:
    """Checkpoint and table folder for one stream, in the shared folder."""
    return scratch_path(spark, f"{name}-checkpoint"), scratch_path(spark, f"{name}-rows")
