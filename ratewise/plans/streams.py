"""Queries that run the given event table through streams; their SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.operators import lexicon as lx
from ratewise.plans import fixtures as fx
from ratewise.plans.labels import lexicon
from ratewise.plans.oracle import ATTEMPTS, LEXICON, with_views
from ratewise.plans.registry import query
from ratewise.plans.scores import rd, rounded
from ratewise.session import scratch_path
from ratewise.streaming import live


def event_stream(spark, sf_dir):
    """The events as a stream of four files, the newest quarter first, one file to a micro-batch."""
    events = fx.table(spark, sf_dir, "events")
    path = scratch_path(spark, "events")
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01) or [0.0, 0.0, 0.0]
    when = F.unix_micros(F.col("ts").cast("timestamp"))
    quarter = sum(((when >= F.lit(int(c))).cast("int") for c in cuts), F.lit(0))
    for q in (3, 2, 1, 0):
        rows = events.filter(F.coalesce(quarter, F.lit(0)) == q)
        rows.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def attempt_stream(spark, sf_dir):
    """The events in the columns of the attempts view."""
    raw = event_stream(spark, sf_dir)
    is_error = F.col("event_type") == "error"
    return raw.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("id"),
        F.when(is_error, "error").when(F.col("event_type") == "signup", "other").otherwise("success").alias("status"),
        F.when(is_error & (F.col("value") > 100), "request_timeout").when(is_error, "server_error").alias("error_category"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("duration_seconds"), F.col("ts").cast("timestamp").alias("ts"),
    )


def stamped(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query(
    "live_run_counters", "T1",
    with_views(ATTEMPTS, select=f"""
SELECT run_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS attempts, count(*) FILTER (WHERE status = 'success') AS successes,
  count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'error' AND error_category = 'request_timeout') AS timeouts, {rd('sum(duration_seconds)')} AS seconds
FROM attempts GROUP BY ALL"""),
)
def live_run_counters(spark, sf_dir):
    rows = live.keep_table(attempt_stream(spark, sf_dir), live.live_counters(), *live.places(spark, "counters"))
    return rounded(stamped(rows, "window_start"))


@query(
    "live_timeout_alerts", "T5",
    with_views(ATTEMPTS, select=f"""
, d AS (SELECT date_trunc('day', ts) AS w, count(*) AS attempts, count(*) FILTER (WHERE status = 'error' AND error_category = 'request_timeout') AS timeouts FROM attempts GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, attempts, timeouts, {rd('timeouts / attempts')} AS timeout_share, timeouts / attempts > 0.05 AS alert FROM d"""),
)
def live_timeout_alerts(spark, sf_dir):
    rows = live.keep_table(attempt_stream(spark, sf_dir), live.timeout_alerts(), *live.places(spark, "alerts"))
    return rounded(stamped(rows, "window_start"))


@query(
    "live_sessions", "T4",
    with_views(ATTEMPTS, select="""
, marked AS (SELECT run_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM attempts),
sessions AS (SELECT run_id, ts, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS attempts FROM sessions GROUP BY run_id, s"""),
)
def live_sessions(spark, sf_dir):
    rows = live.keep_table(attempt_stream(spark, sf_dir), live.active_sessions("12 hours"), *live.places(spark, "sessions"))
    return stamped(rows, "first_ts", "last_ts").select("run_id", "first_ts", "last_ts", "attempts")


@query(
    "live_first_predictions", "T3",
    "SELECT user_id AS run_id, CAST(event_id AS BIGINT) // 5 AS id, CAST(1 AS BIGINT) AS kept FROM events GROUP BY ALL",
)
def live_first_predictions(spark, sf_dir):
    stream = attempt_stream(spark, sf_dir).select("run_id", F.floor(F.col("id") / 5).alias("id"), "ts")
    rows = live.keep_table(stream, live.first_predictions(), *live.places(spark, "firsts"))
    return rows.groupBy("run_id", "id").agg(F.count("*").alias("kept"))


@query(
    "live_validation", "T2 J17",
    with_views(LEXICON, select="""
SELECT conv_id || '-' || turn || '-' || pos AS request_id, CASE WHEN w IN (SELECT norm FROM lexicon) THEN 'accept' ELSE 'retry' END AS action
FROM (SELECT conv_id, turn, unnest(words) AS w, unnest(range(len(words))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '\\p{L}+') AS words FROM conversations))"""),
)
def live_validation(spark, sf_dir):
    """Every word of every turn, validated as it arrives against one prepared lexicon."""
    schema = fx.table(spark, sf_dir, "conversations").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque*")
    words = raw.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("pos", "label"))
    asked = words.select(F.concat_ws("-", "conv_id", "turn", "pos").alias("request_id"), "label", F.lit("").alias("info"), F.lit(1).alias("attempt"))
    terms = lx.prepare(lexicon(spark, sf_dir))
    rows = live.validate_stream(asked, lambda batch: lx.decide_lemma(batch, terms, max_distance=1, max_suggestions=3), *live.places(spark, "validation"))
    return rows.select("request_id", "action")
