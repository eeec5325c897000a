"""Queries on leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions import numbers
from ratewise.functions.text import allowed_selection, display_name, effort_suffix, split_tags
from ratewise.operators import leaderboard as lb, metrics
from ratewise.operators.quantiles import exact_quantiles
from ratewise.operators.ranges import in_any_range
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import ATTEMPTS, PREDICTIONS, RUNS, SCORES, TOKENS, with_views
from ratewise.plans.registry import query
from ratewise.plans.scores import r6, rd, rounded
from ratewise.session import cut_lineage

BOARD = """
ece_bins AS (SELECT run_id, least(floor(confidence * 10), 9) AS bin, count(*) AS n,
    avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(confidence) AS mc FROM predictions GROUP BY 1, 2),
ece AS (SELECT run_id, sum(abs(hit_rate - mc) * n) / sum(n) AS ece FROM ece_bins GROUP BY run_id),
token_sums AS (SELECT run_id, CAST(sum(prompt_tokens) AS DOUBLE) AS input_tokens, CAST(sum(completion_tokens) AS DOUBLE) AS output_tokens FROM tokens GROUP BY run_id),
requests_of AS (SELECT run_id, count(*) AS requests_total, CAST(sum(cached_tokens) AS DOUBLE) AS cached_tokens FROM attempts GROUP BY run_id),
board AS (
  SELECT r.run_id, run_stem || '__metrics.json' AS file_name, run_stem, task, provider, model, CASE WHEN r.run_id % 17 <> 3 THEN started END AS started,
    list_filter(list_transform(string_split(tags_text, ';'), lambda x: trim(x)), lambda x: x <> '') AS tags,
    CASE WHEN r.run_id % 9 <> 4 THEN accuracy * 100 END AS accuracy, macro_f1 * 100 AS macro_f1, macro_precision * 100 AS macro_precision,
    macro_recall * 100 AS macro_recall, cohen_kappa, ece * 100 AS calibration_ece,
    CASE WHEN r.run_id % 8 <> 3 THEN (input_tokens * 0.5 + output_tokens * 2) / 1000000 END AS estimated_cost_usd,
    CASE WHEN r.run_id % 6 <> 1 THEN evaluated END AS total_examples, CASE WHEN r.run_id % 4 <> 2 THEN evaluated END AS prediction_count,
    evaluated AS truth_label_count, requests_total, input_tokens, cached_tokens, output_tokens,
    CASE WHEN r.run_id % 4 = 1 THEN '[thinking:low' || CASE WHEN r.run_id % 5 = 2 THEN ', effort:high' ELSE '' END || ']'
         WHEN r.run_id % 5 = 2 THEN '[effort:high]' ELSE '' END AS suffix
  FROM runs r JOIN scores USING (run_id) JOIN ece USING (run_id) LEFT JOIN token_sums USING (run_id) LEFT JOIN requests_of USING (run_id))"""

VIEWS = (PREDICTIONS, SCORES, RUNS, TOKENS, ATTEMPTS, BOARD)


def board(spark, sf_dir):
    """Dashboard rows: percentages, counts, tokens, costs and tags per run; some of each are missing."""
    preds = fx.predictions(spark, sf_dir)
    scores = metrics.run_scores(metrics.confusion_counts(preds))
    ece = metrics.calibration(preds).select("run_id", "ece")
    tokens = fx.tokens(spark, sf_dir).groupBy("run_id").agg(
        F.sum("prompt_tokens").cast("double").alias("input_tokens"), F.sum("completion_tokens").cast("double").alias("output_tokens")
    )
    asked = fx.attempts(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("requests_total"), F.sum("cached_tokens").cast("double").alias("cached_tokens")
    )
    run = F.col("run_id")
    suffix = effort_suffix(F.when(run % 4 == 1, " low "), F.when(run % 5 == 2, "high"), F.when(run % 5 == 2, "ignored"))
    rows = fx.runs(spark, sf_dir).join(scores, "run_id").join(ece, "run_id").join(tokens, "run_id", "left").join(asked, "run_id", "left")
    table = rows.select(
        "run_id", F.concat("run_stem", F.lit("__metrics.json")).alias("file_name"), "run_stem", "task", "provider", "model",
        F.when(run % 17 != 3, F.col("started")).alias("started"), split_tags(F.col("tags_text")).alias("tags"),
        F.when(run % 9 != 4, numbers.to_percent(F.col("accuracy"))).alias("accuracy"),
        *[numbers.to_percent(F.col(c)).alias(c) for c in ("macro_f1", "macro_precision", "macro_recall")],
        "cohen_kappa", numbers.to_percent(F.col("ece")).alias("calibration_ece"),
        F.when(run % 8 != 3, (F.col("input_tokens") * 0.5 + F.col("output_tokens") * 2) / 1_000_000).alias("estimated_cost_usd"),
        F.when(run % 6 != 1, F.col("evaluated")).alias("total_examples"), F.when(run % 4 != 2, F.col("evaluated")).alias("prediction_count"),
        F.col("evaluated").alias("truth_label_count"), "requests_total", "input_tokens", "cached_tokens", "output_tokens",
        suffix.alias("suffix"), display_name(F.col("model"), suffix).alias("model_display"),
        F.lit(None).cast("double").alias("cached_input_tokens"), (run * 3).cast("double").alias("thinking_tokens"),
        F.lit(None).cast("double").alias("repeat_alpha"),
    )
    return cut_lineage(table, "board")


@query(
    "leaderboard_filtered", "P21 P22 J29 P12 P10 O1",
    with_views(*VIEWS, select=f"""
SELECT file_name, task, model, {r6('accuracy macro_f1')} FROM board
WHERE task IN ('AFRICA', 'ASIA', 'EUROPE') AND model = 'm1' AND list_has_any(tags, ['gold', 'NATION_3']) AND accuracy IS NOT NULL AND started IS NOT NULL
  AND (started BETWEEN '2026-05-10 00:00' AND '2026-05-13 09:05' OR started >= '2026-05-17 00:00')"""),
)
def leaderboard_filtered(spark, sf_dir):
    kept = lb.filter_runs(
        board(spark, sf_dir), ["AFRICA", "ASIA", "EUROPE"], ["m1"], ["gold", "NATION_3"], True,
        [("2026-05-13-09-05", "2026-05-10"), ("", " "), ("2026-05-17T00:00", None)],
    )
    return rounded(kept.orderBy(*lb.leaderboard_order("accuracy")).select("file_name", "task", "model", "accuracy", "macro_f1"))


@query(
    "attempts_near_errors", "J29 P22 P14",
    with_views(ATTEMPTS, select="""
, spans AS (SELECT ts AS lo, ts + to_minutes(attempt_id % 50) AS hi FROM attempts WHERE status = 'error' AND attempt_id % 3 <> 1)
SELECT a.attempt_id, a.run_id FROM attempts a WHERE a.status <> 'error' AND EXISTS (SELECT 1 FROM spans s WHERE a.ts BETWEEN s.lo AND s.hi)"""),
)
def attempts_near_errors(spark, sf_dir):
    """Other attempts within some minutes after an error; the ranges come as text, some of them reversed."""
    asked = fx.attempts(spark, sf_dir)
    errors = asked.filter("status = 'error' and attempt_id % 3 <> 1")
    texts = [F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS") for t in (F.col("ts"), F.timestamp_micros(F.unix_micros("ts") + F.col("attempt_id") % 50 * 60_000_000))]
    turned = F.col("attempt_id") % 2 == 0
    ranges = errors.select(F.when(turned, texts[1]).otherwise(texts[0]).alias("start"), F.when(turned, texts[0]).otherwise(texts[1]).alias("end"))
    return in_any_range(asked.filter("status <> 'error'"), ranges, "ts").select("attempt_id", "run_id")


def ranked_sql(order: str, limit: int) -> str:
    return with_views(*VIEWS, select=f"""
SELECT file_name, {rd('accuracy')} AS accuracy, {rd('macro_f1')} AS macro_f1 FROM board ORDER BY {order} LIMIT {limit}""")


@query("leaderboard_page", "O1 O7", ranked_sql("accuracy DESC NULLS LAST, macro_f1 DESC NULLS LAST, started DESC NULLS LAST, file_name", 60))
def leaderboard_page(spark, sf_dir):
    rows = board(spark, sf_dir).orderBy(*lb.leaderboard_order("accuracy"), "file_name")
    return rounded(lb.page(rows, None, lb.PAGE["leaderboard"]).select("file_name", "accuracy", "macro_f1"))


@query("metrics_table_page", "O2 O3 O7", ranked_sql("accuracy DESC NULLS FIRST, started DESC NULLS LAST, file_name", 16))
def metrics_table_page(spark, sf_dir):
    rows = board(spark, sf_dir).orderBy(*lb.table_order("accuracy"))
    return rounded(lb.page(rows, 16, 60).select("file_name", "accuracy", "macro_f1"))


@query("metrics_table_cheapest", "O2 O3", ranked_sql("estimated_cost_usd ASC NULLS LAST, started DESC NULLS LAST, file_name", 10))
def metrics_table_cheapest(spark, sf_dir):
    rows = board(spark, sf_dir).orderBy(*lb.table_order("estimated_cost_usd"))
    return rounded(lb.page(rows, 10, 60).select("file_name", "accuracy", "macro_f1"))


# Interval of a percentage column over the first known count.
CI_SQL = """
, sized AS (SELECT *, coalesce(total_examples, prediction_count, truth_label_count) AS n FROM board),
ci AS (SELECT *, 1.96 * sqrt(greatest(0, least(1, accuracy / 100)) * (1 - greatest(0, least(1, accuracy / 100))) / n) * 100 AS margin FROM sized),
bounds AS (SELECT *, CASE WHEN accuracy IS NOT NULL THEN greatest(0, accuracy - margin) END AS lo,
  CASE WHEN accuracy IS NOT NULL THEN least(100, accuracy + margin) END AS hi FROM ci)
"""


@query(
    "accuracy_intervals", "P25 P26",
    with_views(*VIEWS, select=CI_SQL + f"""
SELECT file_name, {rd('accuracy')} AS accuracy, {rd('lo')} AS ci_low, {rd('hi')} AS ci_high, CASE WHEN accuracy IS NOT NULL THEN n END AS ci_n FROM bounds"""),
)
def accuracy_intervals(spark, sf_dir):
    return rounded(lb.with_interval(board(spark, sf_dir), "accuracy").select("file_name", "accuracy", "ci_low", "ci_high", "ci_n"))


BALANCED_SQL = CI_SQL + """
, unit AS (SELECT model AS g, task AS u, avg(accuracy) AS m, avg(estimated_cost_usd) AS p, count(*) AS items, count(lo) AS cis, sum(CASE WHEN lo IS NOT NULL THEN n END) AS un,
    sum(pow((hi - lo) / 2 / 1.96 / 100, 2)) AS var FROM bounds GROUP BY model, task),
unit_ci AS (SELECT *, CASE WHEN cis > 0 THEN greatest(0, m - 196 * sqrt(var) / cis) END AS ulo, CASE WHEN cis > 0 THEN least(100, m + 196 * sqrt(var) / cis) END AS uhi FROM unit),
grouped AS (SELECT g, avg(m) AS metric_value, avg(CASE WHEN m IS NOT NULL THEN p END) AS price_value, count(m) AS unit_count,
    count(CASE WHEN m IS NOT NULL THEN p END) AS priced_unit_count, CAST(sum(items) AS BIGINT) AS item_count, CAST(sum(un) AS BIGINT) AS ci_n,
    greatest(0, avg(m) - 196 * sqrt(sum(pow((uhi - ulo) / 2 / 1.96 / 100, 2))) / count(ulo)) AS ci_low,
    least(100, avg(m) + 196 * sqrt(sum(pow((uhi - ulo) / 2 / 1.96 / 100, 2))) / count(ulo)) AS ci_high FROM unit_ci GROUP BY g)
"""


@query(
    "balanced_model_means", "A23 A24 O4 F2",
    with_views(*VIEWS, select=BALANCED_SQL + f"""
SELECT g AS model, unit_count, priced_unit_count, item_count, ci_n, {r6('metric_value price_value ci_low ci_high')} FROM grouped"""),
)
def balanced_model_means(spark, sf_dir):
    rows = lb.with_interval(board(spark, sf_dir), "accuracy")
    out = lb.balanced_aggregate(rows, ["model"], "task", "accuracy", "estimated_cost_usd")
    return rounded(lb.group_entries(out, "accuracy", "model"))


@query(
    "metric_distribution", "A25",
    with_views(*VIEWS, select=f"""
SELECT task, count(accuracy) AS n, {rd('min(accuracy)')} AS min, {rd('quantile_cont(accuracy, 0.25)')} AS q1, {rd('quantile_cont(accuracy, 0.5)')} AS median,
  {rd('quantile_cont(accuracy, 0.75)')} AS q3, {rd('max(accuracy)')} AS max FROM board GROUP BY task"""),
)
def metric_distribution(spark, sf_dir):
    return rounded(lb.distribution(board(spark, sf_dir), ["task"], "accuracy"))


@query(
    "attempt_time_quantiles", "A25 A11",
    f"""SELECT event_type, count(value) AS n, {rd('quantile_cont(value, 0.05)')} AS p05, {rd('quantile_cont(value, 0.5)')} AS p50, {rd('quantile_cont(value, 0.95)')} AS p95
FROM events GROUP BY event_type""",
)
def attempt_time_quantiles(spark, sf_dir):
    return rounded(exact_quantiles(fx.table(spark, sf_dir, "events"), ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


@query(
    "line_price_quantiles", "A25",
    f"""SELECT l_returnflag, count(*) AS n, {rd('quantile_cont(l_extendedprice, 0.25)')} AS q1, {rd('quantile_cont(l_extendedprice, 0.5)')} AS median,
{rd('quantile_cont(l_extendedprice, 0.75)')} AS q3 FROM lineitem GROUP BY ALL""",
)
def line_price_quantiles(spark, sf_dir):
    """Quartiles over large groups, where the bracketing pass is used."""
    return rounded(exact_quantiles(fx.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75}))


@query(
    "dashboard_kpis", "A26",
    with_views(*VIEWS, select=f"""
SELECT count(*) AS runs, count(DISTINCT task) AS tasks, {rd('max(accuracy)')} AS best_accuracy, CAST(sum(coalesce(requests_total, 0)) AS BIGINT) AS requests FROM board"""),
)
def dashboard_kpis(spark, sf_dir):
    return rounded(lb.kpis(board(spark, sf_dir)))


METRIC_LONG = """
, long AS (UNPIVOT (SELECT file_name, accuracy, cohen_kappa, macro_f1, calibration_ece, estimated_cost_usd FROM board)
  ON accuracy, cohen_kappa, macro_f1, calibration_ece, estimated_cost_usd INTO NAME metric VALUE value)
"""
LONG_METRICS = ["accuracy", "cohen_kappa", "macro_f1", "calibration_ece", "estimated_cost_usd"]


@query(
    "preferred_metric_values", "A27 P29",
    with_views(*VIEWS, select=METRIC_LONG + f"""
SELECT metric, {rd("CASE WHEN metric IN ('calibration_ece', 'estimated_cost_usd') THEN min(value) ELSE max(value) END")} AS preferred FROM long GROUP BY metric"""),
)
def preferred_metric_values(spark, sf_dir):
    return rounded(lb.preferred_values(lb.metric_values(board(spark, sf_dir), ["file_name"], LONG_METRICS)))


@query(
    "highlighted_metric_cells", "A27 P29",
    with_views(*VIEWS, select=METRIC_LONG + f"""
, best AS (SELECT metric, CASE WHEN metric IN ('calibration_ece', 'estimated_cost_usd') THEN min(value) ELSE max(value) END AS b FROM long GROUP BY metric)
SELECT file_name, metric, {rd('value')} AS value FROM long JOIN best USING (metric) WHERE value = b"""),
)
def highlighted_metric_cells(spark, sf_dir):
    cells = lb.highlighted(lb.metric_values(board(spark, sf_dir), ["file_name"], LONG_METRICS))
    return rounded(cells.filter("is_preferred").select("file_name", "metric", "value"))


@query(
    "top_run", "W4",
    with_views(*VIEWS, select=f"SELECT file_name, {rd('cohen_kappa')} AS cohen_kappa FROM board ORDER BY board.cohen_kappa DESC NULLS LAST, started DESC NULLS LAST, file_name LIMIT 1"),
)
def top_run(spark, sf_dir):
    return rounded(lb.top_run(board(spark, sf_dir), "cohen_kappa").select("file_name", "cohen_kappa"))


@query(
    "best_run_per_task", "W5",
    with_views(*VIEWS, select=f"""
SELECT task, file_name, model, {rd('accuracy')} AS metric_value FROM board WHERE accuracy IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY task ORDER BY board.accuracy DESC, macro_f1 DESC, started DESC NULLS LAST, file_name) = 1"""),
)
def best_run_per_task(spark, sf_dir):
    return rounded(lb.best_per_task(board(spark, sf_dir), "accuracy"))


@query(
    "last_row_per_file", "W8 S1",
    """SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def last_row_per_file(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("path"), "o_orderdate", "o_orderkey", "o_orderpriority"
    )
    return lb.last_per_file(rows, "path", ["o_orderdate", "o_orderkey"]).select("path", "o_orderkey", "o_orderpriority")


@query(
    "accuracy_over_time", "O9 P14",
    with_views(*VIEWS, select=f"""
SELECT strftime(started, '%Y-%m-%d %H:%M') AS time, {rd('accuracy')} AS accuracy FROM board WHERE started IS NOT NULL AND accuracy IS NOT NULL"""),
)
def accuracy_over_time(spark, sf_dir):
    return rounded(lb.time_series(board(spark, sf_dir), "accuracy").select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("time"), "accuracy"))


SCATTER_SQL = BALANCED_SQL + """
, with_metric AS (SELECT * FROM bounds WHERE accuracy IS NOT NULL),
unit2 AS (SELECT model AS g, task AS u, avg(accuracy) AS m, avg(estimated_cost_usd) AS p, count(lo) AS cis, sum(pow((hi - lo) / 2 / 1.96 / 100, 2)) AS var FROM with_metric GROUP BY model, task),
unit2_ci AS (SELECT *, CASE WHEN cis > 0 THEN greatest(0, m - 196 * sqrt(var) / cis) END AS ulo, CASE WHEN cis > 0 THEN least(100, m + 196 * sqrt(var) / cis) END AS uhi FROM unit2),
balanced2 AS (SELECT g, avg(m) AS metric_value, avg(p) AS price_value, count(m) AS unit_count,
    greatest(0, avg(m) - 196 * sqrt(sum(pow((uhi - ulo) / 2 / 1.96 / 100, 2))) / count(ulo)) AS ci_low,
    least(100, avg(m) + 196 * sqrt(sum(pow((uhi - ulo) / 2 / 1.96 / 100, 2))) / count(ulo)) AS ci_high FROM unit2_ci GROUP BY g),
shape AS (SELECT model AS g, count(*) AS count, count(*) FILTER (WHERE estimated_cost_usd IS NULL) AS unknown_price_count,
    CASE WHEN min(suffix) = max(suffix) THEN min(suffix) ELSE '' END AS sfx, arg_min(file_name, (-accuracy, coalesce(-epoch(started), 1e300), file_name)) AS representative FROM with_metric GROUP BY model)
"""


@query(
    "price_scatter_by_model", "A31 A38 O8 A24",
    with_views(*VIEWS, select=SCATTER_SQL + f"""
SELECT g AS group_key, CASE WHEN sfx <> '' THEN g || ' ' || sfx ELSE g END AS label, count, unit_count, unknown_price_count, unknown_price_count < count AS has_known_price,
  {r6('price_value metric_value ci_low ci_high')}, representative FROM balanced2 JOIN shape USING (g)"""),
)
def price_scatter_by_model(spark, sf_dir):
    return rounded(lb.scatter(board(spark, sf_dir), "accuracy", "model"))


@query(
    "price_scatter_per_run", "A31 P28 O8 P20",
    with_views(*VIEWS, select=CI_SQL + f"""
SELECT file_name AS group_key, task || ' / ' || model || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS label, CAST(1 AS BIGINT) AS count, CAST(1 AS BIGINT) AS unit_count,
  CASE WHEN estimated_cost_usd IS NULL THEN 1 ELSE 0 END::BIGINT AS unknown_price_count, estimated_cost_usd IS NOT NULL AS has_known_price,
  {rd('estimated_cost_usd / coalesce(prediction_count, total_examples, truth_label_count)')} AS price_value, {rd('accuracy')} AS metric_value, {rd('lo')} AS ci_low, {rd('hi')} AS ci_high,
  file_name AS representative FROM bounds WHERE accuracy IS NOT NULL"""),
)
def price_scatter_per_run(spark, sf_dir):
    return rounded(lb.scatter(board(spark, sf_dir), "accuracy", "none", per_prediction=True))


@query(
    "model_tag_profile", "A28 P46",
    with_views(*VIEWS, select=f"""
, cells AS (SELECT model, tag AS axis, avg(accuracy) AS value FROM (SELECT model, unnest(tags) AS tag, accuracy FROM board) GROUP BY ALL),
means AS (SELECT model, avg(value) AS model_mean FROM cells GROUP BY model)
SELECT model, axis, {r6('value model_mean')}, {rd('coalesce(pow(least(100, greatest(0, value)) / 100, 2.5), 0)')} AS ratio FROM cells JOIN means USING (model)"""),
)
def model_tag_profile(spark, sf_dir):
    return rounded(lb.profile_ratios(lb.profile_matrix(board(spark, sf_dir), "accuracy", "tag"), "accuracy", contrast=True))


@query(
    "model_task_cost_profile", "A28 P46",
    with_views(*VIEWS, select=f"""
, cells AS (SELECT model, task AS axis, avg(cohen_kappa) AS value FROM board GROUP BY ALL),
means AS (SELECT model, avg(value) AS model_mean FROM cells GROUP BY model)
SELECT model, axis, {r6('value model_mean')}, {rd('(value + 1) / 2')} AS ratio FROM cells JOIN means USING (model)"""),
)
def model_task_cost_profile(spark, sf_dir):
    return rounded(lb.profile_ratios(lb.profile_matrix(board(spark, sf_dir), "cohen_kappa"), "cohen_kappa"))


@query(
    "token_profile", "A29 O10 P20",
    with_views(*VIEWS, select=f"""
, n_of AS (SELECT *, coalesce(prediction_count, total_examples, truth_label_count, 0) AS n FROM board)
SELECT file_name, model || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS model_display, {rd('input_tokens / n')} AS avg_input, {rd('coalesce(cached_tokens, 0) / n')} AS avg_cached,
  {rd('output_tokens / n')} AS avg_output, {rd('run_id * 3.0 / n')} AS avg_thinking FROM n_of"""),
)
def token_profile(spark, sf_dir):
    rows = lb.token_profile(board(spark, sf_dir)).orderBy(*lb.token_profile_order())
    return rounded(rows.select("file_name", "model_display", "avg_input", "avg_cached", "avg_output", "avg_thinking"))


@query(
    "facets", "A36 P13",
    with_views(*VIEWS, select="""
SELECT facet, value, count(*) AS runs FROM (SELECT 'task' AS facet, task AS value FROM board UNION ALL SELECT 'model', model FROM board
  UNION ALL SELECT 'tag', unnest(tags) FROM board) GROUP BY ALL"""),
)
def facets(spark, sf_dir):
    return lb.facets(board(spark, sf_dir))


@query(
    "facet_search", "P30 P48",
    with_views(*VIEWS, select="""
SELECT DISTINCT value FROM (SELECT unnest(tags) AS value FROM board) WHERE contains(lower(value), 'n_1') OR value IN ('gold')"""),
)
def facet_search(spark, sf_dir):
    options = lb.facets(board(spark, sf_dir)).filter("facet = 'tag'").select("value")
    return lb.search_options(options, " N_1 ", ["gold"])


@query(
    "joined_task_labels", "A37",
    with_views(*VIEWS, select="SELECT model_display, string_agg(DISTINCT task, ' + ' ORDER BY task) AS label FROM (SELECT *, model || CASE WHEN suffix <> '' THEN ' ' || suffix ELSE '' END AS model_display FROM board) GROUP BY ALL"),
)
def joined_task_labels(spark, sf_dir):
    return lb.joined_labels(board(spark, sf_dir), ["model_display"], "task")


@query(
    "symlog_scale", "P45",
    with_views(*VIEWS, select=f"""
, k AS (SELECT task, coalesce(greatest(0.01, least(0.5, quantile_cont(CASE WHEN estimated_cost_usd > 0 THEN estimated_cost_usd END, 0.25) / 2)), 0.1) AS c FROM board GROUP BY task)
SELECT file_name, {rd('c')} AS constant, {rd('coalesce(ln(1 + abs(estimated_cost_usd) / c), 0)')} AS position, {rd('coalesce(estimated_cost_usd, 0)')} AS restored
FROM board JOIN k USING (task)"""),
)
def symlog_scale(spark, sf_dir):
    b = board(spark, sf_dir)
    q = exact_quantiles(b.filter("estimated_cost_usd > 0"), ["task"], "estimated_cost_usd", {"q1": 0.25}).drop("n")
    rows = b.join(q, "task", "left").withColumn("constant", numbers.symlog_constant(F.col("q1")))
    rows = rows.withColumn("position", numbers.symlog(F.col("estimated_cost_usd"), F.col("constant")))
    return rounded(rows.select("file_name", "constant", "position", numbers.symlog_inverse(F.col("position"), F.col("constant")).alias("restored")))


@query(
    "allowed_tag_selection", "P48 P13",
    with_views(RUNS, select="""
SELECT run_id, CASE WHEN run_id % 3 = 0 THEN n_name || '|open source' WHEN run_id % 3 = 1 THEN n_name || '|gold' ELSE n_name END AS chosen
FROM (SELECT run_id, split_part(tags_text, ';', 1) AS n_name FROM runs)"""),
)
def allowed_tag_selection(spark, sf_dir):
    """A selection with blanks, repeats and unknown tags, cut down to the tags of each run."""
    r = fx.runs(spark, sf_dir).withColumn("tags", split_tags(F.col("tags_text")))
    nation = F.get("tags", F.lit(0))
    chosen = F.array(F.concat(F.lit(" "), nation), F.lit(""), nation, F.lit("gold "), F.lit("nowhere"), F.lit("open source"), F.lit("gold"))
    return r.select("run_id", F.array_join(allowed_selection(chosen, F.col("tags")), "|").alias("chosen"))
