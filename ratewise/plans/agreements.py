"""Queries on agreement between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.functions.text import split_tags
from ratewise.operators import agreement, interrater, linkage
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import PREDICTIONS, RUNS, SCORES, with_views
from ratewise.plans.registry import query
from ratewise.plans.scores import r6, rd, rounded, scores_of
from ratewise.session import cut_lineage

GROUP = ["task", "model"]


def grouped_predictions(spark, sf_dir):
    """Predictions with their groups, and as many rows without an item or a run, which no measure may count."""
    runs = fx.runs(spark, sf_dir).select("run_id", "task", "model", "temperature")
    whole = fx.predictions(spark, sf_dir).join(runs, "run_id")
    odd = F.col("id") % 2 == 1
    # Both kinds of rows come from one pass: a union would derive the predictions twice.
    both = whole.withColumn("gap", F.explode(F.array(F.lit(False), F.lit(True))))
    run = F.when(~F.col("gap") | odd, F.col("run_id"))
    return both.withColumn("run_id", run).withColumn("id", F.when(~F.col("gap") | ~odd, F.col("id"))).drop("gap")


# Alpha over all rater pairs of an item, the definition of the coincidence matrix.
ALPHA_BY_PAIRS = """
, rated AS ({rated}),
m AS (SELECT {g}, id, count(*) AS m FROM rated GROUP BY ALL),
units AS (SELECT r.*, m.m FROM rated r JOIN m USING ({g}, id)),
coincidence AS (
  SELECT {ag}, a.prediction AS c, b.prediction AS k, sum(1.0 / (a.m - 1)) AS o
  FROM units a JOIN units b ON {join} AND a.id = b.id AND a.run_id <> b.run_id GROUP BY ALL),
margin AS (SELECT {g}, c, sum(o) AS n_c FROM coincidence GROUP BY ALL),
totals AS (SELECT {g}, sum(n_c) AS n, sum(n_c * n_c) AS sq FROM margin GROUP BY ALL),
apart AS (SELECT {g}, sum(o) FILTER (WHERE c <> k) AS d FROM coincidence GROUP BY ALL),
alphas AS (SELECT {g}, 1 - (coalesce(d, 0) / n) / ((n * n - sq) / (n * (n - 1))) AS alpha_nominal FROM totals JOIN apart USING ({g})),
sizes AS (SELECT {g}, count(DISTINCT run_id) AS run_count, count(DISTINCT prediction) AS category_count FROM rated GROUP BY ALL),
items AS (SELECT {g}, count(*) FILTER (WHERE m >= 2) AS pairable_item_count, count(*) AS rated_item_count,
  count(*) FILTER (WHERE m = run_count) AS fully_shared_item_count FROM m JOIN sizes USING ({g}) GROUP BY ALL)
"""


def alpha_sql(rated: str, group: list[str]) -> str:
    return ALPHA_BY_PAIRS.format(
        rated=rated,
        g=", ".join(group),
        ag=", ".join(f"a.{c}" for c in group),
        join=" AND ".join(f"a.{c} = b.{c}" for c in group),
    )


@query(
    "alpha_per_task_and_model", "A7",
    with_views(PREDICTIONS, RUNS, select=alpha_sql(
        "SELECT task, model, run_id, id, prediction FROM predictions JOIN runs USING (run_id)", GROUP) + f"""
SELECT task, model, run_count, {rd('alpha_nominal')} AS alpha_nominal, pairable_item_count, rated_item_count, fully_shared_item_count, category_count
FROM sizes JOIN items USING (task, model) LEFT JOIN alphas USING (task, model)"""),
)
def alpha_per_task_and_model(spark, sf_dir):
    return rounded(agreement.alpha_nominal(grouped_predictions(spark, sf_dir), GROUP))


PAIRS_SQL = """
, rated AS (SELECT task, model, run_id, id, prediction FROM predictions JOIN runs USING (run_id)),
pairs AS (SELECT a.task, a.model, a.run_id AS run_a, b.run_id AS run_b, count(*) AS overlap_count,
    count(*) FILTER (WHERE a.prediction = b.prediction) AS agreement_count
  FROM rated a JOIN rated b ON a.task = b.task AND a.model = b.model AND a.id = b.id AND a.run_id < b.run_id GROUP BY ALL)
"""


@query(
    "run_pair_distances", "A8 J7 U2",
    with_views(PREDICTIONS, RUNS, select=PAIRS_SQL + f"""
SELECT *, overlap_count - agreement_count AS disagreement_count, {rd('(overlap_count - agreement_count) / overlap_count')} AS distance FROM pairs"""),
)
def run_pair_distances(spark, sf_dir):
    return rounded(agreement.pair_distances(agreement.run_pair_counts(grouped_predictions(spark, sf_dir), GROUP)))


KAPPA_SQL = """
, shared AS (SELECT a.task, a.model, a.run_id AS run_a, b.run_id AS run_b, a.prediction AS pa, b.prediction AS pb
  FROM (SELECT * FROM predictions JOIN runs USING (run_id)) a JOIN (SELECT * FROM predictions JOIN runs USING (run_id)) b
    ON a.task = b.task AND a.model = b.model AND a.id = b.id AND a.run_id < b.run_id),
n_of AS (SELECT task, model, run_a, run_b, count(*) AS overlap, count(*) FILTER (WHERE pa = pb) / count(*) AS agreement FROM shared GROUP BY ALL),
left_of AS (SELECT run_a, run_b, pa AS label, count(*) AS n FROM shared GROUP BY ALL),
right_of AS (SELECT run_a, run_b, pb AS label, count(*) AS n FROM shared GROUP BY ALL),
expected AS (SELECT run_a, run_b, sum(l.n * r.n) AS s FROM left_of l JOIN right_of r USING (run_a, run_b, label) GROUP BY ALL),
pair_scores AS (
  SELECT task, model, run_a, run_b, overlap, agreement,
    CASE WHEN abs(1 - coalesce(s, 0) / (overlap * overlap)) <= 1e-9 THEN CASE WHEN agreement = 1 THEN 1.0 END
         ELSE (agreement - coalesce(s, 0) / (overlap * overlap)) / (1 - coalesce(s, 0) / (overlap * overlap)) END AS kappa
  FROM n_of LEFT JOIN expected USING (run_a, run_b))
"""


@query(
    "run_pair_kappas", "A5 J7 U3",
    with_views(PREDICTIONS, RUNS, select=KAPPA_SQL + f"""
SELECT task, model, run_a, run_b, overlap, {r6('agreement kappa')} FROM pair_scores"""),
)
def run_pair_kappas(spark, sf_dir):
    return rounded(pair_scores(spark, sf_dir))


def pair_scores(spark, sf_dir):
    by_label = agreement.run_pair_counts(grouped_predictions(spark, sf_dir), GROUP, by_label=True)
    return agreement.pair_kappas(by_label, GROUP)


T_SQL = "CASE WHEN {n} < 2 THEN NULL ELSE coalesce(([12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086])[CAST({n} - 1 AS INT)], 1.96) END"


def t_interval_sql(value: str, prefix: str) -> str:
    """Mean, deviation and clamped t interval of a column, rounded."""
    n, mean = f"count({value})", f"avg({value})"
    sd = f"CASE WHEN {n} = 1 THEN 0.0 ELSE stddev_samp({value}) END"
    half = f"(CAST({T_SQL.format(n=n)} AS DOUBLE) * ({sd}) / sqrt({n}))"
    return (
        f"{rd(mean)} AS {prefix}_mean, {rd(f'({sd})')} AS {prefix}_sd, {rd(half)} AS {prefix}_ci95, "
        f"CASE WHEN {half} IS NOT NULL THEN {rd(f'greatest(0.0, {mean} - {half})')} END AS {prefix}_ci95_low, "
        f"CASE WHEN {half} IS NOT NULL THEN {rd(f'least(1.0, {mean} + {half})')} END AS {prefix}_ci95_high"
    )


@query(
    "run_pair_summary", "A16 A17",
    with_views(PREDICTIONS, RUNS, select=KAPPA_SQL + f"""
SELECT task, model, count(*) AS pair_count, {rd('avg(overlap)')} AS overlap_mean,
  {t_interval_sql('agreement', 'agreement')}, {t_interval_sql('kappa', 'kappa')}
FROM pair_scores GROUP BY task, model"""),
)
def run_pair_summary(spark, sf_dir):
    return rounded(agreement.pair_summary(pair_scores(spark, sf_dir), GROUP))


@query(
    "comparable_task_variants", "A9 P12",
    """
WITH runs AS (SELECT c_custkey AS run_id, c_mktsegment AS truth, c_nationkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'open source; x' ELSE 'X' END AS tags FROM customer)
SELECT run_id, min(run_id) OVER (PARTITION BY truth, id) AS first_run, count(*) OVER (PARTITION BY truth, id) AS runs_of_variant FROM runs""",
)
def comparable_task_variants(spark, sf_dir):
    """Customers as runs of one item: the same segment and nation make the same task, a publication tag does not matter."""
    c = fx.table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("truth"))
    text = F.when(F.col("c_custkey") % 2 == 0, "open source; x").otherwise("X")
    tags = c.select(F.col("c_custkey").alias("run_id"), split_tags(text).alias("tags"))
    keyed = agreement.task_variants(rows, tags)
    per = keyed.groupBy("variant").agg(F.min("run_id").alias("first_run"), F.count("*").alias("runs_of_variant"))
    return keyed.join(per, "variant").select("run_id", "first_run", "runs_of_variant")


def run_table(spark, sf_dir):
    """Runs with their scores."""
    return fx.runs(spark, sf_dir).join(scores_of(spark, sf_dir), "run_id")


def representatives_sql(order: str) -> str:
    return with_views(PREDICTIONS, SCORES, RUNS, select=f"""
SELECT task, provider, model, run_stem, stamp, {rd('accuracy')} AS accuracy FROM runs JOIN scores USING (run_id)
QUALIFY row_number() OVER (PARTITION BY task, provider, model ORDER BY {order}, run_stem DESC) = 1""")


@query("representatives_latest", "W7", representatives_sql("started DESC"))
def representatives_latest(spark, sf_dir):
    reps = agreement.representatives(run_table(spark, sf_dir), ["task", "provider", "model"], "latest")
    return rounded(reps.select("task", "provider", "model", "run_stem", "stamp", "accuracy"))


@query("representatives_best_accuracy", "W7", representatives_sql("accuracy DESC, started DESC"))
def representatives_best_accuracy(spark, sf_dir):
    reps = agreement.representatives(run_table(spark, sf_dir), ["task", "provider", "model"], "best_accuracy")
    return rounded(reps.select("task", "provider", "model", "run_stem", "stamp", "accuracy"))


@query(
    "agreement_summary", "A7 A10 W7",
    with_views(PREDICTIONS, SCORES, RUNS, select="""
, full_runs AS (SELECT * FROM runs JOIN scores USING (run_id)),
latest AS (SELECT * FROM full_runs QUALIFY row_number() OVER (PARTITION BY task, provider, model ORDER BY started DESC, run_stem DESC) = 1),
best AS (SELECT * FROM full_runs QUALIFY row_number() OVER (PARTITION BY task, provider, model ORDER BY accuracy DESC, started DESC, run_stem DESC) = 1),
chosen AS (SELECT 'repeat' AS scope, task, provider, model, run_id, run_stem FROM full_runs
  UNION ALL SELECT 'latest', task, '', '', run_id, run_stem FROM latest UNION ALL SELECT 'best_accuracy', task, '', '', run_id, run_stem FROM best),
stems AS (SELECT scope, task, provider, model, string_agg(run_stem, ',' ORDER BY run_stem) AS run_stems FROM chosen GROUP BY ALL HAVING count(*) >= 2)
""" + alpha_sql("SELECT scope, task, provider, model, run_id, id, prediction FROM predictions JOIN chosen USING (run_id) SEMI JOIN stems USING (scope, task, provider, model)",
                ["scope", "task", "provider", "model"]) + f"""
SELECT scope, task, provider, model, run_stems, run_count, {rd('alpha_nominal')} AS alpha_nominal, pairable_item_count, rated_item_count,
  fully_shared_item_count, category_count
FROM stems JOIN sizes USING (scope, task, provider, model) JOIN items USING (scope, task, provider, model) LEFT JOIN alphas USING (scope, task, provider, model)"""),
)
def agreement_summary(spark, sf_dir):
    out = agreement.agreement_summary(fx.predictions(spark, sf_dir), run_table(spark, sf_dir))
    return rounded(out.withColumn("run_stems", F.array_join("run_stems", ",")))


GROUPS_SQL = """
, groups AS (SELECT task || '/' || model AS group_id, row_number() OVER (ORDER BY task, model) AS position, list(run_stem) AS run_stems, max(run_id) AS top
  FROM runs GROUP BY task, model
  UNION ALL SELECT 'all ' || task, 1000 + row_number() OVER (ORDER BY task), list(run_stem), max(run_id) FROM runs WHERE run_id % 3 = 0 GROUP BY task),
member AS (SELECT group_id, position, top, unnest(run_stems) AS run_stem FROM groups)
"""


def group_entries(spark, sf_dir):
    """Agreement groups: per task and model, and over every third run of a task; alpha stands in by the largest run."""
    from pyspark.sql import Window

    runs = fx.runs(spark, sf_dir)
    base = runs.groupBy("task", "model").agg(F.collect_list("run_stem").alias("run_stems"), F.max("run_id").cast("double").alias("alpha_nominal"))
    one = base.withColumn("position", F.row_number().over(Window.orderBy("task", "model")))
    third = runs.filter("run_id % 3 = 0").groupBy("task").agg(F.collect_list("run_stem").alias("run_stems"), F.max("run_id").cast("double").alias("alpha_nominal"))
    two = third.withColumn("position", F.row_number().over(Window.orderBy("task")) + 1000)
    cols = ["position", "run_stems", "alpha_nominal"]
    return one.select(F.concat_ws("/", "task", "model").alias("group_id"), *cols).unionByName(
        two.select(F.concat(F.lit("all "), "task").alias("group_id"), *cols)
    )


@query(
    "runs_with_agreement", "J8 P29",
    with_views(RUNS, select=GROUPS_SQL + """
SELECT r.run_stem, r.task, r.model, m.group_id, CAST(m.top AS DOUBLE) AS repeat_alpha FROM runs r LEFT JOIN
  (SELECT * FROM member QUALIFY row_number() OVER (PARTITION BY run_stem ORDER BY position DESC) = 1) m USING (run_stem)"""),
)
def runs_with_agreement(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).select("run_stem", "task", "model")
    return agreement.with_agreement(runs, group_entries(spark, sf_dir))


@query(
    "fully_visible_groups", "J9",
    with_views(RUNS, select=GROUPS_SQL + """
SELECT group_id, count(*) AS members FROM member GROUP BY group_id
HAVING count(*) >= 2 AND bool_and(run_stem IN (SELECT run_stem FROM runs WHERE run_id % 5 <> 4 OR task = 'ASIA'))"""),
)
def fully_visible_groups(spark, sf_dir):
    visible = fx.runs(spark, sf_dir).filter("run_id % 5 <> 4 or task = 'ASIA'")
    kept = agreement.fully_visible(group_entries(spark, sf_dir), visible)
    return kept.select("group_id", F.size("run_stems").cast("long").alias("members"))


def pair_table(spark, sf_dir):
    """Pair distances on member indices, the form in which cluster files store them."""
    # Positions and distances both read the pairs: written once instead of counted twice.
    pairs = cut_lineage(agreement.pair_distances(agreement.run_pair_counts(grouped_predictions(spark, sf_dir), GROUP)), "pairs")
    pos = agreement.member_positions(pairs, GROUP)
    a = pos.select(*GROUP, F.col("run_id").alias("run_a"), F.col("position").alias("a"))
    b = pos.select(*GROUP, F.col("run_id").alias("run_b"), F.col("position").alias("b"))
    group_id = F.concat_ws("/", *GROUP).alias("group_id")
    indexed = pairs.join(a, [*GROUP, "run_a"]).join(b, [*GROUP, "run_b"]).select(group_id, "a", "b", "distance")
    members = pos.select(group_id, "position", "run_id")
    return indexed, members


@query(
    "visible_cluster_pairs", "J10",
    with_views(PREDICTIONS, RUNS, select=PAIRS_SQL + f"""
, members AS (SELECT DISTINCT task, model, run_id FROM (SELECT task, model, run_a AS run_id FROM pairs UNION ALL SELECT task, model, run_b FROM pairs)),
kept AS (SELECT task, model, run_id, row_number() OVER (PARTITION BY task, model ORDER BY run_id) - 1 AS pos, count(*) OVER (PARTITION BY task, model) AS n
  FROM members WHERE run_id % 3 <> 1)
SELECT p.task || '/' || p.model AS group_id, CAST(x.pos AS INTEGER) AS a, CAST(y.pos AS INTEGER) AS b,
  {rd('(overlap_count - agreement_count) / overlap_count')} AS distance
FROM pairs p JOIN kept x ON p.run_a = x.run_id JOIN kept y ON p.run_b = y.run_id WHERE x.n >= 2"""),
)
def visible_cluster_pairs(spark, sf_dir):
    pairs, members = pair_table(spark, sf_dir)
    stems = members.withColumn("run_stem", F.col("run_id").cast("string"))
    visible = stems.filter("run_id % 3 <> 1")
    kept = agreement.visible_members(stems, visible)
    return rounded(agreement.visible_pairs(pairs, kept))


# The same merges by recursion over the pairs of living clusters, with distances summed as whole trillionths.
TREES_SQL = """
, members AS (SELECT DISTINCT task, model, unnest([run_a, run_b]) AS run_id FROM pairs),
placed AS (SELECT *, row_number() OVER (PARTITION BY task, model ORDER BY run_id) - 1 AS pos FROM members),
leaves AS (SELECT task || '/' || model AS g, count(*) AS n FROM members GROUP BY ALL),
state AS (
  SELECT g, 0 AS step, n, x.pos AS a, y.pos AS b, CAST(round((overlap_count - agreement_count) / overlap_count * 1e12) AS HUGEINT) AS total, CAST(1 AS HUGEINT) AS known, 1 AS sa, 1 AS sb
  FROM pairs p JOIN placed x ON p.run_a = x.run_id AND p.task = x.task AND p.model = x.model JOIN placed y ON p.run_b = y.run_id AND p.task = y.task AND p.model = y.model
    JOIN leaves l ON l.g = p.task || '/' || p.model
  UNION ALL
  SELECT g, step, n, least(a, b), greatest(a, b), sum(total), sum(known), max(CASE WHEN a < b THEN sa ELSE sb END), max(CASE WHEN a < b THEN sb ELSE sa END)
  FROM (
    SELECT g, step + 1 AS step, n, total, known, CASE WHEN a IN (l, r) THEN n + step ELSE a END AS a, CASE WHEN b IN (l, r) THEN n + step ELSE b END AS b,
      CASE WHEN a IN (l, r) THEN size ELSE sa END AS sa, CASE WHEN b IN (l, r) THEN size ELSE sb END AS sb
    FROM (SELECT *, first_value(a) OVER w AS l, first_value(b) OVER w AS r, first_value(sa + sb) OVER w AS size FROM state
          WINDOW w AS (PARTITION BY g ORDER BY CAST(total AS DOUBLE) / CAST(known AS DOUBLE), a, b))
    WHERE NOT (a = l AND b = r))
  GROUP BY g, step, n, least(a, b), greatest(a, b)
),
merges AS (
  SELECT g, n, step, a AS l, b AS r, CAST(total AS DOUBLE) / CAST(known AS DOUBLE) / 1e12 AS distance, sa + sb AS size FROM state
  QUALIFY row_number() OVER (PARTITION BY g, step ORDER BY CAST(total AS DOUBLE) / CAST(known AS DOUBLE), a, b) = 1),
steps AS (SELECT * FROM merges WHERE g IN (SELECT g FROM merges GROUP BY g, n HAVING count(*) = n - 1))
"""
LEAVES_SQL = """
, walk AS (
  SELECT g, n, 2 * n - 2 AS node, '' AS path FROM leaves WHERE g IN (SELECT g FROM steps)
  UNION ALL
  SELECT w.g, w.n, CASE side WHEN 0 THEN s.l ELSE s.r END, path || side FROM walk w JOIN steps s ON s.g = w.g AND s.step = w.node - w.n, (VALUES (0), (1)) v(side)
)
"""


@query(
    "agreement_trees", "D15 A8",
    with_views(PREDICTIONS, RUNS, select=PAIRS_SQL + TREES_SQL + f"""
SELECT g AS group_id, CAST(step AS INTEGER) AS step, CAST(l AS INTEGER) AS "left", CAST(r AS INTEGER) AS "right", {rd('distance')} AS distance, CAST(size AS INTEGER) AS size FROM steps"""),
)
def agreement_trees(spark, sf_dir):
    pairs, members = pair_table(spark, sf_dir)
    sizes = members.groupBy("group_id").agg(F.count("*").alias("leaves"))
    return rounded(linkage.average_linkage(pairs, sizes))


@query(
    "agreement_tree_leaves", "D16",
    with_views(PREDICTIONS, RUNS, select=PAIRS_SQL + TREES_SQL + LEAVES_SQL + """
SELECT g AS group_id, CAST(node AS INTEGER) AS leaf, CAST(row_number() OVER (PARTITION BY g ORDER BY path) - 1 AS INTEGER) AS position FROM walk WHERE node < n
UNION ALL
SELECT g, CAST(unnest(range(n)) AS INTEGER), CAST(unnest(range(n)) AS INTEGER) FROM leaves WHERE g NOT IN (SELECT g FROM steps)"""),
)
def agreement_tree_leaves(spark, sf_dir):
    pairs, members = pair_table(spark, sf_dir)
    sizes = members.groupBy("group_id").agg(F.count("*").alias("leaves"))
    return linkage.leaf_order(linkage.average_linkage(pairs, sizes), sizes)


# Runs count as complete when they have the task's usual number of rows; every seventh has no metrics file.
STATUS_SQL = """
, outputs AS (SELECT run_stem AS base_name, run_id, evaluated AS output_rows, stamp FROM runs JOIN scores USING (run_id) WHERE run_id % 11 <> 5),
found AS (SELECT run_stem AS base_name, run_id, stamp, model, temperature, evaluated AS total_examples,
    CASE WHEN run_id % 13 <> 2 THEN accuracy END AS accuracy, macro_f1, cohen_kappa FROM runs JOIN scores USING (run_id) WHERE run_id % 7 <> 3),
logs AS (SELECT run_stem AS base_name, model, temperature FROM runs WHERE run_id % 2 = 1),
collected AS (
  SELECT coalesce(o.base_name, f.base_name) AS base_name, coalesce(o.stamp, f.stamp) AS stamp,
    CASE WHEN f.base_name IS NOT NULL THEN f.model ELSE l.model END AS model,
    CASE WHEN f.base_name IS NOT NULL THEN f.temperature ELSE l.temperature END AS temperature,
    output_rows, total_examples, accuracy, macro_f1, cohen_kappa, f.base_name IS NOT NULL AS has_metrics, l.base_name IS NOT NULL AS has_log,
    concat_ws('; ',
      CASE WHEN output_rows IS DISTINCT FROM (SELECT max(evaluated) FROM scores) AND output_rows IS NULL THEN 'output_rows=None'
           WHEN output_rows % 3 = 0 THEN 'output_rows=' || output_rows END,
      CASE WHEN f.base_name IS NULL THEN 'missing_metrics' END,
      CASE WHEN f.base_name IS NOT NULL AND total_examples % 3 = 0 THEN 'metrics_total_examples=' || total_examples END,
      CASE WHEN f.base_name IS NOT NULL AND accuracy IS NULL THEN 'missing_accuracy' END) AS fail_reason
  FROM outputs o FULL JOIN found f USING (base_name) LEFT JOIN logs l ON l.base_name = coalesce(o.base_name, f.base_name)),
judged AS (SELECT *, CASE WHEN fail_reason = '' THEN 'valid' ELSE 'fail' END AS status FROM collected)
"""


def collected_runs(spark, sf_dir, copies=None, scores=True):
    """Outputs, metrics and logs of the same runs, each with gaps. A run is complete unless its row count is a multiple of 3."""
    t = run_table(spark, sf_dir).withColumn("base_name", F.col("run_stem"))
    # Row counts are mapped to one expected number so that the rule can be tested on runs of many sizes.
    size = F.when(F.col("evaluated") % 3 == 0, F.col("evaluated")).otherwise(F.lit(-1)).cast("long")
    outputs = t.filter("run_id % 11 <> 5").select("base_name", size.alias("output_rows"))
    metrics = t.filter("run_id % 7 <> 3").select(
        "base_name", "provider", "model", "temperature", size.alias("total_examples"),
        F.when(F.col("run_id") % 13 != 2, F.col("accuracy")).alias("accuracy"), "macro_f1", "cohen_kappa",
    )
    logs = t.filter("run_id % 2 = 1").select("base_name", "provider", "model", "temperature")
    runs = interrater.collect_runs(outputs, metrics, logs, -1, copies, scores)
    from ratewise.functions.names import stamp_in_name

    return runs.withColumn("stamp", stamp_in_name(F.col("base_name")))


@query(
    "collected_run_status", "J2 P24 P5 U1 P9",
    with_views(PREDICTIONS, SCORES, RUNS, select=STATUS_SQL + """
SELECT base_name, stamp, model, temperature, has_metrics, has_log, status, fail_reason FROM judged"""),
)
def collected_run_status(spark, sf_dir):
    wanted = ["base_name", "stamp", "model", "temperature", "has_metrics", "has_log", "status", "fail_reason"]
    # Equal rows of the result stand next to each other, so that they take hardly any space in a file.
    runs = collected_runs(spark, sf_dir, "copies", scores=False).groupBy(*wanted).agg(F.sum("copies").alias("copies"))
    return interrater.repeated(runs, "copies")


@query(
    "model_temperature_summary", "A18 W6 A17",
    with_views(PREDICTIONS, SCORES, RUNS, select=STATUS_SQL + f"""
, v AS (SELECT *, CASE WHEN status = 'valid' THEN accuracy END AS va, CASE WHEN status = 'valid' THEN macro_f1 END AS vf,
    CASE WHEN status = 'valid' THEN cohen_kappa END AS vk,
    row_number() OVER (PARTITION BY model, temperature ORDER BY status DESC, CASE WHEN accuracy IS NULL OR accuracy = 0 THEN -1 ELSE accuracy END DESC, stamp, base_name) AS rn
  FROM judged WHERE model IS NOT NULL AND temperature IS NOT NULL)
SELECT model, temperature, count(*) AS runs_total, count(*) FILTER (WHERE status = 'valid') AS runs_valid, count(*) FILTER (WHERE status = 'fail') AS runs_failed,
  {t_interval_sql('va', 'accuracy')}, {rd('min(va)')} AS accuracy_min, {rd('max(va)')} AS accuracy_max, {rd('avg(vf)')} AS macro_f1_mean,
  {rd("(CASE WHEN count(vf) = 1 THEN 0.0 ELSE stddev_samp(vf) END)")} AS macro_f1_sd, {t_interval_sql('vk', 'cohen_kappa')},
  coalesce(max(CASE WHEN rn = 1 AND status = 'valid' THEN base_name END), '') AS best_run
FROM v GROUP BY model, temperature"""),
)
def model_temperature_summary(spark, sf_dir):
    return rounded(interrater.model_temperature_summary(collected_runs(spark, sf_dir, "copies"), copies="copies")).withColumn("temperature", F.col("temperature"))


@query(
    "completion_counts", "A19",
    with_views(PREDICTIONS, SCORES, RUNS, select=STATUS_SQL + """
SELECT model, temperature, count(*) FILTER (WHERE status = 'valid') AS valid, count(*) FILTER (WHERE status = 'fail') AS fail
FROM judged WHERE model IS NOT NULL AND temperature IS NOT NULL GROUP BY ALL"""),
)
def completion_counts(spark, sf_dir):
    return interrater.completion(collected_runs(spark, sf_dir, "copies"), "copies")


@query(
    "clusters_with_groups", "J30",
    with_views(PREDICTIONS, RUNS, select=PAIRS_SQL + f"""
SELECT c.group_id, c.pairs, g.run_count, {rd('c.distance')} AS mean_distance FROM
  (SELECT task || '/' || model AS group_id, count(*) AS pairs, avg((overlap_count - agreement_count) / overlap_count) AS distance FROM pairs GROUP BY ALL) c
  LEFT JOIN (SELECT task || '/' || model AS group_id, count(*) AS run_count FROM runs WHERE task <> 'ASIA' GROUP BY ALL) g USING (group_id)"""),
)
def clusters_with_groups(spark, sf_dir):
    pairs = agreement.pair_distances(agreement.run_pair_counts(grouped_predictions(spark, sf_dir), GROUP))
    clusters = pairs.groupBy(F.concat_ws("/", *GROUP).alias("group_id")).agg(F.count("*").alias("pairs"), F.avg("distance").alias("mean_distance"))
    groups = fx.runs(spark, sf_dir).filter("task <> 'ASIA'").groupBy(F.concat_ws("/", *GROUP).alias("group_id")).agg(F.count("*").alias("run_count"))
    return rounded(agreement.with_groups(clusters, groups).select("group_id", "pairs", "run_count", "mean_distance"))


@query(
    "runs_in_day_window", "P23 P5",
    with_views(RUNS, select="SELECT run_stem FROM runs WHERE substr(stamp, 1, 10) BETWEEN '2026-05-14' AND '2026-05-19'"),
)
def runs_in_day_window(spark, sf_dir):
    from ratewise.functions.names import stamp_in_name
    from ratewise.functions.times import day_in_window

    runs = fx.runs(spark, sf_dir).select("run_stem")
    return runs.filter(day_in_window(stamp_in_name(F.col("run_stem")), "2026-05-14", "2026-05-19"))
