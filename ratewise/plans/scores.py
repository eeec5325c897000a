"""Queries on scores of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratewise.operators import metrics
from ratewise.plans import fixtures as fx
from ratewise.plans.oracle import PREDICTIONS, SCORES, with_views
from ratewise.plans.registry import query


def rounded(df, *names, digits: int = 6):
    """Doubles rounded, so that the order of summing cannot show."""
    cols = names or [n for n, t in df.dtypes if t == "double"]
    for n in cols:
        # The small addend decides exact ties the same way in every engine and turns -0 into 0.
        df = df.withColumn(n, F.round(F.col(n) + F.lit(1e-9), digits))
    return df


def rd(expr: str) -> str:
    """One SQL expression rounded like :func:`rounded`."""
    return f"round({expr} + 1e-9, 6)"


def r6(names: str) -> str:
    """SQL counterpart of :func:`rounded` for a list of columns."""
    return ", ".join(f"{rd(n)} AS {n}" for n in names.split())


def scores_of(spark, sf_dir):
    return metrics.run_scores(metrics.confusion_counts(fx.predictions(spark, sf_dir)))


@query(
    "run_scores", "A1 A3 A4",
    with_views(PREDICTIONS, SCORES, select=f"""
SELECT run_id, evaluated, correct, labels, {r6('accuracy macro_precision macro_recall macro_f1 cohen_kappa')} FROM scores"""),
)
def run_scores(spark, sf_dir):
    return rounded(scores_of(spark, sf_dir))


@query(
    "run_counts", "A1",
    with_views(PREDICTIONS, select="""
SELECT run_id, count(prediction) AS prediction_count, count(truth) AS truth_label_count, count(*) AS evaluated_example_count,
       count(*) AS total_examples, count(*) FILTER (WHERE truth = prediction) AS correct,
       round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS accuracy
FROM predictions GROUP BY run_id"""),
)
def run_counts(spark, sf_dir):
    return rounded(metrics.run_counts(fx.predictions(spark, sf_dir)))


@query(
    "confusion_counts", "A2",
    with_views(PREDICTIONS, select="SELECT run_id, truth, prediction, count(*) AS n FROM predictions GROUP BY ALL"),
)
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(fx.predictions(spark, sf_dir))


@query(
    "confusion_triplets", "A2",
    with_views(PREDICTIONS, select="""
, labels_of AS (SELECT run_id, label, row_number() OVER (PARTITION BY run_id ORDER BY label) - 1 AS pos
  FROM (SELECT DISTINCT run_id, truth AS label FROM predictions UNION SELECT DISTINCT run_id, prediction FROM predictions))
SELECT c.run_id, CAST(t.pos AS INTEGER) AS i, CAST(p.pos AS INTEGER) AS j, count(*) AS n
FROM predictions c JOIN labels_of t ON c.run_id = t.run_id AND c.truth = t.label
JOIN labels_of p ON c.run_id = p.run_id AND c.prediction = p.label GROUP BY ALL"""),
)
def confusion_triplets(spark, sf_dir):
    return metrics.confusion_triplets(metrics.confusion_counts(fx.predictions(spark, sf_dir)))


@query(
    "kappa_from_stored_matrix", "A2 A4",
    with_views(PREDICTIONS, SCORES, select=f"""
SELECT run_id, CASE WHEN run_id % 5 = 3 THEN NULL ELSE {rd('cohen_kappa')} END AS derived_kappa FROM scores"""),
)
def kappa_from_stored_matrix(spark, sf_dir):
    """Runs store their matrix as triplets (even) or as a map (odd); every fifth has one broken triplet."""
    conf = metrics.confusion_counts(fx.predictions(spark, sf_dir))
    labels = metrics.label_margins(conf).groupBy("run_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    trip = metrics.confusion_triplets(conf).groupBy("run_id").agg(
        F.collect_list(F.array(F.col("i").cast("double"), F.col("j").cast("double"), F.col("n").cast("double"))).alias("t")
    )
    rows = conf.groupBy("run_id", "truth").agg(F.map_from_entries(F.collect_list(F.struct("prediction", F.col("n").cast("double")))).alias("row"))
    dense = rows.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("truth", "row"))).alias("d"))
    broken = F.concat("t", F.array(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    stored = (
        labels.join(trip, "run_id").join(dense, "run_id")
        .withColumn("confusion_matrix_sparse", F.when(F.col("run_id") % 5 == 3, broken).when(F.col("run_id") % 2 == 0, F.col("t")))
        .withColumn("confusion_matrix", F.when(F.col("run_id") % 2 == 1, F.col("d")))
    )
    return rounded(metrics.triplets_to_confusion(stored, "run_id"))


@query(
    "label_scores", "A3",
    with_views(PREDICTIONS, SCORES, select="""
SELECT run_id, label, CAST(hits AS BIGINT) AS hits, CAST(actual AS BIGINT) AS actual, CAST(predicted AS BIGINT) AS predicted,
       round(p + 1e-9, 6) AS label_precision, round(r + 1e-9, 6) AS label_recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END + 1e-9, 6) AS label_f1 FROM label_scores"""),
)
def label_scores(spark, sf_dir):
    return rounded(metrics.label_scores(metrics.confusion_counts(fx.predictions(spark, sf_dir))))


CALIBRATION_SQL = """
, bins AS (SELECT run_id, least(floor(confidence * 10), 9) AS bin, count(*) AS n,
    avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(confidence) AS mean_confidence,
    sum(pow(confidence - CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END, 2)) AS brier
  FROM predictions WHERE confidence BETWEEN 0 AND 1 GROUP BY 1, 2)"""


@query(
    "calibration", "A6",
    with_views(PREDICTIONS, select=CALIBRATION_SQL + """
SELECT run_id, CAST(sum(n) AS BIGINT) AS sample_count, round(sum(abs(hit_rate - mean_confidence) * n) / sum(n) + 1e-9, 6) AS ece,
       round(max(abs(hit_rate - mean_confidence)) + 1e-9, 6) AS mce, round(sum(brier) / sum(n) + 1e-9, 6) AS brier_score
FROM bins GROUP BY run_id"""),
)
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(fx.predictions(spark, sf_dir)))


@query(
    "calibration_bins", "A6",
    with_views(PREDICTIONS, select=CALIBRATION_SQL + """
SELECT run_id, CAST(bin AS BIGINT) AS bin, n, round(hit_rate + 1e-9, 6) AS hit_rate, round(mean_confidence + 1e-9, 6) AS mean_confidence FROM bins"""),
)
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(fx.predictions(spark, sf_dir)))
