"""Scores of runs against truth: confusion, per-label scores, kappa, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-12


def confusion_counts(preds: DataFrame, run: str = "run_id") -> DataFrame:
    """Long confusion matrix: one row per run, truth and prediction. Rows without truth do not count."""
    return (
        preds.filter(F.col("truth").isNotNull() & F.col("prediction").isNotNull())
        .groupBy(run, "truth", "prediction")
        .agg(F.count("*").alias("n"))
    )


def label_margins(confusion: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and label: hits, how often it is true, how often it is predicted."""
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.alias("hits"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted")),
    )
    return (
        confusion.select(run, F.explode(sides).alias("s"))
        .groupBy(run, F.col("s.label").alias("label"))
        .agg(F.sum("s.hits").alias("hits"), F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"))
    )


def label_scores(confusion: DataFrame, run: str = "run_id") -> DataFrame:
    """Precision, recall and F1 per run and label; an empty denominator gives 0."""
    p = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    return (
        label_margins(confusion, run)
        .withColumn("label_precision", p)
        .withColumn("label_recall", r)
        .withColumn(
            "label_f1",
            F.coalesce(
                F.try_divide(2 * F.col("label_precision") * F.col("label_recall"), F.col("label_precision") + F.col("label_recall")),
                F.lit(0.0),
            ),
        )
    )


def kappa_from_sums(total: Column, hits: Column, product_sum: Column) -> Column:
    """Kappa of a run: agreement corrected by the margins. A certain expectation gives 1 or 0, no rows give 0."""
    observed = F.try_divide(hits, total)
    expected = F.try_divide(product_sum, total * total)
    return (
        F.when(F.coalesce(total, F.lit(0)) <= 0, 0.0)
        .when(F.abs(1 - expected) <= EPS, F.when(F.abs(observed - 1) <= EPS, 1.0).otherwise(0.0))
        .otherwise(F.try_divide(observed - expected, 1 - expected))
    )


def run_scores(confusion: DataFrame, run: str = "run_id") -> DataFrame:
    """Accuracy, macro scores and kappa per run; everything after the confusion counts is small."""
    labels = label_scores(confusion, run)
    total = F.sum("actual")
    products = F.sum(F.col("actual").cast("double") * F.col("predicted"))
    return labels.groupBy(run).agg(
        total.alias("evaluated"),
        F.sum("hits").alias("correct"),
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        F.avg("label_precision").alias("macro_precision"),
        F.avg("label_recall").alias("macro_recall"),
        F.avg("label_f1").alias("macro_f1"),
        kappa_from_sums(total.cast("double"), F.sum("hits").cast("double"), products).alias("cohen_kappa"),
        F.count("*").alias("labels"),
    )


def run_counts(preds: DataFrame, run: str = "run_id") -> DataFrame:
    """Predictions, truth labels, evaluated rows and hits per run."""
    both = F.col("truth").isNotNull() & F.col("prediction").isNotNull()
    return preds.groupBy(run).agg(
        F.count("prediction").alias("prediction_count"),
        F.count("truth").alias("truth_label_count"),
        F.count_if(both).alias("evaluated_example_count"),
        F.count("*").alias("total_examples"),
        F.count_if(both & (F.col("truth") == F.col("prediction"))).alias("correct"),
        F.try_divide(F.count_if(both & (F.col("truth") == F.col("prediction"))), F.count_if(both)).alias("accuracy"),
    )


def confusion_triplets(confusion: DataFrame, run: str = "run_id") -> DataFrame:
    """Sparse form ``(run, i, j, n)``: positions in the sorted label list of the run."""
    labels = label_margins(confusion, run).select(run, "label")
    by_label = Window.partitionBy(run).orderBy("label")
    index = labels.withColumn("pos", F.row_number().over(by_label) - 1)
    t = index.select(run, F.col("label").alias("truth"), F.col("pos").alias("i"))
    p = index.select(run, F.col("label").alias("prediction"), F.col("pos").alias("j"))
    return confusion.join(t, [run, "truth"]).join(p, [run, "prediction"]).select(run, "i", "j", "n")


def triplets_to_confusion(payload: DataFrame, run: str = "run_stem") -> DataFrame:
    """Per run, kappa read from a stored matrix (``labels`` with sparse triplets or a dense map).

    One bad triplet voids the sparse form; bad cells of the dense form are left out. Triplets win over the map.
    """
    def known(pos: Column) -> Column:
        return (pos == F.floor(pos)) & (pos >= 0) & (pos < F.size("labels"))

    def triplet_ok(t: Column) -> Column:
        ok = (F.size(t) == 3) & known(F.get(t, F.lit(0))) & known(F.get(t, F.lit(1)))
        count = F.get(t, F.lit(2))
        return F.coalesce(ok & (count >= 0) & (count == F.floor(count)), F.lit(False))

    has_labels = F.coalesce(F.size("labels") > 0, F.lit(False))
    has_sparse = F.coalesce(F.size("confusion_matrix_sparse") > 0, F.lit(False))
    sparse_ok = F.coalesce(F.forall("confusion_matrix_sparse", triplet_ok), F.lit(False))
    cell = "struct<truth:string,prediction:string,n:double>"
    from_sparse = F.transform(
        F.filter("confusion_matrix_sparse", triplet_ok),
        lambda t: F.struct(
            F.get("labels", F.get(t, F.lit(0)).cast("int")).alias("truth"),
            F.get("labels", F.get(t, F.lit(1)).cast("int")).alias("prediction"),
            F.get(t, F.lit(2)).cast("double").alias("n"),
        ),
    )
    from_dense = F.flatten(
        F.transform(
            F.map_entries("confusion_matrix"),
            lambda row: F.transform(
                F.map_entries(row["value"]),
                lambda c: F.struct(row["key"].alias("truth"), c["key"].alias("prediction"), c["value"].cast("double").alias("n")),
            ),
        )
    )
    dense_ok = F.filter(
        from_dense,
        lambda c: F.array_contains("labels", c["truth"])
        & F.array_contains("labels", c["prediction"])
        & (c["n"] >= 0)
        & (c["n"] == F.floor(c["n"])),
    )
    usable = has_labels & F.when(has_sparse, sparse_ok).otherwise(F.col("confusion_matrix").isNotNull())
    cells = F.when(has_sparse, from_sparse).otherwise(dense_ok).cast(f"array<{cell}>")
    rows = payload.select(run, has_sparse.alias("sparse"), usable.alias("usable"), F.when(usable, cells).alias("cells"))
    # Zero cells of an otherwise valid sparse matrix still count as a matrix.
    conf = rows.select(run, F.explode("cells").alias("c")).select(run, "c.*").groupBy(run, "truth", "prediction").agg(F.sum("n").alias("n"))
    sums = label_margins(conf.withColumn("n", F.col("n").cast("long")), run).groupBy(run).agg(
        F.sum("actual").cast("double").alias("total"),
        F.sum("hits").cast("double").alias("hits"),
        F.sum(F.col("actual").cast("double") * F.col("predicted")).alias("products"),
    )
    kappa = kappa_from_sums(F.col("total"), F.col("hits"), F.col("products"))
    empty_dense = ~F.col("sparse") & (F.coalesce(F.col("total"), F.lit(0.0)) <= 0)
    return rows.join(sums, run, "left").select(
        run, F.when(F.col("usable") & ~empty_dense, kappa).alias("derived_kappa")
    )


def calibration(preds: DataFrame, run: str = "run_id", bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error over equal-width bins, and the Brier score.

    Only rows with truth and a confidence within 0..1 count.
    """
    valid = preds.filter(F.col("truth").isNotNull() & F.col("confidence").between(0, 1))
    hit = (F.col("truth") == F.col("prediction")).cast("double")
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per_bin = valid.groupBy(run, slot.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("hit_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.sum(F.pow(F.col("confidence") - hit, F.lit(2.0))).alias("brier_sum"),
    )
    gap = F.abs(F.col("hit_rate") - F.col("mean_confidence"))
    return per_bin.groupBy(run).agg(
        F.sum("n").alias("sample_count"),
        F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"),
        F.max(gap).alias("mce"),
        F.try_divide(F.sum("brier_sum"), F.sum("n")).alias("brier_score"),
    )


def calibration_bins(preds: DataFrame, run: str = "run_id", bins: int = 10) -> DataFrame:
    """The bins behind :func:`calibration`."""
    valid = preds.filter(F.col("truth").isNotNull() & F.col("confidence").between(0, 1))
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    return valid.groupBy(run, slot.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("hit_rate"),
        F.avg("confidence").alias("mean_confidence"),
    )
