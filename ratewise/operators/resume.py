"""Label overrides and resumed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratewise.functions.text import strip

UNCLASSIFIED = "unclassified"


def override_truth(rows: DataFrame, labels: DataFrame, item: str = "id") -> DataFrame:
    """Truth from the label table where it has one, else the row's own."""
    own = labels.select(F.col(item), F.nullif(strip(F.col("truth")), F.lit("")).alias("__label"))
    # A label table may name an item more than once.
    own = own.groupBy(item).agg(F.max("__label").alias("__label"))
    return rows.join(own, item, "left").withColumn("truth", F.coalesce("__label", "truth")).drop("__label")


def not_yet_predicted(inputs: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a prediction row."""
    return inputs.join(predictions.select(*keys).distinct(), keys, "left_anti")


def unclassified_inputs(inputs: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose prediction is still open."""
    open_ = predictions.filter(F.lower(strip(F.col("prediction"))) == UNCLASSIFIED).select(*keys).distinct()
    return inputs.join(open_, keys, "left_semi")


def keep_classified(predictions: DataFrame) -> DataFrame:
    """Rows to keep when open ones are asked again."""
    return predictions.filter(~F.coalesce(F.lower(strip(F.col("prediction"))) == UNCLASSIFIED, F.lit(False)))


def should_stop(before: DataFrame, after: DataFrame, run: str, item: str) -> DataFrame:
    """Per run: nothing left open, the same items open twice, or every open item is truly ``unclassified``.

    The sets are compared by a join on the item, never gathered.
    """
    def open_items(df: DataFrame, flag: str) -> DataFrame:
        return df.filter(F.lower(strip(F.col("prediction"))) == UNCLASSIFIED).select(run, item, F.lit(True).alias(flag), *(["truth"] if flag == "now" else []))

    both = open_items(before, "was").join(open_items(after, "now"), [run, item], "full")
    runs = after.select(run).distinct()
    state = both.groupBy(run).agg(
        F.count("now").alias("open_now"),
        F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("changed"),
        F.count_if(F.col("now") & ~F.coalesce(F.lower("truth") == UNCLASSIFIED, F.lit(False))).alias("wanted"),
    )
    zero = F.lit(0).cast("long")
    return runs.join(state, run, "left").select(
        run, F.coalesce("open_now", zero).alias("open_now"),
        ((F.coalesce("open_now", zero) == 0) | (F.coalesce("changed", zero) == 0) | (F.coalesce("wanted", zero) == 0)).alias("stop"),
    )


def few_shot(examples: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` labelled examples."""
    return examples.filter(strip(F.coalesce("truth", F.lit(""))) != "").orderBy(*order).limit(n)
