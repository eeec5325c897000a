"""Agreement between runs: alpha, pair counts, kappa, comparable task variants, representatives, visibility."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ratewise.functions.numbers import t_critical
from ratewise.operators.skew import join_group_facts
from ratewise.session import cut_lineage

IGNORED_TAG = "open source"  # fixed value: does not separate task variants
POLICIES = ["latest", "best_accuracy"]


def alpha_nominal(labels: DataFrame, group: list[str], run: str = "run_id", item: str = "id", label: str = "prediction") -> DataFrame:
    """Krippendorff's alpha for nominal labels per group, without forming rater pairs.

    With m ratings on an item, a label given n times adds n(m-n)/(m-1) to the observed disagreement.
    Items with one rating are rated but not pairable. Rows without run, item or label are no ratings. Input: one label
    per run and item.
    """
    rated = labels.filter(F.col(label).isNotNull() & F.col(run).isNotNull() & F.col(item).isNotNull())
    counts = rated.groupBy(*group, item, label).agg(F.count("*").alias("n"))
    squares = F.sum(F.col("n").cast("double") * F.col("n"))
    items = counts.groupBy(*group, item).agg(F.sum("n").alias("m"), squares.alias("ss"), F.min(label).alias("only"))
    pairable = F.col("m") >= 2
    m = F.col("m").cast("double")
    runs = rated.groupBy(*group, run).agg(F.lit(1).alias("one")).groupBy(*group).agg(F.count("*").alias("run_count"))
    # How many raters the items have: a few numbers per group, so that "all runs" can be looked up without a join per item.
    by_size = items.groupBy(*group, "m").agg(
        F.count("*").alias("items"), F.sum(F.when(pairable, F.try_divide(m * m - F.col("ss"), m - 1)).otherwise(0.0)).alias("d")
    )
    per_group = by_size.join(runs, group).groupBy(*group).agg(
        F.max("run_count").alias("run_count"),
        F.sum("d").alias("d"),
        F.sum(F.when(pairable, F.col("items")).otherwise(0)).alias("pairable_item_count"),
        F.sum("items").alias("rated_item_count"),
        F.sum(F.when(F.col("m") == F.col("run_count"), F.col("items")).otherwise(0)).alias("fully_shared_item_count"),
    )
    # Label totals over pairable items: all ratings less those of items with a single one.
    alone = items.filter("m = 1").groupBy(*group, F.col("only").alias(label)).agg(F.count("*").alias("alone"))
    totals = counts.groupBy(*group, label).agg(F.sum("n").alias("all_n")).join(alone, [*group, label], "left")
    n_c = (F.col("all_n") - F.coalesce("alone", F.lit(0).cast("long"))).cast("double")
    margins = totals.groupBy(*group).agg(F.sum(n_c).alias("n"), F.sum(n_c * n_c).alias("sq"), F.count("*").alias("category_count"))
    n = F.col("n")
    observed = F.try_divide("d", n)
    expected = F.try_divide(n * n - F.col("sq"), n * (n - 1))
    alpha = F.when(n < 2, None).when(expected == 0, F.when(observed == 0, 1.0)).otherwise(1 - F.try_divide(observed, expected))
    return per_group.join(margins, group).select(
        *group, "run_count", alpha.alias("alpha_nominal"), "pairable_item_count", "rated_item_count", "fully_shared_item_count", "category_count"
    )


def run_pair_counts(
    labels: DataFrame,
    group: list[str],
    run: str = "run_id",
    item: str = "id",
    label: str = "prediction",
    by_label: bool = False,
    block: int = 128,
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Shared and equally labelled items for every pair of runs of a group that share an item (run_a < run_b).

    The runs of a group are hashed into blocks. An item that few of them rated (no more pairs a rating than blocks) is
    written as its pairs. Ratings of the other items go to every block, their items into slices; a task sees two blocks of runs
    on one slice. So no group, run or item has to fit into one task, and a rating makes as many rows as there are blocks at most.
    With ``by_label`` there is one row per pair and label: how often each side used it, and both. Rows without run, item or
    label are no ratings; of several labels a run gave one item the greatest counts.
    """
    whole = F.col(label).isNotNull() & F.col(run).isNotNull() & F.col(item).isNotNull()
    rated = cut_lineage(labels.filter(whole).select(*group, run, item, label), "rated")
    blocks = (
        rated.groupBy(*group, run).agg(F.count("*").alias("__n"))
        .groupBy(*group).agg(F.count("*").alias("__runs"), F.max("__n").alias("__top"))
        .filter(F.col("__runs") >= 2)
        .withColumn("__blocks", F.ceil(F.col("__runs") / block))
        .drop("__runs")
    )
    per_item = join_group_facts(rated.groupBy(*group, item).agg(F.count("*").alias("__m")), blocks, group, F.col(item))
    dense = cut_lineage(per_item.filter(F.col("__m") - 1 > 2 * F.col("__blocks")), "dense")
    sizes = (
        dense.groupBy(*group).agg(F.sum("__m").alias("__rows"), F.first("__top").alias("__top"), F.first("__blocks").alias("__blocks"))
        .withColumn("__top", F.least("__top", "__rows"))
        .withColumn(
            "__slices",
            F.ceil(F.greatest(F.col("__rows") * 2 / F.col("__blocks"), F.col("__top") * 2) / rows_per_task),
        )
        .select(*group, "__blocks", "__slices")
    )
    few = rated.join(dense.select(*group, item), [*group, item], "left_anti")
    many = rated.join(dense.select(*group, item), [*group, item], "left_semi")
    placed = (
        join_group_facts(many, sizes, group, F.col(item))
        .withColumn("__block", F.pmod(F.xxhash64(F.col(run)), F.col("__blocks")))
        .withColumn("__slice", F.pmod(F.xxhash64(F.col(item)), F.col("__slices")))
        .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
        .withColumn("__low", F.least("__block", "__other"))
        .withColumn("__high", F.greatest("__block", "__other"))
        .select(*group, run, item, label, "__block", "__low", "__high", "__slice")
    )
    keys = [*group, "__low", "__high", "__slice"]
    fields = [T.StructField(g, placed.schema[g].dataType) for g in group]
    fields += [T.StructField("run_a", placed.schema[run].dataType), T.StructField("run_b", placed.schema[run].dataType)]
    if by_label:
        fields += [T.StructField("label", placed.schema[label].dataType)]
        fields += [T.StructField(c, T.LongType()) for c in ("left_n", "right_n", "both_n")]
    else:
        fields += [T.StructField(c, T.LongType()) for c in ("overlap_count", "agreement_count")]
    schema = T.StructType(fields)

    def count_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key[len(group)], key[len(group) + 1]
        run_code, runs = pd.factorize(pdf[run], sort=True)
        item_code, items = pd.factorize(pdf[item])
        label_code, names = pd.factorize(pdf[label], sort=True)
        grid = np.full((len(items), len(runs)), -1, dtype=np.int32)
        np.maximum.at(grid, (item_code, run_code), label_code)
        block_of = np.empty(len(runs), dtype=np.int64)
        block_of[run_code] = pdf["__block"].to_numpy()
        left, right = np.flatnonzero(block_of == low), np.flatnonzero(block_of == high)
        # Every pair once: within one block the run that sorts first is the left one.
        wanted = np.ones((len(left), len(right)), bool) if low != high else left[:, None] < right[None, :]

        def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            # Sums of 0 and 1 in float32 are exact for the items of a slice.
            return (x[:, left].astype(np.float32).T @ y[:, right].astype(np.float32)).astype(np.int64) * wanted

        per_label = []
        by_name = np.argsort(label_code, kind="stable")
        for code, at in zip(range(len(names)), np.split(by_name, np.cumsum(np.bincount(label_code, minlength=len(names)))[:-1])):
            part = grid[np.unique(item_code[at])]
            used, any_label = part == code, part >= 0
            per_label.append((shared(used, any_label), shared(any_label, used), shared(used, used)))
        run_names, parts = np.asarray(runs), []
        for name, counts in zip(names, per_label) if by_label else [(None, (shared(grid >= 0, grid >= 0), sum(p[2] for p in per_label)))]:
            i, j = np.nonzero(sum(counts[:2]))
            first, second = left[i], right[j]
            turned = first > second
            values = [c[i, j] for c in counts]
            if by_label:
                values = [np.where(turned, values[1], values[0]), np.where(turned, values[0], values[1]), values[2]]
            named = [np.full(len(i), name, object)] if by_label else []
            parts.append([run_names[np.where(turned, second, first)], run_names[np.where(turned, first, second)], *named, *values])
        frame = pd.DataFrame({f.name: np.concatenate(columns) for f, columns in zip(schema.fields[len(group):], zip(*parts))})
        for name, value in zip(reversed(group), reversed(key[: len(group)])):
            frame.insert(0, name, value)
        return frame

    blocked = placed.groupBy(*keys).applyInPandas(count_block, schema)
    # One row per pair and item; a run's repeated ratings of an item count once. Ratings are moved by item once, for the join too.
    once = few.repartition(*group, item).groupBy(*group, item, run).agg(F.max(label).alias(label))
    left = once.select(*group, item, F.col(run).alias("run_a"), F.col(label).alias("__left"))
    right = once.select(*group, item, F.col(run).alias("run_b"), F.col(label).alias("__right"))
    pairs = left.join(right, [*group, item]).filter(F.col("run_a") < F.col("run_b"))
    if by_label:
        # All that follows groups by the pair first, so its rows are moved once.
        by_labels = pairs.select(*group, "run_a", "run_b", "__left", "__right").repartition(*group, "run_a", "run_b").groupBy(
            *group, "run_a", "run_b", "__left", "__right"
        ).agg(F.count("*").alias("__n"))
        same, n, none = F.col("__left") == F.col("__right"), F.col("__n"), F.lit(0).cast("long")
        sides = F.when(same, F.array(F.struct(F.col("__left").alias("label"), n.alias("left_n"), n.alias("right_n"), n.alias("both_n")))).otherwise(
            F.array(
                F.struct(F.col("__left").alias("label"), n.alias("left_n"), none.alias("right_n"), none.alias("both_n")),
                F.struct(F.col("__right").alias("label"), none.alias("left_n"), n.alias("right_n"), none.alias("both_n")),
            )
        )
        direct = by_labels.select(*group, "run_a", "run_b", F.explode(sides).alias("s")).select(*group, "run_a", "run_b", "s.*")
        counts, at = ["left_n", "right_n", "both_n"], ["run_a", "run_b", "label"]
    else:
        direct = pairs.groupBy(*group, "run_a", "run_b").agg(
            F.count("*").alias("overlap_count"), F.count_if(F.col("__left") == F.col("__right")).alias("agreement_count")
        )
        counts, at = ["overlap_count", "agreement_count"], ["run_a", "run_b"]

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*group, *at).agg(*[F.sum(c).alias(c) for c in counts])

    return summed(summed(direct).unionByName(blocked))


def pair_distances(pairs: DataFrame) -> DataFrame:
    """Disagreement share over the shared items of each pair."""
    apart = F.col("overlap_count") - F.col("agreement_count")
    return pairs.withColumn("disagreement_count", apart).withColumn("distance", F.try_divide(apart, F.col("overlap_count")))


def pair_kappas(pairs_by_label: DataFrame, group: list[str]) -> DataFrame:
    """Agreement and kappa of each run pair. Where the expectation is 1, kappa is 1 or unknown."""
    n = F.sum("left_n").cast("double")
    observed = F.try_divide(F.sum("both_n"), n)
    expected = F.try_divide(F.sum(F.col("left_n").cast("double") * F.col("right_n")), n * n)

    def near_one(x: Column) -> Column:
        return F.abs(1 - x) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x))

    kappa = F.when(near_one(expected), F.when(near_one(observed), 1.0)).otherwise(F.try_divide(observed - expected, 1 - expected))
    return pairs_by_label.groupBy(*group, "run_a", "run_b").agg(
        F.sum("left_n").alias("overlap"), observed.alias("agreement"), kappa.alias("kappa")
    )


def number(which: Column, copies: str | None = None) -> Column:
    """Aggregate: rows of a kind; ``copies`` names a column that says how many a row stands for."""
    return F.coalesce(F.sum(F.when(which, F.col(copies))), F.lit(0).cast("long")) if copies else F.count_if(which)


def mean_and_deviation(value: str, copies: str | None = None) -> tuple[Column, Column, Column]:
    """Aggregates: number, mean and sample deviation (0 for one value) of the values that are known."""
    v = F.col(value)
    if copies is None:
        n = F.count(v)
        return n, F.avg(v), F.when(n == 1, 0.0).otherwise(F.stddev_samp(v))
    n = number(v.isNotNull(), copies)
    total = F.sum(v * F.col(copies))
    spread = F.sum(v * v * F.col(copies)) - F.try_divide(total * total, n)
    # Rounding may leave a spread a little below 0; greatest() would also turn an unknown one into 0.
    sd = F.when(F.min(v) == F.max(v), 0.0).otherwise(F.sqrt(F.greatest(F.try_divide(spread, n - 1), F.lit(0.0))))
    return n, F.try_divide(total, n), F.when(n > 0, sd)


def mean_with_t_interval(value: str, prefix: str, copies: str | None = None) -> list[Column]:
    """Aggregates: mean, sample deviation (0 for one value), t interval kept within 0..1."""
    n, mean, sd = mean_and_deviation(value, copies)
    half = t_critical(n) * sd / F.sqrt(n)
    return [
        mean.alias(f"{prefix}_mean"),
        sd.alias(f"{prefix}_sd"),
        half.alias(f"{prefix}_ci95"),
        F.when(half.isNotNull(), F.greatest(F.lit(0.0), mean - half)).alias(f"{prefix}_ci95_low"),
        F.when(half.isNotNull(), F.least(F.lit(1.0), mean + half)).alias(f"{prefix}_ci95_high"),
    ]


def pair_summary(pair_scores: DataFrame, group: list[str]) -> DataFrame:
    """Mean agreement and kappa over the run pairs of a group; pairs with unknown kappa are left out of its mean."""
    return pair_scores.groupBy(*group).agg(
        F.count("*").alias("pair_count"),
        F.avg("overlap").alias("overlap_mean"),
        *mean_with_t_interval("agreement", "agreement"),
        *mean_with_t_interval("kappa", "kappa"),
    )


def task_variants(rows: DataFrame, tags: DataFrame, run: str = "run_id", item: str = "id", truth: str = "truth") -> DataFrame:
    """Key that is equal for runs over the same items, truths and tags, whatever the row order.

    Row hashes are combined by sum and xor, so a run is never gathered in one place.
    """
    # An absent truth must not look like an empty one.
    h = F.xxhash64(F.col(item), F.col(truth), F.col(truth).isNull())
    h2 = F.xxhash64(F.lit("second"), F.col(truth), F.col(item), F.col(truth).isNull())
    content = rows.groupBy(run).agg(
        F.count("*").alias("__n"),
        F.sum(h.cast("decimal(38,0)")).alias("__sum"),
        F.bit_xor(h2).alias("__xor"),
    )
    kept = F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: (t != "") & (t != IGNORED_TAG))))
    key = F.sha2(F.concat_ws("|", F.col("__n").cast("string"), F.col("__sum").cast("string"), F.col("__xor").cast("string"), F.to_json("__tags")), 256)
    return content.join(tags.select(run, kept.alias("__tags")), run).select(run, key.alias("variant"))


def representatives(runs: DataFrame, group: list[str], policy: str, run: str = "run_stem") -> DataFrame:
    """One run per group: the newest, or the most accurate (newest among equals)."""
    when = F.coalesce(F.col("started").cast("double"), F.lit(float("-inf")))
    score = F.coalesce(F.col("accuracy"), F.lit(float("-inf")))
    order = {"latest": [when], "best_accuracy": [score, when]}[policy]
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(run, *[c for c in runs.columns if c != run and c not in group]).alias("row")))
    return runs.groupBy(*group).agg(best.alias("best")).select(*group, "best.row.*")


def agreement_summary(preds: DataFrame, runs: DataFrame, variant: str = "task") -> DataFrame:
    """Alpha of repeated runs of one model, and across models with one representative run per model and policy.

    ``runs`` has ``run_id, run_stem, provider, model, started, accuracy`` and the variant column.
    """
    repeat = runs.select("run_id", "run_stem", variant, "provider", "model", F.lit("repeat").alias("scope"))
    chosen = repeat
    for policy in POLICIES:
        reps = representatives(runs, [variant, "provider", "model"], policy, run="run_stem")
        chosen = chosen.unionByName(
            reps.select("run_id", "run_stem", variant, F.lit("").alias("provider"), F.lit("").alias("model"), F.lit(policy).alias("scope"))
        )
    group = ["scope", variant, "provider", "model"]
    # Groups of one run have nothing to compare; two different stems are enough to see that a group has several.
    several = chosen.groupBy(*group).agg(F.min("run_stem").alias("low"), F.max("run_stem").alias("high")).filter("low <> high").select(*group)
    compared = chosen.join(several, group, "left_semi")
    stems = compared.groupBy(*group).agg(F.array_sort(F.collect_set("run_stem")).alias("run_stems"))
    return stems.join(alpha_nominal(preds.join(compared.drop("run_stem"), "run_id"), group), group)


def with_agreement(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Left join of runs to the alpha of their repeat group; the later group wins where a run is in several."""
    lookup = (
        groups.select(F.explode("run_stems").alias("run_stem"), "position", "group_id", "alpha_nominal")
        .groupBy("run_stem")
        .agg(F.max(F.struct("position", "group_id", "alpha_nominal")).alias("g"))
        .select("run_stem", F.col("g.group_id").alias("group_id"), F.col("g.alpha_nominal").alias("repeat_alpha"))
    )
    return runs.join(lookup, "run_stem", "left")


def fully_visible(groups: DataFrame, visible: DataFrame) -> DataFrame:
    """Groups of at least two runs that are all visible."""
    seen = visible.select("run_stem").distinct().withColumn("__seen", F.lit(True))
    whole = (
        groups.select("group_id", F.explode("run_stems").alias("run_stem"))
        .join(seen, "run_stem", "left")
        .groupBy("group_id")
        .agg(F.count("*").alias("members"), F.bool_and(F.coalesce(F.col("__seen"), F.lit(False))).alias("whole"))
        .filter(F.col("whole") & (F.col("members") >= 2))
    )
    return groups.join(whole.select("group_id"), "group_id", "left_semi")


def visible_members(members: DataFrame, visible: DataFrame) -> DataFrame:
    """Visible members of each cluster with a new index without gaps; clusters keep only if two are left.

    ``members`` has ``group_id, position, run_stem``.
    """
    sizes = members.groupBy("group_id").agg(F.count("*").alias("total_members"))
    kept = members.join(visible.select("run_stem").distinct(), "run_stem", "left_semi")
    by_pos = Window.partitionBy("group_id").orderBy("position")
    indexed = kept.withColumn("new_position", F.row_number().over(by_pos) - 1)
    big = kept.groupBy("group_id").agg(F.count("*").alias("visible_members")).filter("visible_members >= 2")
    return (
        indexed.join(big, "group_id").join(sizes, "group_id")
        .withColumn("full_visible", F.col("visible_members") == F.col("total_members"))
        .drop("total_members")
    )


def visible_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs between visible members, on their new indices; pairs without a finite distance are dropped."""
    left = members.select("group_id", F.col("position").alias("a"), F.col("new_position").alias("new_a"))
    right = members.select("group_id", F.col("position").alias("b"), F.col("new_position").alias("new_b"))
    finite = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") != F.lit(float("inf")))
    return (
        pairs.filter(finite).join(left, ["group_id", "a"]).join(right, ["group_id", "b"])
        .select("group_id", F.col("new_a").alias("a"), F.col("new_b").alias("b"), "distance")
    )


def member_positions(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Index of every run that occurs in a pair, in run order within its group."""
    runs = pairs.select(*group, F.explode(F.array("run_a", "run_b")).alias("run_id")).distinct()
    return runs.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("run_id")) - 1)


def with_groups(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """Clusters with the facts of their agreement group, where there is one."""
    facts = [c for c in groups.columns if c not in clusters.columns]
    return clusters.join(groups.select("group_id", *facts), "group_id", "left")
