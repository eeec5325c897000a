"""Agreement measures and trees against their definitions."""

import os
import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ratewise.operators import agreement, linkage, metrics


def tree_by_definition(leaves, pairs):
    known = {(min(a, b), max(a, b)): d for a, b, d in pairs}
    members = {i: [i] for i in range(leaves)}
    steps, new = [], leaves
    while len(members) > 1:
        best = None
        for x, y in combinations(sorted(members), 2):
            ds = [known[min(a, b), max(a, b)] for a in members[x] for b in members[y] if (min(a, b), max(a, b)) in known]
            if ds and (best is None or (sum(ds) / len(ds), x, y) < best):
                best = (sum(ds) / len(ds), x, y)
        if best is None:
            return None
        d, x, y = best
        members[new] = members.pop(x) + members.pop(y)
        steps.append((x, y, d, len(members[new])))
        new += 1
    return steps


def sample_pairs(seed, part=8):
    rng = random.Random(seed)
    n = rng.randint(2, 9)
    return n, [(a, b, rng.randint(0, part) / part) for a, b in combinations(range(n), 2) if rng.random() < 0.8]


def tied_pairs():
    """Groups with few and many ties, complete ones, chains of ties, missing distances, and groups that do not connect."""
    out = [sample_pairs(seed + 100, part) for part in (1, 2, 3, 8, 10) for seed in range(25)] + [sample_pairs(seed) for seed in range(12)]
    for n in (2, 3, 4, 5, 7, 8, 13):
        out.append((n, [(a, b, 0.25) for a, b in combinations(range(n), 2)]))
        out.append((n, [(a, b, (b - a) / 16) for a, b in combinations(range(n), 2)]))
        out.append((n, [(a, b, 0.0 if a % 3 == b % 3 else 0.5) for a, b in combinations(range(n), 2)]))
        out.append((n, [(a, b, 0.0 if a // 3 == b // 3 else (a + b) % 2 / 2) for a, b in combinations(range(n), 2)]))
    return out


def linked(spark, groups):
    rows = [(g, *random.Random(g).sample([a, b], 2), d) for g, (_, pairs) in enumerate(groups) for a, b, d in pairs]
    rows += [(g, 0, 0, 0.1) for g in range(len(groups))] + [(g, 0, 1, None) for g in range(len(groups))]
    p = spark.createDataFrame(rows, "group_id long, a int, b int, distance double")
    s = spark.createDataFrame([(g, n) for g, (n, _) in enumerate(groups)], "group_id long, leaves int")
    return linkage.average_linkage(p, s), s


def test_trees_equal_their_definition(spark):
    groups = tied_pairs()
    df, sizes = linked(spark, groups)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.group_id, r.step)):
        got.setdefault(r.group_id, []).append((r.left, r.right, r.distance, r.size))
    for g, (n, pairs) in enumerate(groups):
        exact = [(a, b, Fraction(round(d * linkage.UNITS))) for a, b, d in pairs]
        want = tree_by_definition(n, exact)
        assert (want is None) == (g not in got), g
        if want:
            assert [x[:2] + x[3:] for x in got[g]] == [w[:2] + w[3:] for w in want], (g, n, pairs)
            assert [x[2] for x in got[g]] == pytest.approx([float(w[2]) / linkage.UNITS for w in want])
    order = {}
    for r in linkage.leaf_order(df, sizes).collect():
        order.setdefault(r.group_id, {})[r.position] = r.leaf
    for g, (n, _) in enumerate(groups):
        want = list(range(n))
        if g in got:
            children = {n + i: s[:2] for i, s in enumerate(got[g])}
            walk = lambda c: [x for k in children[c] for x in walk(k)] if c in children else [c]
            want = walk(n + len(got[g]) - 1)
        assert [order[g][i] for i in range(n)] == want


def test_groups_that_do_not_connect_are_not_merged(spark, monkeypatch):
    """Only what can become a tree enters the rounds; long paths connect, a missing leaf does not."""
    path = [(i, i + 1, 0.5) for i in range(39)]
    groups = [(40, path), (41, path), (6, [(a, b, 0.1) for a, b in combinations(range(6), 2) if (a < 3) == (b < 3)]), (2, [(0, 1, 0.3)]), (3, [])]
    rows = [(g, a, b) for g, (_, pairs) in enumerate(groups) for a, b, _ in pairs]
    sizes = spark.createDataFrame([(g, n) for g, (n, _) in enumerate(groups)], "group_id long, leaves int")
    found = linkage.connected_groups(spark.createDataFrame(rows, "group_id long, a int, b int"), sizes)
    assert {r.group_id for r in found.collect()} == {0, 3}
    monkeypatch.setattr(linkage, "_closest", lambda state: pytest.fail("a round was begun"))
    assert linked(spark, [groups[2]])[0].collect() == []


def test_small_groups_take_no_rounds(spark, monkeypatch):
    """One task merges a group of few clusters and one walks its tree; a group that does not connect has none."""
    monkeypatch.setattr(linkage, "_closest", lambda state: pytest.fail("a round was begun"))
    monkeypatch.setattr(linkage, "connected_groups", lambda pairs, sizes: pytest.fail("pairs were contracted"))
    monkeypatch.setattr(linkage, "_places_by_doubling", lambda steps: pytest.fail("pointers were doubled"), raising=False)
    df, sizes = linked(spark, [(4, [(0, 1, 0.5), (2, 3, 0.25), (1, 2, 1.0)]), (3, [(0, 1, 0.1)])])
    got = sorted(map(tuple, df.collect()))
    assert got == [(0, 0, 2, 3, 0.25, 2), (0, 1, 0, 1, 0.5, 2), (0, 2, 4, 5, 1.0, 4)]
    assert sorted(map(tuple, linkage.leaf_order(df, sizes).collect())) == [(0, 0, 2), (0, 1, 3), (0, 2, 0), (0, 3, 1), (1, 0, 0), (1, 1, 1), (1, 2, 2)]


@pytest.mark.parametrize("clusters", [0, 4])
def test_trees_by_rounds_equal_those_of_a_task(spark, monkeypatch, clusters):
    """Rounds alone, and rounds that hand what is left to a task after each of them, make the trees of one task."""
    groups = [g for g in tied_pairs()[::8] if g[1]]

    def find():
        steps, sizes = linked(spark, groups)
        return [sorted(map(tuple, df.collect())) for df in (steps, linkage.leaf_order(steps, sizes))]

    want = find()
    monkeypatch.setattr(linkage, "TASK_CLUSTERS", clusters)
    monkeypatch.setattr(linkage, "TASK_LEAVES", 0)
    assert find() == want and want[0]


def test_sums_beyond_64_bits_take_rounds(spark):
    d = 4e6  # twice this many trillionths do not fit
    steps = linked(spark, [(3, [(0, 1, 1.0), (0, 2, d), (1, 2, d)])])[0].collect()
    assert [(r.left, r.right, r.distance, r.size) for r in sorted(steps, key=lambda r: r.step)] == [(0, 1, 1.0, 2), (2, 3, d, 3)]


def test_empty_and_single_leaf_groups(spark):
    assert linked(spark, [])[0].collect() == []
    df, sizes = linked(spark, [(1, []), (3, [])])
    assert df.collect() == []
    assert sorted(map(tuple, linkage.leaf_order(df, sizes).collect())) == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 2, 2)]


def test_a_group_of_many_leaves(spark):
    """Points in clusters: heights rise, every node is merged once, and no round count near the number of leaves."""
    n = 5_000 if os.environ.get("RATEWISE_ALL") else 600
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    ids = spark.range(n).select(F.col("id").cast("int").alias("a"), place.alias("x"))
    pairs = ids.crossJoin(ids.select(F.col("a").alias("b"), F.col("x").alias("y"))).filter("a < b").select(F.lit("g").alias("group_id"), "a", "b", F.abs(F.col("x") - F.col("y")).alias("distance"))
    sizes = spark.createDataFrame([("g", n)], "group_id string, leaves int")
    steps = sorted(linkage.average_linkage(pairs, sizes).collect(), key=lambda r: r.step)
    assert len(steps) == n - 1 and steps[-1].size == n
    assert sorted(c for r in steps for c in (r.left, r.right)) == list(range(2 * n - 2))
    assert all(x.distance <= y.distance + 1e-12 for x, y in zip(steps, steps[1:]))


def test_pair_counts_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [("g", r, i, rng.choice("ABC")) for r in range(23) for i in range(40) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "task string, run_id long, id long, prediction string")
    whole = agreement.run_pair_counts(df, ["task"]).collect()
    split = agreement.run_pair_counts(df, ["task"], block=4, rows_per_task=30).collect()
    assert sorted(whole) == sorted(split) and len(whole) == 23 * 22 // 2
    labels = agreement.run_pair_counts(df, ["task"], by_label=True, block=4, rows_per_task=30)
    k = {(r.run_a, r.run_b): r for r in agreement.pair_kappas(labels, ["task"]).collect()}
    by = {(r, i): p for _, r, i, p in rows}
    for a, b in [(0, 1), (3, 17), (9, 22)]:
        shared = [i for i in range(40) if (a, i) in by and (b, i) in by]
        x, y = [by[a, i] for i in shared], [by[b, i] for i in shared]
        observed = sum(p == q for p, q in zip(x, y)) / len(shared)
        expected = sum(x.count(c) * y.count(c) for c in "ABC") / len(shared) ** 2
        assert k[a, b].kappa == pytest.approx((observed - expected) / (1 - expected))


def test_pair_counts_of_items_with_few_and_many_ratings(spark):
    """Items that few runs rated become pairs, others go through blocks; ratings that come twice count once, the greatest label wins."""
    rng = random.Random(7)
    rows = [(g, r, i, rng.choice("ABC")) for g in ("g", "h") for r in range(30) for i in range(60) if rng.random() < (0.9 if i % 6 == 0 else 0.1)]
    rows += [("g", 3, 0, "Z"), ("g", 3, 0, "A"), ("g", 4, 1, "Z"), ("g", 4, 1, "A"), (None, 1, 1, "A"), (None, 2, 1, "A")]
    df = spark.createDataFrame(rows, "task string, run_id long, id long, prediction string")
    last = {}
    for g, r, i, p in rows:
        last[g, r, i] = max(p, last.get((g, r, i), ""))
    want, by_label = {}, {}
    for (g, r, i), p in last.items():
        for q in range(r + 1, 30):
            if g and (g, q, i) in last:
                o = last[g, q, i]
                n = want.setdefault((g, r, q), [0, 0])
                n[0], n[1] = n[0] + 1, n[1] + (p == o)
                for label, k in {(p, 0), (o, 1)} | ({(p, 2)} if p == o else set()):
                    by_label.setdefault((g, r, q, label), [0, 0, 0])[k] += 1
    for block in (4, 128):
        got = agreement.run_pair_counts(df, ["task"], block=block, rows_per_task=50).collect()
        assert sorted(tuple(r) for r in got) == sorted((*k, *v) for k, v in want.items())
        got = agreement.run_pair_counts(df, ["task"], by_label=True, block=block, rows_per_task=50).collect()
        assert sorted(tuple(r) for r in got) == sorted((*k, *v) for k, v in by_label.items())


def test_ratings_of_rare_items_are_not_copied_to_every_block(spark, tmp_path, monkeypatch):
    """2,000 runs in 500 blocks, each item rated by two: no rating goes to the blocks."""
    df = spark.range(2000).select(F.lit("g").alias("task"), F.col("id").alias("run_id"), F.floor(F.col("id") / 2).alias("id"), F.lit("A").alias("prediction"))
    copied = []

    def facts(rows, sizes, group, salt):
        if "__slices" in sizes.columns:
            copied.append(join(rows, sizes, group, salt).count())
        return join(rows, sizes, group, salt)

    join = agreement.join_group_facts
    monkeypatch.setattr(agreement, "join_group_facts", facts)
    assert agreement.run_pair_counts(df, ["task"], block=4).agg(F.count("*"), F.sum("overlap_count")).head() == (1000, 1000)
    assert copied == [0]


def test_rows_without_run_or_item_are_no_ratings(spark):
    rows = [("a", "x", "P"), ("a", None, "P"), ("b", "x", "P"), ("b", "y", "Q"), (None, "x", "P"), ("b", None, None), ("a", "z", None)]
    df = spark.createDataFrame([("g", *r) for r in rows], "task string, run_id string, id string, prediction string")
    assert [tuple(r) for r in agreement.run_pair_counts(df, ["task"]).collect()] == [("g", "a", "b", 1, 1)]
    assert [tuple(r) for r in agreement.run_pair_counts(df, ["task"], by_label=True).collect()] == [("g", "a", "b", "P", 1, 1, 1)]
    alpha = agreement.alpha_nominal(df, ["task"]).first()
    assert (alpha.run_count, alpha.rated_item_count, alpha.pairable_item_count) == (2, 2, 1)
    twice = df.unionByName(spark.createDataFrame([("g", "b", "x", "A")], df.schema))
    assert [tuple(r) for r in agreement.run_pair_counts(twice, ["task"]).collect()] == [("g", "a", "b", 1, 1)]


def test_kappa_without_variation(spark):
    rows = [("g", r, i, "A") for r in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "task string, run_id long, id long, prediction string")
    pair = agreement.pair_kappas(agreement.run_pair_counts(df, ["task"], by_label=True), ["task"]).head()
    assert (pair.agreement, pair.kappa) == (1.0, 1.0)
    # Against truth a certain expectation gives 1 or 0 instead of nothing.
    preds = spark.createDataFrame([(1, "A", "A"), (1, "A", "A"), (2, "A", "B")], "run_id int, truth string, prediction string")
    got = {r.run_id: r.cohen_kappa for r in metrics.run_scores(metrics.confusion_counts(preds)).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_alpha_is_one_on_total_agreement(spark):
    rows = [("g", r, i, "AB"[i % 2]) for r in range(3) for i in range(6)] + [("h", 0, 0, "A")]
    df = spark.createDataFrame(rows, "task string, run_id long, id long, prediction string")
    got = {r.task: r for r in agreement.alpha_nominal(df, ["task"]).collect()}
    assert got["g"].alpha_nominal == 1.0 and got["g"].fully_shared_item_count == 6
    assert got["h"].alpha_nominal is None and got["h"].pairable_item_count == 0


def test_stored_matrices(spark):
    schema = "run_stem string, labels array<string>, confusion_matrix map<string,map<string,double>>, confusion_matrix_sparse array<array<double>>"
    rows = [
        ("ok", ["a", "b"], None, [[0.0, 0.0, 2.0], [1.0, 1.0, 2.0]]),
        ("out of range", ["a", "b"], {"a": {"a": 1.0}}, [[0.0, 2.0, 1.0]]),
        ("dense", ["a", "b"], {"a": {"a": 3.0, "x": 9.0}, "b": {"b": 1.0, "a": -1.0}}, None),
        ("empty dense", ["a"], {"x": {"a": 1.0}}, []),
        ("zeros", ["a"], None, [[0.0, 0.0, 0.0]]),
        ("none", None, None, None),
    ]
    got = {r.run_stem: r.derived_kappa for r in metrics.triplets_to_confusion(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"ok": 1.0, "out of range": None, "dense": 1.0, "empty dense": None, "zeros": 0.0, "none": None}
