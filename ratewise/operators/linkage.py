"""Average-linkage trees over pairwise distances, one tree per group, merged in parallel rounds.

The tree is the one that always merges the closest two clusters, on ties those with the smaller ids (leaves first, then merges in
their order). Averages cannot fall when clusters are merged, so two clusters that are each other's closest may be merged
at once, wherever they are: every round does this for all of them. Ids are not known before the end, but their order is: a merge
comes after another if it is higher, and at the same height if its lesser child comes after the other's. ``rank`` holds that order:
the heights from a cluster down its lesser children, then the leaf.

Clusters that are all equally far from each other, and from nothing else as close, are merged in one round whatever their
number: they pair up in the order of their ids, and the merges queue up behind them.

The state is one row per pair of living clusters with the sum and the number of its known leaf distances; a round joins it with
the few clusters that merged. As soon as a group has no more than ``TASK_CLUSTERS`` living clusters, one task makes all its further
merges in the order of the definition: its matrix has a fixed size at most, and rounds are left to groups that are larger.
The only windows order the neighbours of one cluster and the merges of one tree (as many as its leaves, never its pairs).
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ratewise.session import cut_lineage, scratch_path

STEP = "step int, left int, right int, distance double, size int"
UNITS = 10**12  # distances are summed as whole numbers of this fraction, so no order of summing can change a tie
CUT = 4  # rounds after which the list of living clusters is written
FINE = 10**9  # averages are compared in whole units and this fraction of a unit
TASK_CLUSTERS = 8_000  # living clusters of a group that one task merges: 12 bytes a pair, 384 MB
TASK_LEAVES = 200_000  # leaves of a tree that one task walks
LONG = 2**63 - 1

NODE = "struct<round:int,part:int,place:bigint>"  # a leaf is (-1, leaf, 0)
HEIGHT = "struct<whole:bigint,rest:bigint>"
RANK = f"struct<heights:array<{HEIGHT}>,leaf:int>"
# From a place among m queued clusters up to the last merge of the queue: the places passed, and whether only lesser children led there.
CLIMB = """if(m = 2, array(named_struct('place', m, 'least', place = 0, 'above', 1)), aggregate(sequence(1, 64), named_struct('at', place, 'least', true, 'out', cast(array() as array<struct<place:bigint,least:boolean,above:int>>)),
  (s, i) -> if(s.at >= 2 * m - 2, s, named_struct('at', m + cast(floor(s.at / 2) as bigint), 'least', s.least and s.at % 2 = 0,
    'out', concat(s.out, array(named_struct('place', m + cast(floor(s.at / 2) as bigint), 'least', s.least and s.at % 2 = 0, 'above', size(s.out) + 1))))),
  s -> s.out))"""


def _height() -> Column:
    whole = F.expr("total div known")
    rest = F.expr(f"cast((total - cast(total div known as decimal(19,0)) * known) * {FINE} as decimal(38,0)) div known")
    return F.struct(whole.alias("whole"), rest.alias("rest"))


def _node(round_: Column, part: Column, place: Column) -> Column:
    return F.struct(round_.cast("int").alias("round"), part.cast("int").alias("part"), place.cast("long").alias("place"))


def _closest(state: DataFrame) -> DataFrame:
    """``group_id, c, height, o``: every living cluster with all clusters at its least distance."""
    measured = state.select("group_id", "a", "b", _height().alias("height"))
    both = measured.select("group_id", F.col("a").alias("c"), F.col("b").alias("o"), "height").unionByName(
        measured.select("group_id", F.col("b").alias("c"), F.col("a").alias("o"), "height")
    )
    nearest = Window.partitionBy("group_id", "c").orderBy("height")
    return both.withColumn("r", F.rank().over(nearest)).filter("r = 1").drop("r")


def _queues(closest: DataFrame, living: DataFrame) -> DataFrame:
    """Clusters that merge now, in queues of equal distances: the living cluster's columns, its queue, its place among the ``m``
    of it, the merges above it, and what the queue becomes (``top_*``)."""
    key = ["group_id", "c"]
    ranked = closest.join(living.select("group_id", F.col("c").alias("o"), F.col("rank").alias("o_rank")), ["group_id", "o"])
    hashes = [F.xxhash64("o", F.lit(k)).cast("decimal(38,0)") for k in (1, 2)]
    near = ranked.groupBy(*key).agg(
        F.first("height").alias("height"), (F.count("*") + 1).alias("m"), F.min(F.struct("o_rank", "o"))["o"].alias("o"),
        *[F.sum(h).alias(f"sum{k}") for k, h in enumerate(hashes)],
    ).join(living, key)
    # Clusters with one and the same closed neighbourhood are all equally far from each other.
    sums = [(F.col(f"sum{k}") + F.xxhash64("c", F.lit(k + 1)).cast("decimal(38,0)")).alias(f"around{k}") for k in (0, 1)]
    near = near.select("*", *sums)
    whole, both = Window.partitionBy("group_id", "height", "m", "around0", "around1"), Window.partitionBy("group_id", F.least("c", "o"), F.greatest("c", "o"))
    found = near.withColumn("closed", F.count("*").over(whole) == F.col("m")).withColumn("first", F.min("c").over(whole))
    # Beside them, pairs that are each other's first choice by distance and rank.
    found = found.withColumn("mutual", F.count("*").over(both) == 2).filter("closed or mutual")
    queue = F.when(F.col("closed"), F.col("first")).otherwise(F.least("c", "o")).alias("queue")
    m = F.when(F.col("closed"), F.col("m")).otherwise(F.lit(2)).cast("long").alias("m")
    own = Window.partitionBy("group_id", "queue")
    placed = found.select("group_id", "c", "node", "size", "rank", "height", queue, m).withColumn("place", (F.row_number().over(own.orderBy("rank")) - 1).cast("long"))
    climbed = placed.withColumn("up", F.expr(CLIMB))
    last = F.element_at("up", -1)
    top = F.max(F.when(last["least"], _above(last))).over(own)
    return climbed.withColumn("top_rank", top).withColumn("top_size", F.sum("size").over(own).cast("int"))


def _above(up: Column) -> Column:
    """Rank of a merge that lesser children alone lead to from this row's cluster."""
    return F.struct(F.concat(F.array_repeat(F.col("height"), up["above"]), F.col("rank.heights")).alias("heights"), F.col("rank.leaf").alias("leaf"))


def _merges(queued: DataFrame) -> DataFrame:
    """All merges of the queues of all rounds: ``group_id, node, left, right, height, size, rank``."""
    member = ["group_id", "round", "queue"]
    passed = queued.select(*member, "m", "height", "size", "rank", F.explode("up").alias("up"))
    merged = passed.groupBy(*member, F.col("up.place").alias("place")).agg(
        F.first("m").alias("m"), F.first("height").alias("height"), F.sum("size").cast("int").alias("size"),
        F.max(F.when(F.col("up.least"), _above(F.col("up")))).alias("rank"),
    ).withColumn("node", _node(F.col("round"), F.col("queue"), F.col("place")))
    inner = merged.filter("place < 2 * m - 2")
    children = queued.select(*member, "m", "place", "node").unionByName(inner.select(*member, "m", "place", "node"))
    above = F.col("m") + F.floor(F.col("place") / 2).cast("long")
    sides = children.groupBy(*member, above.alias("place")).agg(
        F.max(F.when(F.col("place") % 2 == 0, F.col("node"))).alias("left"), F.max(F.when(F.col("place") % 2 == 1, F.col("node"))).alias("right")
    )
    return merged.join(sides, [*member, "place"]).select("group_id", "node", "left", "right", "height", "size", "rank")


class _Group:
    """Living clusters of one group, by rising rank, and sum and number of the known distances of each pair of them."""

    def __init__(self, living: list[dict]):
        self.living = sorted(living, key=lambda r: self.rank(r))
        names = np.array([r["c"] for r in self.living], np.int64)
        self.by_name = np.argsort(names)
        self.names = names[self.by_name]
        n = self.n = len(names)
        place = np.arange(n, dtype=np.int64)
        # Places i < j have their pair at start[i] + j; the last entry is no pair.
        self.start = place * (2 * n - place - 1) // 2 - place - 1
        self.total, self.known = np.zeros(n * (n - 1) // 2 + 1, np.int64), np.zeros(n * (n - 1) // 2 + 1, np.int32)

    @staticmethod
    def rank(row: dict) -> tuple:
        return tuple((h["whole"], h["rest"]) for h in row["rank"]["heights"]), row["rank"]["leaf"]

    def add(self, pairs: pa.RecordBatch) -> None:
        a, b = (self.by_name[np.searchsorted(self.names, pairs.column(c).to_numpy())] for c in ("a", "b"))
        at = self.start[np.minimum(a, b)] + np.maximum(a, b)
        self.total[at], self.known[at] = (pairs.column(c).to_numpy() for c in ("total", "known"))

    def _row(self, i: int) -> np.ndarray:
        return np.concatenate([self.start[:i] + i, [len(self.total) - 1], self.start[i] + np.arange(i + 1, self.n)])

    def merges(self) -> Iterator[tuple[int, int, tuple]]:
        """The places of two clusters that merge and the rank of the merge, which takes the place of the lesser one, in order.

        Every cluster keeps its least height; since averages cannot fall, that of a cluster whose nearest one merged is still a lower
        bound, and it is looked at again only when its turn comes. Ends early if the clusters do not connect.
        """
        n = self.n
        ranks = [self.rank(r) for r in self.living]
        order, by_rank = np.arange(n), list(ranks)
        whole, rest, nearest, stale = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.ones(n, bool)

        def height(total: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = total // known
            return w, (total - w * known) * FINE // known

        for _ in range(n - 1):
            while True:
                at = np.flatnonzero(whole == whole.min())
                at = at[rest[at] == rest[at].min()]
                i = int(at[np.argmin(order[at])])
                if whole[i] == LONG:
                    return
                if not stale[i]:
                    break
                row = self._row(i)
                total, known = self.total[row], self.known[row].astype(np.int64)
                far = np.divide(total, known, out=np.full(n, np.inf), where=known > 0)
                # Floats leave a few neighbours, whole numbers decide.
                close = np.flatnonzero((known > 0) & (far <= far.min() * (1 + 1e-15) + 2 / FINE))
                w, r = height(total[close], known[close])
                first = np.lexsort((order[close], r, w))[:1]
                whole[i], rest[i], nearest[i] = (w[first[0]], r[first[0]], close[first[0]]) if len(first) else (LONG, 0, -1)
                stale[i] = False
            j = int(nearest[i])
            rank = (((int(whole[i]), int(rest[i])), *ranks[i][0]), ranks[i][1])
            yield i, j, rank
            row, gone = self._row(i), self._row(j)
            total, known = self.total[row] + self.total[gone], self.known[row] + self.known[gone]
            total[[i, j]] = known[[i, j]] = 0
            self.total[gone] = self.known[gone] = 0
            self.total[row], self.known[row] = total, known
            stale |= (nearest == i) | (nearest == j)
            stale[i], whole[j], rest[j], nearest[j], stale[j] = True, LONG, 0, -1, False
            place = bisect.bisect_left(by_rank, rank)
            by_rank.insert(place, rank)
            order[order >= place] += 1
            ranks[i], order[i] = rank, place
            # As far as the nearest so far, and before it in the order.
            at = np.flatnonzero((known > 0) & ~stale)
            w, r = height(total[at], known[at].astype(np.int64))
            nearest[at[(w == whole[at]) & (r == rest[at]) & (place < order[nearest[at]])]] = i


def _merges_in_tasks(state: DataFrame, living: DataFrame, round_: int) -> DataFrame:
    """All further merges of groups that one task can hold, in the columns of ``_merges``; none of a group that does not connect."""
    # The clusters of a group come first, then its pairs, which a task reads batch by batch in columns as narrow as possible.
    clusters = living.select("group_id", F.lit(0).alias("kind"), F.to_json(F.struct("c", "node", "size", "rank")).alias("cluster"))
    pairs = state.select("group_id", F.lit(1).alias("kind"), "a", "b", F.col("total").cast("long").alias("total"), F.col("known").cast("int").alias("known"))
    rows = clusters.unionByName(pairs, allowMissingColumns=True).repartition("group_id").sortWithinPartitions("group_id", "kind")
    schema = T.StructType([rows.schema["group_id"]] + T.StructType.fromDDL(
        "part int, " + "".join(f"{side}_round int, {side}_part int, {side}_place long, " for side in ("left", "right"))
        + "whole long, rest long, size int, h_whole array<long>, h_rest array<long>, leaf int"
    ).fields)
    returned = to_arrow_schema(schema)

    def merged(group_id, group: _Group) -> Iterator[pa.RecordBatch]:
        nodes = [tuple(r["node"][c] for c in ("round", "part", "place")) for r in group.living]
        sizes, out = [r["size"] for r in group.living], []
        for part, (i, j, (heights, leaf)) in enumerate(group.merges()):
            sizes[i] += sizes[j]
            out.append((group_id, part, *nodes[i], *nodes[j], *heights[0], sizes[i], [h[0] for h in heights], [h[1] for h in heights], leaf))
            nodes[i] = (round_, part, 0)
        if len(out) == group.n - 1:
            for lo in range(0, len(out), 1000):
                columns = zip(*out[lo : lo + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, returned)], schema=returned)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, living, group = None, [], None
        for batch in batches:
            ids, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group_id", "kind"))
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                part = batch.slice(lo, hi - lo)
                if lo == hi:
                    continue
                if kinds[lo] == 0:
                    if group is not None:
                        yield from merged(key, group)
                    if group is not None or part.column("group_id")[0].as_py() != key:
                        key, living, group = part.column("group_id")[0].as_py(), [], None
                    living += map(json.loads, part.column("cluster").to_pylist())
                else:
                    group = group or _Group(living)
                    group.add(part)
        if group is not None:
            yield from merged(key, group)

    found = rows.mapInArrow(merge, schema)
    rank = F.struct(F.zip_with("h_whole", "h_rest", lambda w, r: F.struct(w.alias("whole"), r.alias("rest"))).alias("heights"), "leaf")
    sides = [_node(F.col(f"{side}_round"), F.col(f"{side}_part"), F.col(f"{side}_place")).alias(side) for side in ("left", "right")]
    return found.select("group_id", _node(F.lit(round_), F.col("part"), F.lit(0)).alias("node"), *sides, F.struct("whole", "rest").alias("height"), "size", rank.alias("rank"))


def _for_tasks(state: DataFrame, living: DataFrame) -> DataFrame:
    """``group_id`` of the groups whose further merges one task can make: few clusters, and sums that fit into 64 bits."""
    clusters = living.groupBy("group_id").agg(F.count("*").alias("clusters"))
    sums = state.groupBy("group_id").agg(F.sum("total").alias("total"), F.min("total").alias("least"), F.sum("known").alias("known"))
    fit = (F.col("clusters") <= TASK_CLUSTERS) & (F.col("least") >= 0) & (F.col("total") < 2**62) & (F.col("known") < 2**31)
    return clusters.join(sums, "group_id").filter(fit).select("group_id")


def connected_groups(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``group_id`` of the groups whose leaves all hang together by ``pairs`` (``group_id, a, b``).

    In every round each vertex becomes its least neighbour or itself, by a hash that changes with the round, and pairs shrink to
    those between different ones. A group connects if all its leaves but one have gone.
    """
    gone, round_ = [], 0
    while not pairs.isEmpty():
        both = pairs.select("group_id", F.col("a").alias("v"), F.col("b").alias("o")).unionByName(pairs.select("group_id", F.col("b").alias("v"), F.col("a").alias("o")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(round_)), F.col(c).alias("v"))
        least = F.least(F.min(order("o")), F.first(order("v")))["v"]
        into = cut_lineage(both.groupBy("group_id", "v").agg(least.alias("to")), "into")
        gone.append(into.groupBy("group_id").agg((F.count("*") - F.count_distinct("to")).alias("gone")))
        for side in ("a", "b"):
            pairs = pairs.join(into.withColumnRenamed("v", side), ["group_id", side]).withColumn(side, F.col("to")).drop("to")
        pairs = cut_lineage(pairs.filter("a <> b").select("group_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "contracted")
        round_ += 1
    if not gone:
        return sizes.select("group_id").limit(0)
    whole = reduce(DataFrame.unionByName, gone).groupBy("group_id").agg(F.sum("gone").alias("gone"))
    return whole.join(sizes, "group_id").filter(F.col("gone") == F.col("leaves") - 1).select("group_id")


def average_linkage(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Merge steps per group: ``group_id, step, left, right, distance, size``.

    ``pairs``: ``group_id, a, b, distance`` (of a pair that is given twice the larger distance counts; pairs without a distance
    do not count); ``sizes``: ``group_id, leaves``. Leaves are 0 to ``leaves`` - 1, the merge of step s is ``leaves`` + s. Groups
    that do not connect have no tree. Rounds, which only groups of more than ``TASK_CLUSTERS`` take, grow with the logarithm of the
    leaves where ties are few or complete; chains of ties (points at equal steps on a line) take more, since each waits for the one before.
    """
    spark = pairs.sparkSession
    sizes = sizes.filter("leaves >= 2").select("group_id", F.col("leaves").cast("int").alias("leaves"))
    usable = pairs.filter((F.col("a") != F.col("b")) & F.col("distance").isNotNull()).join(sizes, "group_id")
    usable = usable.filter((F.least("a", "b") >= 0) & (F.greatest("a", "b") < F.col("leaves")))
    units = F.round(F.col("distance") * UNITS).cast("decimal(38,0)")
    state = cut_lineage(
        usable.groupBy("group_id", F.least("a", "b").cast("int").alias("a"), F.greatest("a", "b").cast("int").alias("b")).agg(
            F.max(units).alias("total"), F.lit(1).cast("long").alias("known")
        ),
        "pairs",
    )
    living = cut_lineage(
        sizes.select("group_id", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("c")).select(
            "group_id", "c", _node(F.lit(-1), F.col("c"), F.lit(0)).alias("node"), F.lit(1).alias("size"),
            F.struct(F.array().cast(f"array<{HEIGHT}>").alias("heights"), F.col("c").alias("leaf")).alias("rank"),
        ),
        "living",
    )
    small = cut_lineage(_for_tasks(state, living), "small")
    in_tasks = [cut_lineage(_merges_in_tasks(state.join(small, "group_id", "left_semi"), living.join(small, "group_id", "left_semi"), 0), "merges")]
    state = state.join(small, "group_id", "left_anti")
    if not state.isEmpty():
        # Groups that do not connect have no tree: nothing of them is merged.
        connected = cut_lineage(connected_groups(state.select("group_id", "a", "b"), sizes), "connected")
        state, living = state.join(connected, "group_id", "left_semi"), living.join(connected, "group_id", "left_semi")
    root = scratch_path(spark, "queues")
    schema, round_ = None, 0
    while not state.isEmpty():
        path = f"{root}/round={round_}"
        queues = _queues(_closest(state), living)
        schema = T.StructType(queues.schema.fields + [T.StructField("round", T.IntegerType())])
        queues.write.parquet(path)
        # The round is read from the path: as a number in the plan it would have every round's code compiled anew.
        queued = spark.read.schema(schema).option("basePath", root).parquet(path)
        last = _node(F.col("round"), F.col("queue"), 2 * F.col("m") - 2).alias("node")
        new = queued.filter("place = 0").select("group_id", F.col("queue").alias("c"), last, F.col("top_size").alias("size"), F.col("top_rank").alias("rank"))
        living = living.join(queued.select("group_id", "c"), ["group_id", "c"], "left_anti").unionByName(new)
        if round_ % CUT == CUT - 1:
            living = cut_lineage(living, "living")
        into = queued.select("group_id", "c", "queue")
        moved = state
        for side in ("a", "b"):
            moved = moved.join(into.withColumnRenamed("c", side), ["group_id", side], "left").withColumn(side, F.coalesce("queue", side)).drop("queue")
        state = cut_lineage(
            moved.filter("a <> b").groupBy("group_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
                F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("known").alias("known")
            ),
            "pairs",
        )
        round_ += 1
        small = cut_lineage(_for_tasks(state, living), "small")
        if not small.isEmpty():
            mine = [df.join(small, "group_id", "left_semi") for df in (state, living)]
            in_tasks.append(cut_lineage(_merges_in_tasks(*mine, round_), "merges"))
            state, living = (cut_lineage(df.join(small, "group_id", "left_anti"), "larger") for df in (state, living))
    merges = reduce(DataFrame.unionByName, [*in_tasks, *([_merges(spark.read.schema(schema).parquet(root))] if round_ else [])]).join(sizes, "group_id")
    step = (F.row_number().over(Window.partitionBy("group_id").orderBy("rank")) - 1).cast("int")
    steps = cut_lineage(merges.withColumn("step", step), "steps")
    ids = steps.select("group_id", "node", (F.col("leaves") + F.col("step")).alias("id"))
    for side in ("left", "right"):
        child = ids.select("group_id", F.col("node").alias(side), F.col("id").alias(f"{side}_id"))
        steps = steps.join(child, ["group_id", side], "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", F.col(f"{side}.part")))
    distance = (F.col("height.whole") + F.col("height.rest") / FINE) / UNITS
    return steps.select(
        "group_id", "step", F.least("left_id", "right_id").alias("left"), F.greatest("left_id", "right_id").alias("right"), distance.alias("distance"), "size"
    )


def leaf_order(linkage: DataFrame, sizes: DataFrame) -> DataFrame:
    """Position of every leaf when the tree is read left to right; natural order for groups without a tree.

    A right child begins after its left sibling's leaves. What lies before a leaf is the sum of that over its
    ancestors. A tree of up to ``TASK_LEAVES`` is walked in one task, from its last merge down.
    """
    sizes = sizes.select("group_id", F.col("leaves").cast("int").alias("leaves"))
    steps = cut_lineage(linkage.select("group_id", "step", "left", "right", "size").join(sizes, "group_id"), "steps")
    few, many = steps.filter(F.col("leaves") <= TASK_LEAVES), steps.filter(F.col("leaves") > TASK_LEAVES)
    schema = T.StructType([steps.schema["group_id"], T.StructField("leaf", T.IntegerType()), T.StructField("before", T.IntegerType())])

    def walk(key: tuple, tree: pd.DataFrame) -> pd.DataFrame:
        leaves, before = int(tree["leaves"].iloc[0]), {}
        tree = tree.sort_values("step", ascending=False)
        size = dict(zip((leaves + tree["step"]).tolist(), tree["size"].tolist()))
        for node, left, right in zip((leaves + tree["step"]).tolist(), tree["left"].tolist(), tree["right"].tolist()):
            before[left] = before.get(node, 0)
            before[right] = before[left] + size.get(left, 1)
        return pd.DataFrame({"group_id": key[0], "leaf": [*before.keys()], "before": [*before.values()]})

    placed = few.groupBy("group_id").applyInPandas(walk, schema)
    if not many.isEmpty():
        placed = placed.unionByName(_places_by_doubling(many))
    leaves = sizes.select("group_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("leaves"), F.lit(1)) - 1)).alias("leaf"), "leaves").filter("leaf < leaves")
    return leaves.join(placed, ["group_id", "leaf"], "left").select("group_id", "leaf", F.coalesce("before", "leaf").cast("int").alias("position"))


def _places_by_doubling(steps: DataFrame) -> DataFrame:
    """``group_id, leaf, before`` of large trees by pointer doubling: in every round each node adds what its pointer has gathered and
    points twice as far."""
    node = F.col("leaves") + F.col("step")
    counts = steps.select("group_id", node.alias("left"), F.col("size").alias("left_size"))
    known = cut_lineage(
        steps.join(counts, ["group_id", "left"], "left").select("group_id", node.alias("up"), "left", "right", F.coalesce("left_size", F.lit(1)).alias("left_size")), "children"
    )
    root = steps.groupBy("group_id").agg(F.max(node).alias("node"))
    nodes = known.select("group_id", F.col("left").alias("node"), "up", F.lit(0).alias("before")).unionByName(
        known.select("group_id", F.col("right").alias("node"), "up", F.col("left_size").alias("before"))
    ).unionByName(root.select("group_id", "node", F.lit(None).cast("int").alias("up"), F.lit(0).alias("before")))
    nodes = cut_lineage(nodes, "nodes")
    while not nodes.filter("up is not null").isEmpty():
        far = nodes.select("group_id", F.col("node").alias("up"), F.col("up").alias("far"), F.col("before").alias("more"))
        nodes = cut_lineage(
            nodes.join(far, ["group_id", "up"], "left").select("group_id", "node", F.col("far").alias("up"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before")), "nodes"
        )
    return nodes.select("group_id", F.col("node").alias("leaf"), "before")
