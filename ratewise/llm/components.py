"""Connected components of an edge table, by Spark joins; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratewise.session import cut_lineage


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) with the least node of its component, for every node of an edge.

    Each round a node goes to the least node around it and from there one step further, and edges are drawn between the new
    places only: edges within a place are dropped and equal ones become one, so edges and rounds shrink fast. Joins are of
    two exchanged sides, which Spark splits where one node has a large share of the edges; the minimum is summed up
    before it is shuffled.
    """
    live = edges.select(F.col(a).alias("one"), F.col(b).alias("two"))
    live = cut_lineage(live.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct(), "edges")
    both = lambda e: e.unionByName(e.select(F.col("two").alias("one"), F.col("one").alias("two")))
    labels, loose = None, "one <> two"
    while labels is None or not live.isEmpty():
        near = both(live).groupBy(F.col("one").alias("node")).agg(F.min("two").alias("near"))
        near = cut_lineage(near.select("node", F.least("node", "near").alias("near")), "near")
        hop = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        place = cut_lineage(near.join(hop, "near").select("node", "label"), "places")
        if labels is None:
            labels = place
        else:
            moved = place.select(F.col("node").alias("label"), F.col("label").alias("new"))
            labels = cut_lineage(labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        at = lambda side: place.select(F.col("node").alias(side), F.col("label").alias(f"{side}_at"))
        moved = live.join(at("one"), "one").join(at("two"), "two").select(F.least("one_at", "two_at").alias("one"), F.greatest("one_at", "two_at").alias("two"))
        live = cut_lineage(moved.filter(loose).distinct(), "edges")
    return labels
