"""Near-duplicate join on word shingles: MinHash bands find candidates, full shingle sets decide.

1. Every text becomes its set of shingles, a MinHash signature, and a digest of the set. Texts with equal sets form a copy
   class at once; one row per class goes on, so thousands of copies cost one signature.
2. Band hashes are shuffled; each band's members are linked to its least member (never all pairs), and the components of
   these links are the candidate groups. Every pair that shares a band lies in one group.
3. Each group compares its full sets: a small group in one task, a large one in blocks and pairs of blocks of bounded size. A
   task counts shared shingles as matrix products. Blocks are compared within themselves first, which gives every member a label
   (one edge a member); pairs of blocks then add counts, and edges between the few labels only.
4. Components of these edges give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.llm import words as W
from ratewise.llm.components import connected
from ratewise.session import cut_lineage

BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 19
COLUMNS = 2048
NO_ID = -(1 << 63)
MEMBER = ["h", "copies", "part", "parts", "group"]


def banding(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest candidates, that find pairs at the threshold with the asked recall."""
    best = None
    for rows in range(1, most_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-chance))
        if bands * rows > most_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def shingle_sets(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts of a slice, sorted within each text, and their text offsets.

    A text of fewer words than a shingle, but not none, has one shingle of all its words.
    """
    n = np.diff(found.offsets)
    starts = W.inside_texts(found.offsets, size)
    owner = np.searchsorted(found.offsets, starts, "right") - 1
    shingles = W.windows(found.hashes, size)[starts]
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.array([W.windows(found.hashes[found.offsets[i] : found.offsets[i + 1]], int(n[i]))[0] for i in short], W.U)
    owner, shingles = np.concatenate([owner, short]), np.concatenate([shingles, W.mix(whole + W.U(1))])
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    owner, shingles = owner[new], shingles[new]
    return shingles, np.searchsorted(owner, np.arange(len(n) + 1))


def _signatures(size: int, bands: int, rows: int):
    seeds = W.mix(np.arange(1, 2 * bands * rows + 1, dtype=W.U))
    flips, factors = seeds[::2], seeds[1::2] | W.U(1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = W.Splitter(W.alphanumeric())
        for batch in batches:
            docs, names = batch.column("doc"), batch.column("t")
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                sets, ends = shingle_sets(split(data, offsets), size)
                some = np.flatnonzero(np.diff(ends))
                at = ends[some]
                hashes = np.empty((len(some), bands), W.U)
                sums = np.zeros((2, hi - lo), W.U)
                if len(some):
                    for band in range(bands):
                        key = np.full(len(some), W.U(band))
                        for j in range(band * rows, (band + 1) * rows):
                            key = W.joined(key, np.minimum.reduceat((sets ^ flips[j]) * factors[j], at))
                        hashes[:, band] = key
                    mixed = W.mix(sets)
                    sums[0, some] = np.add.reduceat(mixed, at)
                    sums[1, some] = np.add.reduceat(W.mix(mixed ^ W.U(0xA5A5A5A5)), at)
                lengths = np.zeros(hi - lo + 1, np.int32)
                lengths[some + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(W.signed(hashes.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(lo, hi - lo), names.slice(lo, hi - lo), pa.array(W.signed(sums[0])), pa.array(W.signed(sums[1])), pa.array(np.diff(ends)), lists], names=["doc", "t", "h", "h2", "n", "bands"],
                )

    return emit


def _sets(size: int):
    """The sorted shingle set of each candidate, as bytes; of rows in a row that are equal in id and text, once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, last = W.Splitter(W.alphanumeric()), None
        for batch in batches:
            asked = batch.column("h").to_numpy(zero_copy_only=False)
            new = np.ones(len(asked), bool)
            new[1:] = asked[1:] != asked[:-1]
            if len(asked):
                new[0] = asked[0] != last
                last = asked[-1]
            batch = batch.filter(pa.array(new))
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                sets, ends = shingle_sets(split(data, offsets), size)
                body = [sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in MEMBER], pa.array(body, pa.binary())], names=[*MEMBER, "shingles"],
                )

    return emit


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right set."""
    both = left + right
    flat = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n > 1
    column, row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(often.sum())
    for first in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((len(both), min(COLUMNS, width - first)), np.float32)
        dense[row[a:b], column[a:b] - first] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _least(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name in each member's component of a symmetric link matrix."""
    label = names.copy()
    while True:
        near = np.array([label[row].min() for row in links])
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _compared(threshold: float, within: bool):
    """Members of one block (``within``) or of two: each member's links, and what they connect.

    Within a block a row names the least member it is connected to. Between blocks the rows of members have counts alone; what
    connects is said once per label of a block, in a row of its own, so no member has a row per block that it touches for that.
    """

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Sums over float32 products: exact up to 2^24 shared shingles.
        sets = [np.frombuffer(x, W.U) for x in pdf["shingles"]]
        part, h, copies = pdf["part"].to_numpy(), pdf["h"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        ones, twos = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
        sizes = np.array([len(x) for x in sets], np.float64)
        links = np.zeros((len(sets), len(sets)), bool)
        if len(ones) and len(twos):
            shared = shared_counts([sets[i] for i in ones], [sets[i] for i in twos]).astype(np.float64)
            union = sizes[ones][:, None] + sizes[twos][None, :] - shared
            links[np.ix_(ones, twos)] = shared + 1e-9 >= threshold * union
            links |= links.T
        np.fill_diagonal(links, False)
        out = pd.DataFrame({"h": h, "links": links @ copies})
        np.fill_diagonal(links, True)
        if within:
            return out.assign(least=_least(links, h))
        labels, which = np.unique(pdf["label"].to_numpy(np.int64), return_inverse=True)
        between = np.eye(len(labels), dtype=bool)
        i, j = np.nonzero(links)
        between[which[i], which[j]] = True
        least = _least(between, labels)
        joined = least != labels
        counted = out[out["links"] > 0].assign(least=None)
        return pd.concat([counted, pd.DataFrame({"h": labels[joined], "links": 0, "least": least[joined]})]).astype({"least": "Int64"})

    return compare


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``class_id``, ``copy_of`` and ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is ``threshold`` or more.
    ``class_id`` is the least id that links lead to, ``copy_of`` the least id with an equal set, ``n_links`` the number of
    linked rows, copies included. Words are runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased. A
    text without words (null, empty) is linked to nothing; a null id counts as smaller than all others; rows that share an id
    or have none take part by their own texts. A pair at the threshold is found with probability ``recall`` or more, closer pairs
    nearly always. Other columns are not read.
    """
    bands, rows = banding(threshold, recall)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    signed = cut_lineage(texts.mapInArrow(_signatures(size, bands, rows), "doc long, t long, h long, h2 long, n long, bands array<long>"), "signatures")
    worded = signed.filter("n > 0")
    whose = F.min(F.struct("doc", "t"))
    classes = worded.groupBy("h", "h2", "n").agg(whose.alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.select("h", "h2", "n", F.col("least.doc").alias("rep"), F.col("least.t").alias("t"), "copies", "bands"), "copies")

    # Candidate groups.
    banded = classes.select("h", F.explode("bands").alias("band"))
    heads = cut_lineage(banded.groupBy("band").agg(F.min("h").alias("head"), F.count("*").alias("m")).filter("m > 1").select("band", "head"), "bands")
    groups = connected(banded.join(heads, "band").filter("h <> head").select("h", "head").distinct(), "h", "head")
    members = cut_lineage(classes.drop("bands").join(groups.select(F.col("node").alias("h"), F.col("label").alias("group")), "h"), "members")
    per_group = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    sized = cut_lineage(per_group.select("group", parts.alias("parts")), "groups")
    placed = members.join(sized, "group").select("h", F.col("rep").alias("doc"), "t", "copies", "group", "parts", F.pmod(F.xxhash64("h"), "parts").cast("int").alias("part"))

    # True links, block by block and then block pair by block pair. A class's text is found by its id and its hash, so rows
    # that share an id, or have none, do not meet each other's classes.
    row = "h long, copies long, part int, parts int, group long, shingles binary"
    found = texts.join(placed, ["doc", "t"]).select("text", *MEMBER)
    sets = cut_lineage(found.mapInArrow(_sets(size), row).dropDuplicates(["h"]), "sets")
    member = [c for c in MEMBER if c != "parts"]
    own = sets.select(*member, "shingles", F.col("part").alias("one"), F.col("part").alias("two"))
    inside = cut_lineage(own.groupBy("group", "one", "two").applyInPandas(_compared(threshold, True), "h long, links long, least long"), "inside")
    labelled = sets.filter("parts > 1").join(inside.select("h", F.col("least").alias("label")), "h")
    paired = labelled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
    paired = paired.select(*member, "shingles", "label", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    across = cut_lineage(paired.groupBy("group", "one", "two").applyInPandas(_compared(threshold, False), "h long, links long, least long"), "across")
    joined = inside.filter("h <> least").select("h", "least").unionByName(across.filter("least is not null").select("h", "least"))
    labels = connected(joined, "h", "least").withColumnRenamed("node", "h").withColumnRenamed("label", "top")
    counts = inside.select("h", "links").unionByName(across.select("h", "links")).groupBy("h").agg(F.sum("links").alias("links"))

    # One row per document. Classes are named by the least id that any of their members' copies has.
    known = classes.select("h", "h2", "n", "rep", "copies").join(counts, "h", "left").join(labels, "h", "left").withColumn("top", F.coalesce("top", "h"))
    known = cut_lineage(known.select("h", "h2", "n", "rep", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    known = known.join(known.groupBy("top").agg(F.min("rep").alias("class")), "top").select("h", "h2", "n", "rep", "class", "links")
    out = worded.select("doc", "h", "h2", "n").join(known, ["h", "h2", "n"]).select("doc", "class", "rep", "links")
    alone = signed.filter("n = 0").select("doc", F.col("doc").alias("class"), F.col("doc").alias("rep"), F.lit(0).cast("long").alias("links"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.unionByName(alone).select(null("doc").alias(id_col), null("class").alias("class_id"), null("rep").alias("copy_of"), F.col("links").alias("n_links"))
