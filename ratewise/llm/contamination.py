"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the corpus into shards of consecutive texts and stores for each shard the sorted terms, the word
positions of each term, and where every document begins. ``phrase_matches`` intersects, shard by shard, the postings of
a phrase's terms, moved by their offsets, from the rarest term of the corpus to the most common one;
``proximity_matches`` does the same for unordered terms within a distance. Shards are rows, so texts are never
shuffled, a shard holds a bounded number of bytes (one longer text is a shard of its own), and a lost executor
repeats only its shards. Queries travel to the shards in blocks of a stated size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratewise.llm import words as W
from ratewise.session import scratch_path

SHARD_BYTES = 3 << 20
BLOCK_BYTES = 2 << 20
CHUNK_PHRASES = 1 << 16
CHUNK_POSTINGS = 1 << 20
NO_ID = -(1 << 63)
PARTS = ["docs", "ends", "terms", "firsts", "postings"]
INDEX = "shard string, docs binary, ends binary, terms binary, firsts binary, postings binary"


# Index ------------------------------------------------------------------------------------------


def _shards(wanted: np.ndarray | None, shard_bytes: int):
    """Arrow batches of (doc, text) to index rows; ``wanted``: sorted hashes of the only terms that get postings."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task = W.Splitter(W.alphanumeric()), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = words = made = 0

        def flush():
            docs, lengths, hashes, at = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            firsts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, np.int64)
            parts = [docs.astype(np.int64), np.cumsum(lengths), hashes[firsts], np.append(firsts, len(hashes)).astype(np.int32), at[order]]
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["shard", *PARTS])

        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                found = split(data, offsets)
                at, hashes = np.arange(words, words + len(found.hashes), dtype=np.int32), found.hashes
                if wanted is not None:
                    keep = _member(hashes, wanted)[0]
                    at, hashes = at[keep], hashes[keep]
                held.append((ids[lo:hi], np.diff(found.offsets), hashes, at))
                words += len(found.hashes)
                size += len(data)
                if size >= shard_bytes:
                    yield flush()
                    held, size, words, made = [], 0, 0, made + 1
        if held:
            yield flush()

    return build


def _member(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in a sorted array, and where."""
    if len(ordered) == 0:
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x, at


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", terms: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of a corpus below ``path`` and returns it; ``terms`` limits the postings to hashes that will be asked.

    A null text has no words and a null id is kept as the least number; every row is a document of its own.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    texts.mapInArrow(_shards(None if terms is None else np.sort(terms), shard_bytes), INDEX).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def term_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of a few texts, in order."""
    column = pa.array(texts, pa.string())
    split, out = W.Splitter(W.alphanumeric()), []
    for _, _, data, offsets in W.slices(column):
        found = split(data, offsets)
        out += [found.hashes[a:b] for a, b in zip(found.offsets[:-1], found.offsets[1:])]
    return out


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of some terms (sorted hashes) occurs in the corpus: one small row per term and shard, summed by Spark."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), np.int64)
        for frame in frames:
            for own, firsts in zip(frame["terms"], frame["firsts"]):
                found, at = _member(np.frombuffer(own, W.U), terms)
                total[at[found]] += np.diff(np.frombuffer(firsts, np.int32))[found]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    rows = index.select("terms", "firsts").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


class Shard:
    """One index row as arrays."""

    def __init__(self, docs: bytes, ends: bytes, terms: bytes, firsts: bytes, postings: bytes):
        self.docs, self.ends = np.frombuffer(docs, np.int64), np.frombuffer(ends, np.int64)
        self.terms, self.firsts, self.postings = np.frombuffer(terms, W.U), np.frombuffer(firsts, np.int32), np.frombuffer(postings, np.int32)

    def keys(self) -> np.ndarray:
        """Number of the term and word position of every posting in one ascending number."""
        return np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.firsts)) << 32 | self.postings

    def of(self, term: np.uint64) -> np.ndarray:
        """Word positions of a term, ascending."""
        at = int(np.searchsorted(self.terms, term))
        if at == len(self.terms) or self.terms[at] != term:
            return self.postings[:0]
        return self.postings[self.firsts[at] : self.firsts[at + 1]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        """Which of the shard's documents holds a word position."""
        return np.searchsorted(self.ends, position, "right")

    def near(self, terms: np.ndarray, order: np.ndarray, distance: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``distance`` words away in the same document."""
        at = self.of(terms[order[0]])
        for k in order[1:]:
            own = self.of(terms[k])
            if len(at) == 0 or len(own) == 0:
                return at[:0]
            doc, ok = self.doc_of(at), np.zeros(len(at), bool)
            right = np.searchsorted(own, at)
            for side in (np.maximum(right - 1, 0), np.minimum(right, len(own) - 1)):
                ok |= (np.abs(own[side] - at) <= distance) & (self.doc_of(own[side]) == doc)
            at = at[ok]
        return at


class Phrases:
    """Runs of consecutive words of some items, found in a shard all at once.

    ``words``: hashes of the items' words in a row; a phrase is ``lengths[i]`` words from ``starts[i]`` on, of item ``owners[i]``.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int | None = None):
        self.names = [name for name, _ in items]
        sizes = np.array([len(t) for _, t in items], np.int64)
        self.words = np.concatenate([t for _, t in items]) if items else np.empty(0, W.U)
        # An item of fewer words than the window, but not none, is one phrase; without a window every item is.
        lengths = np.minimum(sizes, window) if window else sizes
        each = np.where(sizes > 0, sizes - lengths + 1, 0)
        self.owners = np.repeat(np.arange(len(items)), each)
        first = np.cumsum(sizes) - sizes
        self.starts = first[self.owners] + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        self.lengths = lengths[self.owners]
        self.counts = np.zeros(len(self.words), np.int64)

    def count(self, index: DataFrame) -> Phrases:
        """Learns how often each word occurs in the corpus; phrases with a word that never does are dropped."""
        vocabulary, which = np.unique(self.words, return_inverse=True)
        self.counts = term_counts(index, vocabulary)[which] if len(vocabulary) else self.counts
        absent = np.concatenate([[0], np.cumsum(self.counts == 0)])
        keep = absent[self.starts + self.lengths] == absent[self.starts]
        self.owners, self.starts, self.lengths = self.owners[keep], self.starts[keep], self.lengths[keep]
        return self

    def find(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of all occurrences: the postings of the rarest words of all phrases, moved by their offsets, are
        intersected with those of the next rarest, until every word has been asked for."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.starts) or not len(shard.terms):
            return none
        has, term = _member(self.words, shard.terms)
        missing = np.concatenate([[0], np.cumsum(~has)])
        alive = np.flatnonzero(missing[self.starts + self.lengths] == missing[self.starts])
        key, found = shard.keys(), [none]
        for lo in range(0, len(alive), CHUNK_PHRASES):
            found += self._found(shard, key, term, alive[lo : lo + CHUNK_PHRASES])
        return tuple(np.concatenate(x) for x in zip(*found))

    def _found(self, shard: Shard, key: np.ndarray, term: np.ndarray, alive: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        most = int(self.lengths[alive].max())
        offsets = np.arange(most)
        inside = offsets[None, :] < self.lengths[alive][:, None]
        at = np.where(inside, self.starts[alive][:, None] + offsets, 0)
        order = np.argsort(np.where(inside, self.counts[at], np.iinfo(np.int64).max), axis=1, kind="stable")
        rare = term[self.starts[alive] + order[:, 0]]
        begins = shard.firsts[rare].astype(np.int64)
        n = shard.firsts[rare + 1] - begins
        # So many phrases at once as have a bounded number of postings of their rarest words.
        parts = np.cumsum(n) // CHUNK_POSTINGS
        for part in np.unique(parts):
            some = np.flatnonzero(parts == part)
            ends = np.cumsum(n[some])
            phrase = np.repeat(some, n[some])
            place = np.repeat(begins[some] - (ends - n[some]), n[some]) + np.arange(int(ends[-1]))
            start = shard.postings[place].astype(np.int64) - order[phrase, 0]
            for k in range(1, most):
                asked = self.lengths[alive][phrase] > k
                offset = order[phrase, k]
                wanted = term[np.where(asked, self.starts[alive][phrase] + offset, 0)].astype(np.int64) << 32 | np.maximum(start + offset, 0)
                ok = ~asked | ((start >= 0) & _member(wanted, key)[0])
                phrase, start = phrase[ok], start[ok]
            last = start + self.lengths[alive][phrase] - 1
            ok = (start >= 0) & (shard.doc_of(start) == shard.doc_of(last))
            yield alive[phrase[ok]], start[ok]


# Matches ----------------------------------------------------------------------------------------


def phrase_matches(index: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """(query, doc, position of the first word) of every exact occurrence of the phrases; a phrase without words has none."""
    phrases = Phrases(_worded(queries)).count(index)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = Shard(*row)
                begins = np.concatenate([[0], shard.ends[:-1]])
                which, at = phrases.find(shard)
                doc = shard.doc_of(at)
                yield pd.DataFrame({"query": [phrases.names[i] for i in phrases.owners[which]], "doc": shard.docs[doc], "position": at - begins[doc]})

    return index.select(*PARTS).mapInPandas(search, "query string, doc long, position long")


def _worded(queries: list[tuple[str, str | None]]) -> list[tuple[str, np.ndarray]]:
    return [(name, t) for (name, _), t in zip(queries, term_hashes([q for _, q in queries])) if len(t)]


def proximity_matches(index: DataFrame, queries: list[tuple[str, str]], distance: int) -> DataFrame:
    """(query, doc, position) of every occurrence of a query's rarest term that has all its other terms at most ``distance`` words away."""
    named = _worded(queries)
    vocabulary = np.unique(np.concatenate([t for _, t in named])) if named else np.empty(0, W.U)
    counts = term_counts(index, vocabulary)
    asked = [(name, t, np.argsort(n, kind="stable")) for name, t in named if (n := counts[np.searchsorted(vocabulary, t)]).min() > 0]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = Shard(*row)
                begins = np.concatenate([[0], shard.ends[:-1]])
                for name, terms, order in asked:
                    at = shard.near(terms, order, distance)
                    doc = shard.doc_of(at)
                    if len(at):
                        yield pd.DataFrame({"query": name, "doc": shard.docs[doc], "position": at - begins[doc]})

    return index.select(*PARTS).mapInPandas(search, "query string, doc long, position long")


def _spans(index: DataFrame, phrases: Phrases) -> DataFrame:
    """(shard, first word, word after the last, item) of every occurrence of a phrase."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(phrases.names, object)
        for frame in frames:
            for name, *parts in frame.itertuples(index=False):
                which, at = phrases.find(Shard(*parts))
                if len(at):
                    yield pd.DataFrame({"shard": name, "first": at, "after": at + phrases.lengths[which], "item": names[phrases.owners[which]]})

    return index.select("shard", *PARTS).mapInPandas(search, "shard string, first long, after long, item string")


def _report(key: tuple, shards: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Per document of a shard: words, words inside any span, and the items with spans."""
    docs, ends = np.frombuffer(shards["docs"].iloc[0], np.int64), np.frombuffer(shards["ends"].iloc[0], np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    depth = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(depth, spans["first"].to_numpy(np.int64), 1)
    np.add.at(depth, spans["after"].to_numpy(np.int64), -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
    items: list[list[str]] = [[] for _ in docs]
    owner = np.searchsorted(ends, spans["first"].to_numpy(np.int64), "right")
    for d, item in sorted(set(zip(owner.tolist(), spans["item"]))):
        items[d].append(item)
    return pd.DataFrame({"doc": docs, "n_words": ends - begins, "n_hit": covered[ends] - covered[begins], "items": items})


def contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, sorted ``items`` found in it, and ``contaminated``.

    A phrase is ``window`` consecutive words of an item, or a shorter item as a whole; a document word inside any occurrence
    is hit; a document is contaminated if at least one word in twenty is hit. Words are runs of letters, digits and bytes beyond
    ASCII, with A-Z lower-cased. Null and empty texts have no words; items without words or with a null id are
    skipped; equal items are all reported; rows that share an id are documents of their own. Items are taken in blocks of
    about ``block_bytes`` of text (one longer item is never cut), so a benchmark of any size fits; the index is built once and
    holds the postings of all words of the corpus.
    """
    listed = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body"))
    size = listed.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    rows = listed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(-(-size // block_bytes) or 1)))
    blocks = [r[0] for r in rows.select("block").distinct().orderBy("block").collect()]
    index = build_index(docs, scratch_path(spark, "index"), id_col, text_col)
    spans = spark.createDataFrame([], "shard string, first long, after long, item string")
    for block in blocks:
        items = rows.filter(F.col("block") == block).select("item", "body").collect()
        spans = spans.unionByName(_spans(index, Phrases(_worded([(i["item"], i["body"]) for i in items]), window).count(index)))
    report = "doc long, n_words long, n_hit long, items array<string>"
    out = index.select("shard", "docs", "ends").groupBy("shard").cogroup(spans.groupBy("shard")).applyInPandas(_report, report)
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), "n_words", "n_hit", "items", hit.alias("contaminated"))
