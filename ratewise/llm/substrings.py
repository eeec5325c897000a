"""Repeated word windows across and within documents, found level by level with doubled window lengths.

The first level takes short windows, by default of half the asked length. Of any ``window`` consecutive words exactly one short
window is chosen, the one with the least hash (leftmost on ties), so equal passages choose equal short windows, and only the
chosen ones, about one in six, are counted over the corpus. Full windows whose short window repeats are looked at again with
twice its length, and so on until the full length is reached or no candidate survives. At the last level the full windows
that chose one short window form a run; a run that an earlier document holds as a whole is decided at once, and
the single full windows are compared in the remaining runs, those whose first holder the document is.

Every level is one aggregation by hash (count, least document) whose partial sums are made before the shuffle; its
outcome goes back to one owner document each. No level joins on a hash, so a passage in a third of all documents
loads no task more than others. The texts are shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.llm import words as W

# Which document is earlier: rows without an id, by the hash of their text, then ids; the last part names the document.
ORDER = ["named", "at", "doc"]
ROW = "a long, b long, named byte, at long, doc long"


class Runs:
    """Chosen short windows of the texts of one slice: first and last full window, hashes.

    ``lengths`` are the levels so far; ``single`` holds hashes of short windows that do not repeat, of all levels but the last.
    """

    def __init__(self, words: W.Words, window: int, lengths: list[int], single: np.ndarray):
        h = words.hashes
        full = W.inside_texts(words.offsets, window)
        least = chosen = np.empty(0, W.U)
        for level, length in enumerate(lengths):
            if level:
                full = full[~np.isin(least, single)]
            short = W.windows(h, length)
            least, chosen = short[full], full.copy()
            for step in range(1, window - length + 1):
                other = short[full + step]
                smaller = other < least
                np.copyto(least, other, where=smaller)
                np.copyto(chosen, full + step, where=smaller)
            least = W.joined(least, np.full(len(least), length, W.U))  # keeps the levels apart
        new = np.ones(len(full), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (full[1:] != full[:-1] + 1)
        begins = np.flatnonzero(new)
        self.first = full[begins]
        self.last = full[np.append(begins[1:], len(full))[: len(begins)] - 1]
        self.text = np.searchsorted(words.offsets, self.first, "right") - 1
        self.long = W.windows(h, window)
        self.short = least[begins]
        self.run = W.joined(self.long[self.first], self.long[self.last] + (self.last - self.first).astype(W.U))

    def full_windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, start) of all full windows of the runs ``which``, ascending by start."""
        counts = (self.last - self.first + 1)[which]
        ends = np.cumsum(counts)
        starts = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[which] - (ends - counts), counts)
        return np.repeat(which, counts), starts


def _within(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return W.joined(text.astype(W.U), hashes)


def _lists(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row within the slice, hash) of an array column; null counts as empty."""
    column = batch.column(name).slice(lo, hi - lo)
    lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(hi - lo), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(W.U)


def _emit(docs: list[np.ndarray], text: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(W.signed(a)), pa.array(W.signed(b)), *[pa.array(c[text]) for c in docs]], names=["a", "b", *ORDER])


def _slices(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int]):
    import pyarrow.compute  # noqa: F401  (loads pa.compute)

    split = W.Splitter(W.spaced())
    for batch in batches:
        docs = [batch.column(c).to_numpy(zero_copy_only=False) for c in ORDER]
        known = [c for c in batch.schema.names if c.startswith("single")]
        for lo, hi, data, offsets in W.slices(batch.column("text")):
            found = split(data, offsets)
            single = np.concatenate([np.empty(0, W.U), *[_lists(batch, c, lo, hi)[1] for c in known]])
            yield batch, lo, hi, [c[lo:hi] for c in docs], found, Runs(found, window, lengths, single), single


def _short_windows(window: int, lengths: list[int]):
    def emit(batches):
        for _, _, _, docs, _, runs, _ in _slices(batches, window, lengths):
            yield _emit(docs, runs.text, runs.short, runs.short)

    return emit


def _whole_runs(window: int, lengths: list[int]):
    def emit(batches):
        for _, _, _, docs, _, runs, single in _slices(batches, window, lengths):
            left = ~np.isin(runs.short, single)
            yield _emit(docs, runs.text[left], runs.short[left], runs.run[left])

    return emit


def _owned(runs: Runs, single: np.ndarray, batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs repeat in part, and which of them the document is the first to hold as a whole."""
    left = ~np.isin(runs.short, single)
    own = np.isin(_within(runs.text, runs.run), _within(*_lists(batch, "own_run", lo, hi)))
    return left, own


def _full_windows(window: int, lengths: list[int]):
    def emit(batches):
        for batch, lo, hi, docs, _, runs, single in _slices(batches, window, lengths):
            left, own = _owned(runs, single, batch, lo, hi)
            which, starts = runs.full_windows(np.flatnonzero(left & own))
            yield _emit(docs, runs.text[which], runs.short[which], runs.long[starts])

    return emit


def joined_words(words: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text, one space between them, with text offsets."""
    starts, lengths = words.starts[keep], (words.ends - words.starts)[keep] + 1
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    out = words.data[np.minimum(at, max(0, len(words.data) - 1))] if total else np.empty(0, np.uint8)
    out[ends - 1] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    closing = np.concatenate([[0], ends])[kept]
    # The space after the last word of each text goes.
    drop = closing[1:][np.diff(kept) > 0] - 1
    out = np.delete(out, drop)
    return out, closing - np.concatenate([[0], np.cumsum(np.diff(kept) > 0)])


def _kept(window: int, lengths: list[int], passed: list[str]):
    def emit(batches):
        for batch, lo, hi, _, found, runs, single in _slices(batches, window, lengths):
            left, own = _owned(runs, single, batch, lo, hi)
            which, starts = runs.full_windows(np.flatnonzero(left))
            keys = _within(runs.text[which], runs.long[starts])
            again = np.ones(len(keys), bool)
            again[np.unique(keys, return_index=True)[1]] = False
            again |= ~own[which]
            again |= ~np.isin(keys, _within(*_lists(batch, "own_window", lo, hi)))
            depth = np.zeros(len(found.hashes) + 1, np.int64)
            np.add.at(depth, starts[again], 1)
            np.add.at(depth, starts[again] + window, -1)
            keep = np.cumsum(depth[:-1]) == 0
            body, ends = joined_words(found, keep)
            counts = np.diff(found.offsets)
            kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[found.offsets])
            text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(lo, hi - lo) for c in passed], pa.array(counts), pa.array(counts - kept), text], names=[*passed, "n_words", "n_removed", "kept"],
            )

    return emit


def _first_holders(found: DataFrame, name: str) -> DataFrame:
    """For each document the hashes it is the first to hold."""
    first = found.groupBy("a", "b").agg(F.min(F.struct(*ORDER)).alias("least")).select("b", "least.doc")
    return first.groupBy("doc").agg(F.collect_list("b").alias(name))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, start: int | None = None) -> DataFrame:
    """Documents without the words that lie in a ``window``-word passage which starts earlier in the corpus as well.

    Returns the id, the text as it was, the columns named in ``keep``, ``n_words``, ``n_removed`` and ``kept``: the kept
    words, one space between them.
    Earlier means a smaller id, or the same document and an earlier start; windows are judged on the input. Words are
    runs of non-white-space bytes. A null or empty text has no words and an empty ``kept``; a null id counts as smaller than
    all others. Every row without an id is a document of its own, and so are the different texts of one id: they are ordered by a
    hash of the text. Rows of one id and text are one document, each judged by itself against its own start.
    Texts of fewer than ``window`` words stay whole. ``start`` is the first level's length (half the window if not given); a
    smaller one adds levels, which pays where most short windows repeat but long ones do not. Other columns are not read, and names may clash with those used here.
    """
    start = start or window // 2
    lengths = [start << k for k in range(window.bit_length()) if start << k < window]
    if not lengths:
        raise ValueError("the first level must be shorter than the window")
    keep = keep or []
    kept = F.struct(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    # Equal rows without an id are told apart by their place; which of them counts as the first does not show in the texts kept.
    given, digest = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    name = F.when(given.isNull(), F.xxhash64(digest, F.monotonically_increasing_id())).otherwise(F.xxhash64(digest, given, F.lit(1)))
    texts = docs.select(kept.alias("row"), given.isNotNull().cast("byte").alias("named"), F.coalesce(given, digest).alias("at"), name.alias("doc"), F.col(text_col).alias("text"))
    found = texts
    for level in range(len(lengths)):
        short = found.mapInArrow(_short_windows(window, lengths[: level + 1]), ROW)
        single = short.groupBy("a").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).filter("n = 1")
        found = found.join(single.groupBy("doc").agg(F.collect_list("a").alias(f"single{level}")), "doc", "left")
    own_run = _first_holders(found.mapInArrow(_whole_runs(window, lengths), ROW), "own_run")
    with_runs = found.join(own_run, "doc", "left")
    own_window = _first_holders(with_runs.mapInArrow(_full_windows(window, lengths), ROW), "own_window")
    done = with_runs.join(own_window, "doc", "left")
    schema = f"row {texts.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept string"
    out = done.mapInArrow(_kept(window, lengths, ["row", "text"]), schema)
    return out.select(F.col("row.id").alias(id_col), F.col("text").alias(text_col), *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept")
