"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the id pairs they link.

1. ``encode`` writes every document's ids of both tokenizers, checked against the text's bytes.
2. A slice of documents becomes two Arrow tables of tokens: lists flattened with their parents, byte ends as cumulative sums
   restarted per document. A full outer Acero join on (document, end) gives one row per stretch between neighbouring ends, which is
   one link: tokens overlap exactly where they share such a stretch. Ends found on both sides close a group.
3. ``pair_counts``: distinct (document, pair) rows are counted per task by ``Table.group_by``; Spark adds up these partial counts.
4. ``align`` looks the counts up again from written ranges of first ids. A task reads range after range and holds a bounded
   number of pairs at once; nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratewise.llm import words as W
from ratewise.llm.counts import PieceCounter
from ratewise.session import cut_lineage, scratch_path

SLICE = 1 << 19  # bytes of text
SLICE_TOKENS = 1 << 18
GROUP_LINKS = 1 << 21
RANGE_PAIRS = 1 << 18
HELD_PAIRS = 1 << 23
PARTIAL_PAIRS = 1 << 21
END_BITS = 40
LONG_RUN = 500


# Tokenizers -------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for every byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Ids of a byte-level tokenizers file, special strings being plain text.

    With ``ranks`` (a file of the same vocabulary by rank) and the word pattern, texts of settled characters are encoded through the
    ranks, several times as fast; the files are compared when they are loaded.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)["model"]
        body = {i: bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode() for piece, i in held["vocab"].items()}
        self.bytes = [body.get(i, b"") for i in range(max(body, default=-1) + 1)]
        self.ranked = self._ranked(ranks, pattern, held, letters) if ranks else None

    def _ranked(self, ranks: str, pattern: str, held: dict, letters: dict[str, int]):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            by_rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(i >= len(self.bytes) or self.bytes[i] != piece for piece, i in by_rank.items()):
            raise ValueError("the ranks are not of this vocabulary")
        merged = [m if isinstance(m, list) else m.split(" ") for m in held["merges"]]
        made = [by_rank.get(bytes(letters[c] for c in a + b)) for a, b in merged]
        if made != sorted(set(made)):
            raise ValueError("the merges are not in the order of the ranks")
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=by_rank, special_tokens={})

    def encode(self, texts: list[str], settled: np.ndarray | None = None) -> list[list[int]]:
        fast = [self.ranked is not None] * len(texts) if settled is None else (settled & (self.ranked is not None)).tolist()
        slow = iter(self.model.encode_batch_fast([t for t, ok in zip(texts, fast) if not ok], add_special_tokens=False))
        return [self.ranked.encode_ordinary(t) if ok else next(slow).ids for t, ok in zip(texts, fast)]


class PieceTokenizer:
    """Ids of a sentencepiece model, which puts a space before every text; long texts are cut at safe places."""

    def __init__(self, path: str):
        self.counter = PieceCounter(path)
        model = self.counter.model
        named = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.vocab_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in named]

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.counter.parts(t) for t in texts]
        ids = iter(self.counter.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [next(ids) if len(ps) == 1 else [i for _ in ps for i in next(ids)] for ps in parts]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a slice with a space before each: bytes and offsets."""
    n = len(offsets) - 1
    moved = offsets + np.arange(n + 1)
    out = np.full(len(data) + n, 32, np.uint8)
    own = np.ones(len(out), bool)
    own[moved[:-1]] = False
    out[own] = data
    return out, moved


def settled(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts, each with its space, have only code points below U+0250, whose Unicode classes are old, and no run that regular expressions are slow on."""
    lead = data >= 0xCA
    lead[:-1] |= (data[:-1] == 0xC9) & (data[1:] >= 0x90)
    blank, wide = (data == 32) | ((data >= 9) & (data <= 13)), data >= 0x80
    bad = [np.flatnonzero(lead)]
    for inside in (~blank, blank | wide):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        bad.append(edges[::2][edges[1::2] - edges[::2] >= LONG_RUN])
    # A run may go on over the space before a text; it is long for every text it touches.
    out = np.ones(len(offsets) - 1, bool)
    for at in bad[:1]:
        out[np.searchsorted(offsets, at, "right") - 1] = False
    for inside, at in zip((~blank, blank | wide), bad[1:]):
        for first in at.tolist():
            stop = np.flatnonzero(~inside[first:])
            after = first + int(stop[0]) if len(stop) else len(data)
            out[np.searchsorted(offsets, first, "right") - 1 : np.searchsorted(offsets, after, "left")] = False
    return out


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the range of each list."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends


def equal_bytes(flat: np.ndarray, ends: np.ndarray, vocabulary: pa.Array, want: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts' tokens join to the wanted bytes."""
    if not len(flat):
        return np.diff(offsets) == 0
    _, bounds, body = vocabulary.take(pa.array(flat)).buffers()
    at = np.frombuffer(bounds, np.int64)[: len(flat) + 1][ends]
    body = np.frombuffer(body, np.uint8)[: at[-1]]
    if len(body) == len(want) and np.array_equal(at, offsets) and np.array_equal(body, want):
        return np.ones(len(offsets) - 1, bool)
    return np.array([np.array_equal(body[a:b], want[c:d]) for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])], bool)


def packed(flat: np.ndarray, ends: np.ndarray, keep: np.ndarray, kind: np.dtype) -> pa.Array:
    """The kept lists of ids as bytes, the others empty."""
    sizes = np.where(keep, np.diff(ends), 0)
    body = flat[np.repeat(keep, np.diff(ends))].astype(kind).tobytes()
    offsets = np.concatenate([[0], np.cumsum(sizes * kind.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def unpacked(column: pa.Array, kind: np.dtype) -> pa.ListArray:
    """Lists of ids from their bytes."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    ids = np.frombuffer(body, kind, count=(bounds[-1] - bounds[0]) // kind.itemsize, offset=bounds[0]) if body is not None and bounds[-1] > bounds[0] else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]) // kind.itemsize), pa.array(ids.astype(np.int32)))


def width(first: str, second: str) -> np.dtype:
    """The narrowest number that holds all ids of both vocabularies."""
    most = max(len(t.bytes) for t in (ByteTokenizer(first), PieceTokenizer(second)))
    return np.dtype("<u2" if most <= 1 << 16 else "<u4")


def encode(
    docs: DataFrame, first: str, second: str, kind: np.dtype, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, a, b): packed ids of every text under a byte-level tokenizers file (text with a space before it) and a sentencepiece model.

    Texts that are null, empty, or not the bytes their tokens join to have no ids.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteTokenizer(first, ranks, pattern), PieceTokenizer(second)
        vocabularies = [pa.array(t.bytes, pa.large_binary()) for t in (one, two)]
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text"), SLICE):
                body = data.tobytes()
                texts = [body[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
                want, moved = spaced(data, offsets)
                ids = [flattened(one.encode([" " + t for t in texts], settled(want, moved))), flattened(two.encode(texts))]
                keep = np.diff(offsets) > 0
                for (flat, ends), vocabulary in zip(ids, vocabularies):
                    keep &= equal_bytes(flat, ends, vocabulary, want, moved)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *(packed(flat, ends, keep, kind) for flat, ends in ids)], names=["id", "a", "b"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(emit, f"id {rows.schema['id'].dataType.simpleString()}, a binary, b binary")


def vocabulary_lengths(first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of the two vocabularies."""
    return tuple(np.array([len(x) for x in t.bytes], np.int64) for t in (ByteTokenizer(first), PieceTokenizer(second)))


# Links of a slice -------------------------------------------------------------------------------


def list_slices(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[int, int, pa.ListArray, pa.ListArray]]:
    """Consecutive rows with a bounded number of tokens (one longer row is a slice of its own)."""
    n = batch.num_rows
    sizes = pc.add(pc.binary_length(batch.column("a")), pc.binary_length(batch.column("b"))).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_TOKENS * kind.itemsize, "right")) - 1)
        yield lo, hi, unpacked(batch.column("a").slice(lo, hi - lo), kind), unpacked(batch.column("b").slice(lo, hi - lo), kind)
        lo = hi


def token_ends(lists: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Flattened ids, and (document, end) keys: cumulative byte lengths that start anew in every list."""
    ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    sums = pc.cumulative_sum(pc.take(lengths, ids))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    firsts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
    before = np.concatenate([[0], sums.to_numpy(zero_copy_only=False)])[firsts]
    inside = pc.subtract(sums, pc.take(pa.array(before), parents))
    return ids, pc.add(pc.shift_left(parents.cast(pa.int64()), END_BITS), inside)


def links(a: pa.ListArray, b: pa.ListArray, lengths: tuple[pa.Array, pa.Array]) -> tuple[pa.Array, pa.Array, pa.Table]:
    """Flattened ids of both sides, and the links in order: ``doc`` (row of the slice), token places ``x`` and ``y``, ``common`` (a group ends here)."""
    ids_a, keys_a = token_ends(a, lengths[0])
    ids_b, keys_b = token_ends(b, lengths[1])
    left = pa.table({"key": keys_a, "x": pa.array(np.arange(len(ids_a), dtype=np.int32))})
    right = pa.table({"key": keys_b, "y": pa.array(np.arange(len(ids_b), dtype=np.int32))})
    joined = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
    joined = joined.take(pc.sort_indices(joined.column("key")))
    x, y = joined.column("x").combine_chunks(), joined.column("y").combine_chunks()
    common = pc.and_(pc.is_valid(x), pc.is_valid(y))
    doc = pc.shift_right(joined.column("key"), END_BITS).cast(pa.int32())
    # The token over a stretch is the one that ends next.
    return ids_a, ids_b, pa.table({"doc": doc, "x": pc.fill_null_backward(x), "y": pc.fill_null_backward(y), "common": common})


def pairs_of(ids_a: pa.Array, ids_b: pa.Array, linked: pa.Table) -> pa.Array:
    """The id pair of every link in one number."""
    high = pc.shift_left(pc.take(ids_a, linked.column("x")).cast(pa.int64()), 32)
    return pc.add(high, pc.take(ids_b, linked.column("y")).cast(pa.int64())).combine_chunks()


MARKS = [",", "|", ";", ""]


def written_ids(most: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for mark in MARKS for i in range(most)], pa.large_string())


def group_texts(a: pa.ListArray, b: pa.ListArray, ids_a: pa.Array, ids_b: pa.Array, linked: pa.Table, written: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Groups of every document, and the sha256 of ``a1,a2|b1;a3|b2``: ids of both sides group by group; no tokens, no text.

    ``written`` holds every id followed by each of ``MARKS``, so the text is one take.
    """
    n, na, nb = len(a), len(ids_a), len(ids_b)
    common = linked.column("common").to_numpy()
    doc, x, y = (linked.column(c).to_numpy() for c in ("doc", "x", "y"))
    groups = np.bincount(doc[common], minlength=n)
    last_a, last_b = x[common], y[common]  # last token of every group on either side, over the whole slice
    of_a = np.searchsorted(last_a, np.arange(na))
    of_b = np.searchsorted(last_b, np.arange(nb))
    # In the text the tokens of a group's first side precede those of its second.
    place_a = np.arange(na) + np.concatenate([[0], last_b + 1])[of_a]
    place_b = np.arange(nb) + (last_a + 1)[of_b]
    ids = np.empty(na + nb, np.int32)
    ids[place_a], ids[place_b] = ids_a.to_numpy(), ids_b.to_numpy()
    mark = np.zeros(na + nb, np.int64)
    mark[place_a[last_a]] = MARKS.index("|")
    mark[place_b[last_b]] = MARKS.index(";")
    ends_a = np.concatenate([[0], np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends_b = np.concatenate([[0], np.cumsum(pc.list_value_length(b).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = ends_a + ends_b
    some = np.diff(ends) > 0
    mark[ends[1:][some] - 1] = MARKS.index("")
    if not len(ids):
        return groups, [""] * n
    text = written.take(pa.array(mark * (len(written) // len(MARKS)) + ids))
    _, bounds, body = text.buffers()
    at = np.frombuffer(bounds, np.int64)[text.offset : text.offset + len(text) + 1][ends]
    view = memoryview(body)
    return groups, [hashlib.sha256(view[p:q]).hexdigest() if k else "" for p, q, k in zip(at[:-1], at[1:], some)]


# Counts -----------------------------------------------------------------------------------------


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"pair": out.column("pair"), "n": out.column("n_sum")})


def pair_counts(tokens: DataFrame, lengths: tuple[np.ndarray, np.ndarray], kind: np.dtype) -> DataFrame:
    """(pair, n): how many rows of the table hold an id pair linked."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = tuple(pa.array(x) for x in lengths)
        held: list[pa.Table] = []
        size = 0

        def flush(whole: bool) -> list[pa.RecordBatch]:
            nonlocal held, size
            merged = _merged(held) if held else None
            if merged is None:
                return []
            if whole or merged.num_rows > PARTIAL_PAIRS:
                held, size = [], 0
                return merged.combine_chunks().to_batches()
            held, size = [merged], merged.num_rows
            return []

        for batch in batches:
            for _, _, a, b in list_slices(batch, kind):
                ids_a, ids_b, linked = links(a, b, arrays)
                once = pa.table({"doc": linked.column("doc"), "pair": pairs_of(ids_a, ids_b, linked)}).group_by(["doc", "pair"], use_threads=False).aggregate([])
                part = once.group_by("pair", use_threads=False).aggregate([("doc", "count")])
                held.append(pa.table({"pair": part.column("pair"), "n": part.column("doc_count")}))
                size += part.num_rows
                if size > 2 * PARTIAL_PAIRS:
                    yield from flush(False)
        yield from flush(True)

    return tokens.mapInArrow(emit, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def write_ranges(counts: DataFrame, path: str, range_pairs: int = RANGE_PAIRS) -> None:
    """Counts in files by ranges of first ids, sorted; a first id's pairs (no more than the second vocabulary) share a file."""
    parts = max(1, -(-counts.count() // range_pairs))
    first = F.shiftright("pair", 32)
    counts.withColumn("first", first).repartitionByRange(parts, "first").sortWithinPartitions("pair").select("pair", "n").write.parquet(path)


class Ranges:
    """Written counts, read range by range; those that fit into ``held_pairs`` stay in memory."""

    def __init__(self, path: str, held_pairs: int = HELD_PAIRS):
        self.files, base = fs.FileSystem.from_uri(path)
        found = self.files.get_file_info(fs.FileSelector(base))
        self.paths = sorted(f.path for f in found if f.base_name.endswith(".parquet"))
        self.held: dict[str, tuple] = {}
        self.left = held_pairs

    def _range(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if path in self.held:
            return self.held[path]
        # One file at a time, not as a data set: a range is what may be in memory.
        with self.files.open_input_file(path) as f:
            table = pq.ParquetFile(f).read(use_threads=False)
        pair, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
        first = pair >> 32
        begins = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(pair) else np.empty(0, np.int64)
        most = np.repeat(np.maximum.reduceat(n, begins), np.diff(np.append(begins, len(pair)))) if len(pair) else n
        out = pair, n, n == most
        if len(pair) <= self.left:
            self.left -= len(pair)
            self.held[path] = out
        return out

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each of some sorted pairs, and whether it is the highest of its first id."""
        n, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        for path in self.paths:
            own, counts, most = self._range(path)
            if len(own):
                lo, hi = np.searchsorted(pairs, [own[0], own[-1] + 1])
                at = np.searchsorted(own, pairs[lo:hi])
                n[lo:hi], top[lo:hi] = counts[at], most[at]
        return n, top


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(
    docs: DataFrame, first: str, second: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    range_pairs: int = RANGE_PAIRS, held_pairs: int = HELD_PAIRS,
) -> DataFrame:
    """One row per row of ``docs``: id, tokens of both sides, groups, links, links whose count is their first id's highest (ties
    included), the sum of counts over links, and a digest of the groups.

    Counts are numbers of rows that hold a pair linked, copies and repeated ids included. Rows without tokens (null or empty texts,
    or texts whose tokens do not join to the space and the text) have zeros and an empty digest; ids are passed on as they
    are, null or repeated; other columns are not read; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    root = scratch_path(spark, "tokens")
    kind = width(first, second)
    ids = encode(docs, first, second, kind, ranks, pattern, id_col, text_col)
    ids.write.option("compression", "zstd").parquet(root)
    tokens = spark.read.schema(ids.schema).parquet(root)
    lengths = vocabulary_lengths(first, second)
    counted = scratch_path(spark, "ranges")
    write_ranges(cut_lineage(pair_counts(tokens, lengths, kind), "pairs"), counted, range_pairs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = tuple(pa.array(x) for x in lengths)
        written = written_ids(max(map(len, lengths)))
        ranges = Ranges(counted, held_pairs)
        waiting: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            asked = np.unique(np.concatenate([w[1] for w in waiting]))
            n, top = ranges.look_up(asked)
            for columns, pairs, which, ends in waiting:
                at = np.searchsorted(asked, pairs)
                totals = [np.concatenate([[0], np.cumsum(x[at][which], dtype=np.int64)])[ends] for x in (top, n)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], *(pa.array(np.diff(t)) for t in totals), columns[-1]], names=["id", *COLUMNS, "groups_sha256"])

        for batch in batches:
            for lo, hi, a, b in list_slices(batch, kind):
                ids_a, ids_b, linked = links(a, b, arrays)
                groups, digests = group_texts(a, b, ids_a, ids_b, linked, written)
                coded = pairs_of(ids_a, ids_b, linked).dictionary_encode()
                per_doc = np.bincount(linked.column("doc").to_numpy(), minlength=hi - lo)
                columns = [batch.column("id").slice(lo, hi - lo), *(pc.list_value_length(x).cast(pa.int64()) for x in (a, b)), pa.array(groups.astype(np.int64)), pa.array(per_doc.astype(np.int64)), pa.array(digests)]
                waiting.append((columns, coded.dictionary.to_numpy(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(per_doc)])))
                size += linked.num_rows
                if size > GROUP_LINKS:
                    yield from flush()
                    waiting, size = [], 0
        if waiting:
            yield from flush()

    schema = f"id {tokens.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string"
    return tokens.mapInArrow(emit, schema).withColumnRenamed("id", id_col)
