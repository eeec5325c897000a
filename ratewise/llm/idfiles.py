"""Token-id files: every document compressed by itself with one shared zstandard dictionary, found through an offset index.

A shard file holds ``MAGIC``, the sha256 of the dictionary, the width of an id in bytes, the documents' frames, then the index
(document ids, frame offsets, id counts) and its place. One document is read with two small reads. The dictionary lies beside
the shards under its hash; the manifest (Parquet, committed by Spark) names the shard files that count, so files of
lost or repeated task attempts are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratewise.llm import words as W
from ratewise.llm.encoding import worker_encoder

MAGIC = b"RWIDS01\n"
HEAD, TAIL = "<8s32sQ", "<QQ"
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 20_000
SLICE = 1 << 20
NO_ID = -(1 << 63)
MANIFEST = "shard int, name string, first long, last long, docs long, ids long"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; of samples too few to train on, their bytes themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _place(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _read(root: str, name: str) -> bytes:
    files, base = _place(root)
    with files.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def _dictionary(root: str, digest: str) -> zstandard.ZstdCompressionDict | None:
    body = _read(root, f"{digest}.dict")
    if hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("the dictionary does not have the hash the shards name")
    return zstandard.ZstdCompressionDict(body) if body else None


class ShardWriter:
    """Frames, offsets and counts of one shard."""

    def __init__(self, root: str, digest: str, width: int):
        self.files, self.base = _place(root)
        self.name = f"shard-{uuid.uuid4().hex}.ids"
        self.files.create_dir(self.base, recursive=True)
        self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
        self.out.write(struct.pack(HEAD, MAGIC, bytes.fromhex(digest), width))
        self.at = struct.calcsize(HEAD)
        self.kind = np.dtype(f"<u{width}")
        shared = _dictionary(root, digest)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True) if shared else zstandard.ZstdCompressor(level=3)
        self.docs: list[int] = []
        self.offsets: list[int] = []
        self.counts: list[int] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        frame = self.pack.compress(ids.astype(self.kind).tobytes())
        self.docs.append(doc)
        self.offsets.append(self.at)
        self.counts.append(len(ids))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        n = len(self.docs)
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array([*self.offsets, self.at], "<u8").tobytes() + np.array(self.counts, "<u4").tobytes() + struct.pack(TAIL, self.at, n))
        self.out.close()


class ShardReader:
    """Random access to one shard."""

    def __init__(self, root: str, name: str):
        files, base = _place(root)
        self.file = files.open_input_file(f"{base}/{name}")
        magic, digest, width = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        if magic != MAGIC:
            raise ValueError(f"{name} is no id shard")
        size = self.file.size()
        index, n = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        body = self.file.read_at(size - struct.calcsize(TAIL) - index, index)
        self.docs = np.frombuffer(body, "<i8", n)
        self.offsets = np.frombuffer(body, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(body, "<u4", n, 8 * n + 8 * (n + 1))
        self.kind = np.dtype(f"<u{width}")
        shared = _dictionary(root, digest.hex())
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.unpack.decompress(self.file.read_at(b - a, a)), self.kind)

    def find(self, doc: int) -> list[np.ndarray]:
        """Ids of every row with the document id; documents lie in ascending order."""
        a, b = np.searchsorted(self.docs, [doc, doc + 1])
        return [self.ids(i) for i in range(a, b)]


def _write(root: str, digest: str, tokenizer: str, end_id: int, width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.slices(batch.column("text"), SLICE):
                if writer is None:
                    writer, encoder = ShardWriter(root, digest, width), worker_encoder(tokenizer)
                ids, ends = encoder.encode(data, offsets)
                for i in range(hi - lo):
                    writer.add(int(docs[lo + i]), np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "name": writer.name, "first": writer.docs[0], "last": writer.docs[-1], "docs": len(writer.docs), "ids": sum(writer.counts)}],
                schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]),
            )

    return emit


def write_ids(docs: DataFrame, root: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents, each closed by ``end_id``, in ascending id order, and returns the manifest.

    A null text is empty (its ids are the end id alone); a null id comes first, stored as the least 64-bit number; rows that share
    an id lie in the order of their texts' hashes. An empty table has an empty manifest. ``root`` must be a folder or URI
    all executors reach. The dictionary is trained on about ``SAMPLE_ROWS`` documents drawn by hash, the
    first ``SAMPLE_CHARS`` characters of each; it changes sizes, never ids.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoder = worker_encoder(tokenizer)
    width = 2 if len(encoder.closes) <= 1 << 16 else 4
    chance = SAMPLE_ROWS / max(SAMPLE_ROWS, docs.count())
    drawn = F.pmod(F.xxhash64("doc", F.xxhash64("text")), F.lit(1 << 30)) < int(chance * (1 << 30))
    sample = texts.filter(drawn).select("doc", F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_ROWS).collect()
    sample.sort(key=lambda r: (r["doc"], r["text"]))
    arrays = []
    for _, _, data, offsets in W.slices(pa.array([r["text"] for r in sample], pa.string()), SLICE):
        ids, ends = encoder.encode(data, offsets)
        arrays += [ids[a:b].astype(f"<u{width}").tobytes() for a, b in zip(ends[:-1], ends[1:])]
    body = train_dictionary(arrays)
    digest = hashlib.sha256(body).hexdigest()
    files, base = _place(root)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/{digest}.dict") as f:
        f.write(body)
    ordered = texts.withColumn("h", F.xxhash64("text")).repartitionByRange("doc", "h").sortWithinPartitions("doc", "h", "text").select("doc", "text")
    ordered.mapInArrow(_write(root, digest, tokenizer, end_id, width), MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per shard with ``start``, the number of ids in all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, root: str, arrays: bool = True) -> DataFrame:
    """All documents of the files: ``doc``, ``start``, ``n_tokens``, ``ids_crc32`` (little-endian 32-bit ids) and, if asked, ``ids``."""
    manifest = read_manifest(spark, root)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = ShardReader(root, row.name)
                starts = row.start + np.cumsum(shard.counts, dtype=np.int64) - shard.counts
                for lo in range(0, len(shard.docs), 2_000):
                    hi = min(lo + 2_000, len(shard.docs))
                    ids = [shard.ids(i).astype("<u4") for i in range(lo, hi)]
                    out = pd.DataFrame({"doc": shard.docs[lo:hi], "start": starts[lo:hi], "n_tokens": shard.counts[lo:hi].astype(np.int64), "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})
                    yield out.assign(ids=ids) if arrays else out

    schema = "doc long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if arrays else "")
    shards = manifest.select("name", "start").repartition(max(1, manifest.count()))
    return shards.mapInPandas(emit, schema)


def find_document(spark: SparkSession, root: str, doc: int) -> list[np.ndarray]:
    """Ids of one document: the manifest names its shards, the index its frame."""
    names = [r["name"] for r in read_manifest(spark, root).filter((F.col("first") <= doc) & (F.col("last") >= doc)).orderBy("shard").collect()]
    return [ids for name in names for ids in ShardReader(root, name).find(doc)]
