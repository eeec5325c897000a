"""Best-fit packing of token sequences under conflicts.

Documents are dealt by id hash into shards of about ``shard_docs`` documents; each shard is packed by itself, so any number of
documents, sources or copies packs in tasks of bounded size and nothing is left out. Within a shard pieces go from the
longest on into bins ordered by what is left of them. Each bin carries bitmaps of the sources and duplicate clusters it holds;
the search starts at the least residual that is large enough and goes on to the next one until a bin without conflict is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.llm import words as W
from ratewise.llm.encoding import worker_encoder
from ratewise.session import cut_lineage

SHARD_DOCS = 4096
SLICE = 1 << 20


def best_fit(lengths: list[int], marks: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given longest first; pieces whose marks (bitmaps) share a bit never share a bin."""
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []
    out = []
    for length, mark in zip(lengths, marks):
        at = bisect_left(bins, (length, -1))
        while at < len(bins) and held[bins[at][1]] & mark:
            at += 1
        if at < len(bins):
            left, number = bins.pop(at)
        else:
            left, number = capacity, len(held)
            held.append(0)
        out.append((number, capacity - left))
        held[number] |= mark
        insort(bins, (left - length, number))
    return out


def _bits(columns: list[list]) -> list[int]:
    """One bitmap per row: a bit for each value that occurs more than once in its column; null has none."""
    marks, next_bit = [0] * len(columns[0]) if columns else [], 0
    for column in columns:
        bit = {v: next_bit + k for k, v in enumerate(v for v, n in Counter(column).items() if n > 1 and v is not None)}
        next_bit += len(bit)
        marks = [m | (1 << bit[v]) if v in bit else m for m, v in zip(marks, column)]
    return marks


def pack(lengths: DataFrame, capacity: int, conflicts: list[str], id_col: str = "doc_id", length_col: str = "n_tokens", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Places every document: id, ``piece``, ``bin_id``, ``start`` in the bin, ``length``.

    No bin holds two pieces that agree in a non-null ``conflicts`` column. A document longer than ``capacity`` is cut
    into full bins and a rest; pieces of one document are in conflict as far as its columns say. A null or negative length counts as 0
    and is placed too. Ties go by id; rows that share an id are placed one by one. An empty table has no bins. The values of
    conflict columns are compared as text.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = lengths.count()
    shards = max(1, -(-n // shard_docs))
    named = [F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(conflicts)]
    rows = lengths.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"), *named)
    # The copies of one repeated id are dealt by their other columns too.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "n", *[f"c{k}" for k in range(len(conflicts))]), F.lit(shards)))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = np.maximum(1, -(-pdf["n"].to_numpy(np.int64) // capacity))
        out = pdf.loc[np.repeat(pdf.index.to_numpy(), pieces)].reset_index(drop=True)
        out["piece"] = np.concatenate([np.arange(k) for k in pieces]) if len(pieces) else []
        out["length"] = np.minimum(out["n"] - out["piece"] * capacity, capacity)
        out = out.sort_values(["length", "id", "piece", *[f"c{k}" for k in range(len(conflicts))]], ascending=[False, True, True, *[True] * len(conflicts)], kind="stable", na_position="first")
        marks = _bits([[None if pd.isna(v) else v for v in out[f"c{k}"]] for k in range(len(conflicts))]) or [0] * len(out)
        placed = best_fit(out["length"].tolist(), marks, capacity)
        out["bin_id"] = [int(key[0]) * (1 << 32) + b for b, _ in placed]
        out["start"] = [s for _, s in placed]
        return out[["id", "piece", "bin_id", "start", "length"]]

    done = rows.groupBy("shard").applyInPandas(place, "id long, piece long, bin_id long, start long, length long")
    return done.withColumnRenamed("id", id_col)


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, keep: list[str], added: int = 1) -> DataFrame:
    """Ids of every whole text, counted, with ``added`` closing ids, and the columns to keep; a null text is empty."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text"), SLICE):
                n = encoder.lengths(data, offsets) + added
                others = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(n)], names=[*batch.schema.names[1:], "n_tokens"])

    kept = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)])
    schema = ", ".join(["id long", *[f"k{i} string" for i in range(len(keep))], "n_tokens long"])
    out = kept.mapInArrow(emit, schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Packs documents by their token counts; no bin holds two texts of one source or two copies of one text."""
    copies = docs.select(F.col(id_col), F.col(text_col), F.col(source_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("copy_of_text"))
    # The lengths are counted and then dealt out: written once, the texts are encoded once.
    lengths = cut_lineage(token_lengths(copies, tokenizer, id_col, text_col, [source_col, "copy_of_text"]), "lengths")
    return pack(lengths, capacity, [source_col, "copy_of_text"], id_col)
