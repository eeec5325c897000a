"""Token counts with a sentencepiece model: whole texts in, lengths out.

Texts go to the library in batches of about equal bytes. A longer text is cut at safe boundaries first: before a
single space between two other characters. The model merges nothing across a space (no piece holds one after another
character, which is checked) and puts a space before every text it is given, so the parts' counts add up to the whole text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.llm import words as W

BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 16
SPACE = "▁"


class PieceCounter:
    """Counts of texts; ``part_chars`` is the length beyond which a text is cut."""

    def __init__(self, path: str, part_chars: int = PART_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.cuts = all(SPACE not in p.lstrip(SPACE) for p in pieces) and self.model.encode(f"a{SPACE}b") == self.model.encode("a b")
        self.part_chars = part_chars

    def parts(self, text: str) -> list[str]:
        """The text, cut before single spaces where it is long; the space itself is what the model puts before a part."""
        if len(text) <= self.part_chars or not self.cuts:
            return [text]
        out, first = [], 0
        while len(text) - first > self.part_chars:
            at = text.find(" ", first + self.part_chars // 2)
            while 0 < at < len(text) - 1 and not (self._plain(text[at - 1]) and self._plain(text[at + 1])):
                at = text.find(" ", at + 1)
            if at < 0 or at >= len(text) - 1:
                break
            out.append(text[first:at])
            first = at + 1
        return [*out, text[first:]]

    @staticmethod
    def _plain(c: str) -> bool:
        # ASCII letters and digits neither join with a space in normalisation nor count as one.
        return c.isascii() and c.isalnum()

    def counts(self, texts: list[str]) -> np.ndarray:
        parts = [self.parts(t) for t in texts]
        lengths = np.array([len(x) for x in self.model.encode([p for ps in parts for p in ps], num_threads=1)], np.int64)
        ends = np.concatenate([[0], np.cumsum([len(ps) for ps in parts], dtype=np.int64)])
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends])


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    No begin or end tokens are added and nothing is cut off; special strings inside texts are ordinary text to this library. A null
    or empty text has no bytes and no tokens; ids are passed on as they are, null or repeated; other columns are not read.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text"), BATCH_BYTES):
                body = data.tobytes()
                n = counter.counts([body[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, "id long, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
