"""Language identification by piece unigrams summed over all segmentations.

The pieces are those of a fixed public vocabulary (as bytes, single bytes included, so every word has a segmentation). Each language has
a probability for every piece; a word's probability is the sum over all its segmentations, found by a forward pass over its bytes;
a text's is the product over its words. The probabilities are trained by expectation-maximisation on the distinct
words of labelled texts: each round is one Spark job over (language, word, count) rows that returns expected piece
counts, bounded by languages times vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratewise.llm import words as W
from ratewise.session import cut_lineage

SPAN = 40  # the longest piece in bytes; in training alone, longer words are taken in spans of so many bytes
RESCALE = 16
BEGINS = 256
WORDS = 1 << 14
SEEN = 1 << 18  # words of which a task holds the scores
SLICE = 1 << 19
ROUNDS = 3
SMOOTHING = 0.1
LEAST = 1e-7
SAMPLE_ROWS = 20_000
UNKNOWN = "und"


def vocabulary(model: str) -> list[bytes]:
    """Pieces of a sentencepiece model that lie within a word, as bytes; a leading space marks a word's begin."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {bytes([b]) for b in range(256)}
    for i in range(pieces.vocab_size()):
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i)):
            body = pieces.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in body[1:] and len(body) <= SPAN:
                found.add(body)
    return sorted(found)


class Lattice:
    """Finds pieces in words and sums over segmentations, for many words of one length at a time."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted({len(p) for p in pieces}):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == m])
            keys = self._hash(np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), m))[:, 0]
            order = np.argsort(keys)
            self.by_length[m] = keys[order], at[order]

    @staticmethod
    def _hash(rows: np.ndarray, length: int | None = None) -> np.ndarray:
        """Hashes of all runs of ``length`` bytes (default: whole rows) of equally long rows."""
        length = length or rows.shape[1]
        n = rows.shape[1] - length + 1
        h = np.zeros((len(rows), n), W.U)
        for j in range(length):
            h = h * W.U(0xD1342543DE82EF95) + rows[:, j : j + n].astype(W.U) + W.U(1)
        return W.mix(h)

    def arcs(self, rows: np.ndarray, longest: int | None = None) -> dict[int, np.ndarray]:
        """Piece numbers (words x begins) by piece length; -1 where there is none."""
        out, h = {}, np.zeros(rows.shape, W.U)
        for m in range(1, min(longest or rows.shape[1], rows.shape[1]) + 1):
            n = rows.shape[1] - m + 1
            h = h[:, :n] * W.U(0xD1342543DE82EF95) + rows[:, m - 1 :].astype(W.U) + W.U(1)
            if m in self.by_length:
                keys, at = self.by_length[m]
                mixed = W.mix(h)
                place = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
                found = np.where(keys[place] == mixed, at[place], -1)
                if (found >= 0).any():
                    out[m] = found
        return out

    def forward(self, arcs: dict[int, np.ndarray], n: int, width: int, p: np.ndarray) -> np.ndarray:
        """Sums over segmentations of prefixes: words x (width + 1) x languages; ``p``: (pieces + 1) x languages, last row 0."""
        alpha = np.zeros((width + 1, n, p.shape[1]))
        alpha[0] = 1
        for t in range(1, width + 1):
            for m, found in arcs.items():
                if m <= t:
                    alpha[t] += alpha[t - m] * p[found[:, t - m]]
        return alpha

    def log_sums(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations of equally long words of any length: words x languages.

        Only the sums that the longest piece can reach back to are held, scaled up again and again; pieces are looked up for a
        bounded number of begins at a time.
        """
        n, width = rows.shape
        reach = min(max(self.by_length), width)
        ring, scale = np.zeros((reach + 1, n, p.shape[1])), np.zeros((n, p.shape[1]))
        ring[0] = 1
        # Sums at t are added to from every begin before it, so the ring holds those of t to t + reach.
        for lo in range(0, width, BEGINS):
            arcs = self.arcs(rows[:, lo : lo + BEGINS + reach - 1], reach)
            for t in range(lo, min(width, lo + BEGINS)):
                here = ring[t % (reach + 1)].copy()
                ring[t % (reach + 1)] = 0
                for m, found in arcs.items():
                    if t + m <= width:
                        ring[(t + m) % (reach + 1)] += here * p[found[:, t - lo]]
                if t % RESCALE == RESCALE - 1:
                    top = ring.max(axis=0)
                    ring /= top
                    scale += np.log(top)
        return np.log(ring[width % (reach + 1)]) + scale

    def backward(self, arcs: dict[int, np.ndarray], n: int, width: int, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((width + 1, n, p.shape[1]))
        beta[width] = 1
        for t in range(width - 1, -1, -1):
            for m, found in arcs.items():
                if t + m <= width:
                    beta[t] += beta[t + m] * p[found[:, t]]
        return beta


def _spans(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words with the space before them, cut into spans of at most ``SPAN`` bytes, and each span's word."""
    out, owner = [], []
    for i, w in enumerate(words):
        body = b" " + w
        for a in range(0, len(body), SPAN):
            out.append(body[a : a + SPAN])
            owner.append(i)
    return out, np.array(owner, np.int64)


def _by_width(spans: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = np.array([len(s) for s in spans])
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield int(width), at, np.frombuffer(b"".join(spans[i] for i in at), np.uint8).reshape(len(at), width)


@dataclass
class Model:
    """Languages, pieces, and probabilities (pieces + 1) x languages; the last row stands for no piece."""

    languages: list[str]
    pieces: list[bytes]
    p: np.ndarray

    def word_scores(self, lattice: Lattice, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word, with the space before it, in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for lo in range(0, len(words), WORDS):
            for _, at, rows in _by_width([b" " + w for w in words[lo : lo + WORDS]]):
                out[lo + at] = lattice.log_sums(rows, self.p)
        return out


def word_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all given texts, counted in the tasks before they are shuffled."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = W.Splitter(W.alphanumeric())
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                found = split(data, offsets)
                body = split.table[data].tobytes()
                names, code = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                key = W.joined(code[found.owner()].astype(W.U), found.hashes)
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                words = [body[a:b] for a, b in zip(found.starts[first], found.ends[first])]
                owner = code[found.owner()[first]] if len(first) else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(names[owner].astype(object), pa.string()), pa.array(words, pa.binary()), pa.array(n)], names=["lang", "word", "n"])

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(emit, "lang string, word binary, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, sample_rows: int | None = SAMPLE_ROWS) -> Model:
    """Fits the piece probabilities on the rows with a text and a language, or on about ``sample_rows`` of them chosen by hash.

    Languages are those of all such rows. Each has the same number of sampled rows, or all it has if they are fewer, so that a rare
    language is learned like a common one.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if sample_rows is not None:
        found = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
        each = sample_rows / max(1, len(found))
        share = F.lit(0)
        for name, n in sorted(found.items()):
            share = F.when(F.col(lang_col) == name, F.lit(int(min(1.0, each / n) * (1 << 30)))).otherwise(share)
        known = known.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < share)
    counts = cut_lineage(word_counts(known, text_col, lang_col), "words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    pieces = vocabulary(model)
    p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    p[-1] = 0
    for _ in range(rounds if languages else 0):
        current = p

        def expect(frames: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(pieces), np.zeros(current.shape)
            for frame in frames:
                for k, part in frame.groupby("lang"):
                    column = languages.index(k)
                    spans, owner = _spans(list(part["word"]))
                    n = part["n"].to_numpy(np.float64)[owner]
                    own = current[:, [column]]
                    for width, at, rows in _by_width(spans):
                        arcs = lattice.arcs(rows)
                        alpha, beta = lattice.forward(arcs, len(rows), width, own), lattice.backward(arcs, len(rows), width, own)
                        weight = n[at][:, None] / alpha[width]
                        for m, found in arcs.items():
                            for t in range(width - m + 1):
                                share = (weight * alpha[t] * beta[t + m] * own[found[:, t]])[:, 0]
                                total[:, column] += np.bincount(found[:, t] + 1, share, len(total) + 1)[np.r_[1 : len(total), 0]]
            at, column = np.nonzero(total[:-1])
            yield pd.DataFrame({"piece": at, "lang": column, "w": total[at, column]})

        sums = counts.mapInPandas(expect, "piece int, lang int, w double").groupBy("piece", "lang").agg(F.sum("w").alias("w")).toPandas()
        p = np.zeros(p.shape)
        p[sums["piece"], sums["lang"]] = sums["w"]
        p[:-1] = np.maximum((p[:-1] + SMOOTHING) / (p[:-1].sum(0) + SMOOTHING * len(pieces)), LEAST)
    return Model(languages, pieces, p)


def identify(docs: DataFrame, fitted: Model, id_col: str = "doc_id", text_col: str = "text", others: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (posterior of that language under equal priors), and ``others``
    (one named like the text column is the text itself).

    A null text, a text without a letter, or a model without languages gives ``und`` and 0. Every word of a text counts, whatever
    its length. Equal posteriors go to the first language by name. Rows and ids pass as they are.
    """
    others = others or {}
    # The text travels once, also where it is asked for.
    passed = ["id", *["text" if n == text_col else f"o{i}" for i, n in enumerate(others)]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, lattice = W.Splitter(W.alphanumeric()), Lattice(fitted.pieces)
        names = np.array(fitted.languages, object)
        seen, scores = np.empty(0, W.U), np.empty((0, len(names)))
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in W.slices(batch.column("text"), SLICE):
                found = split(data, offsets)
                keys, first, which = np.unique(found.hashes, return_index=True, return_inverse=True)
                if len(seen) > SEEN:
                    seen, scores = seen[:0], scores[:0]
                at = np.searchsorted(seen, keys)
                new = np.ones(len(keys), bool)
                new[at < len(seen)] = seen[at[at < len(seen)]] != keys[at < len(seen)]
                if new.any():
                    body = split.table[data].tobytes()
                    own = fitted.word_scores(lattice, [body[found.starts[i] : found.ends[i]] for i in first[new]])
                    seen, scores = np.insert(seen, at[new], keys[new]), np.insert(scores, at[new], own, axis=0)
                    at = np.searchsorted(seen, keys)
                total = np.concatenate([np.zeros((1, len(names))), np.cumsum(scores[at][which], axis=0)])
                total = total[found.offsets[1:]] - total[found.offsets[:-1]]
                ok = letters[lo:hi] & (len(names) > 0)
                pred, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if len(names):
                    best = total.argmax(1)
                    post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    pred[ok], score[ok] = names[best[ok]], post[ok]
                kept = [batch.column(c).slice(lo, hi - lo) for c in passed]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], names=[*passed, "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), letters.alias("letters"), *[c.alias(n) for n, c in zip(passed[1:], others.values()) if n != "text"])
    kinds = dict(given.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in passed], "lang_pred string", "score double"])
    out = given.mapInArrow(emit, schema)
    return out.select(F.col("id").alias(id_col), *[F.col(c).alias(n) for c, n in zip(passed[1:], others)], "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
