"""Masked pseudo-likelihood of whole texts under a window network trained here.

Every token (a UTF-8 byte) is predicted from the ``RADIUS`` tokens on either side, itself masked: the neighbours' embeddings, one table
per place, are summed into a hidden layer, and a softmax over the 256 bytes gives the token's conditional probability. A
document's score is the sum of the log-probabilities of its tokens.

Training covers the whole corpus: every task counts its windows, adding up those it keeps in a table of fixed size; Spark adds
the counts up by window, and the network is fitted with numpy on the counted windows. Each round every worker shard starts from the same weights, goes over its windows
once, batch by batch as they arrive, and returns its weights, which are averaged; at most ``MOST_WORKERS`` sets of weights of
a fixed size (0.17 MB) reach the driver. Scoring evaluates each distinct window of a slice once, and not again while a task
keeps it in its table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.llm import words as W
from ratewise.session import cut_lineage

RADIUS = 3  # the widest whose windows fit a 64-bit code
HIDDEN = 24
OUTSIDE = 256  # stands for a place before or after the text
SLICE = 2 << 20
ROWS = 1 << 18
WINDOWS_PER_WORKER = 50_000
MOST_WORKERS = 256
ROUNDS = 4
BATCH = 512
RATE = 0.02
COUNTED_BITS = 21  # a task keeps the counts of at most 2 ** 21 windows (34 MB)
SCORED_BITS = 22  # and the log-probabilities of at most 2 ** 22 (50 MB)
NO_CODE = W.U(2**64 - 1)  # codes have 63 bits


def windows(data: np.ndarray, offsets: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """One 64-bit code per byte of the texts of a slice: its neighbours from left to right and itself, 9 bits each."""
    n = len(data)
    padded = np.full(n + 2 * radius, OUTSIDE, W.U)
    padded[radius : radius + n] = data
    code = np.zeros(n, W.U)
    for step in range(2 * radius + 1):
        code <<= W.U(9)
        code |= padded[step : step + n]
    # Near the ends of a text other texts have come in: these few places are written again.
    full = np.flatnonzero(np.diff(offsets))
    starts, ends = offsets[full], offsets[full + 1]
    at = np.concatenate([starts[:0], *(x for k in range(radius) for x in (np.minimum(starts + k, ends - 1), np.maximum(ends - 1 - k, starts)))])
    text = np.searchsorted(starts, at, "right") - 1
    into, left, own = at - starts[text], ends[text] - at, np.zeros(len(at), W.U)
    for step in range(-radius, radius + 1):
        value = padded[at + radius + step]
        value[(into + step < 0) | (left <= step)] = OUTSIDE
        own = (own << W.U(9)) | value
    code[at] = own
    return code


def _unpack(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, token) of window codes."""
    places = [(codes >> W.U(9 * (2 * radius - k)) & W.U(511)).astype(np.int64) for k in range(2 * radius + 1)]
    token = places.pop(radius)
    return np.stack(places, 1), token


def _token_last(codes: np.ndarray, radius: int, back: bool = False) -> np.ndarray:
    """Window codes with the token in the lowest bits, so that equal neighbours sort together; ``back`` undoes it."""
    low, top = W.U(9 * radius), W.U(9 * (radius + 1))
    kept = codes >> top << top
    if back:
        return kept | (codes & W.U(511)) << low | (codes ^ kept) >> W.U(9)
    return kept | (codes & ((W.U(1) << low) - W.U(1))) << W.U(9) | (codes >> low & W.U(511))


class Kept:
    """A value for each of at most 2 ** ``bits`` window codes. A code has one place, which it may find taken by another."""

    def __init__(self, dtype: type, bits: int) -> None:
        self.codes, self.values, self.shift = np.full(1 << bits, NO_CODE, W.U), np.zeros(1 << bits, dtype), W.U(64 - bits)

    def places(self, codes: np.ndarray) -> np.ndarray:
        return (codes * W.U(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def add(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds to the values of different codes and says which codes found their place taken, so that nothing was added for them."""
        at = self.places(codes)
        free = self.codes[at] == NO_CODE
        self.codes[at[free]] = codes[free]
        mine = self.codes[at] == codes
        self.values[at[mine]] += n[mine]
        return ~mine


@dataclass
class Network:
    """Embeddings (place x 257 x hidden), hidden bias, output weights and bias."""

    e: np.ndarray
    b: np.ndarray
    w: np.ndarray
    c: np.ndarray

    @staticmethod
    def fresh(radius: int = RADIUS, hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (2 * radius, 257, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
            rng.normal(0, 0.1, (hidden, 256)).astype(np.float32), np.zeros(256, np.float32),
        )

    @property
    def radius(self) -> int:
        return len(self.e) // 2

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.b, self.w, self.c]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def shaped(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([x.size for x in self.parts()])[:-1]
        return Network(*[part.reshape(x.shape).astype(np.float32) for part, x in zip(np.split(flat, cuts), self.parts())])

    def _forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(sum(self.e[k][around[:, k]] for k in range(around.shape[1])) + self.b)
        logits = hidden @ self.w + self.c
        logits -= logits.max(1, keepdims=True)
        return hidden, logits

    def log_probability(self, codes: np.ndarray, block: int = 1024) -> np.ndarray:
        """Of each window's token given its neighbours. Windows with the same neighbours are evaluated once where they stand together."""
        out = np.empty(len(codes), np.float64)
        if not len(codes):
            return out
        around_only = codes & ~(W.U(511) << W.U(9 * self.radius))
        starts = np.flatnonzero(np.concatenate([[True], around_only[1:] != around_only[:-1]]))
        ends = np.append(starts[1:], len(codes))
        # No hidden value exceeds 1, so this bounds every logit: where float32 holds the exponentials, no maximum is taken off.
        safe = float((np.abs(self.w).sum(0) + np.abs(self.c)).max()) < 80
        ones, room = np.ones(256, np.float32), np.empty((block, 256), np.float32)
        # A block's logits stay in the processor's cache.
        for lo in range(0, len(starts), block):
            first, last = starts[lo], ends[min(lo + block, len(starts)) - 1]
            around, _ = _unpack(codes[starts[lo : lo + block]], self.radius)
            token = (codes[first:last] >> W.U(9 * self.radius) & W.U(511)).astype(np.int64)
            row = np.repeat(np.arange(len(around)), ends[lo : lo + block] - starts[lo : lo + block])
            hidden = self.e[0].take(around[:, 0], 0)
            for k in range(1, around.shape[1]):
                hidden += self.e[k].take(around[:, k], 0)
            hidden += self.b
            np.tanh(hidden, out=hidden)
            logits = np.matmul(hidden, self.w, out=room[: len(around)])
            logits += self.c
            if not safe:
                logits -= logits.max(1, keepdims=True)
            own = logits[row, token]
            np.exp(logits, out=logits)
            out[first:last] = own - np.log(logits @ ones)[row]
        return out

    def kept_log_probability(self, codes: np.ndarray, kept: Kept) -> np.ndarray:
        """Of windows in any order; those that ``kept`` holds are not evaluated again. Its float32 holds what the network gives."""
        at = kept.places(codes)
        each, new = kept.values[at], np.flatnonzero(kept.codes[at] != codes)
        codes, which = np.unique(_token_last(codes[new], self.radius), return_inverse=True)
        codes = _token_last(codes, self.radius, back=True)
        found, at = self.log_probability(codes).astype(np.float32), kept.places(codes)
        each[new] = found[which]
        kept.codes[at], kept.values[at] = codes, found
        return each

    def step(self, codes: np.ndarray, weight: np.ndarray, state: list[np.ndarray], rate: float) -> None:
        """One AdaGrad step on weighted windows; the weights are taken as they are, so a batch counts by their sum."""
        around, token = _unpack(codes, self.radius)
        hidden, logits = self._forward(around)
        p = np.exp(logits, out=logits)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(token)), token] -= 1
        p *= weight[:, None].astype(np.float32)
        back = (p @ self.w.T) * (1 - hidden * hidden)
        for x, g, s in zip(self.parts()[1:], [back.sum(0), hidden.T @ p, p.sum(0)], state[1:]):
            s += g * g
            x -= rate * g / np.sqrt(s + 1e-10)
        # Of the embeddings only rows that the batch uses have a gradient. 16-bit keys are sorted by radix.
        used = (around + 257 * np.arange(around.shape[1])).T.ravel().astype(np.int16)
        order = np.argsort(used, kind="stable")
        used = used[order]
        first = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
        at, g = np.divmod(used[first].astype(np.int64), 257), np.add.reduceat(back[order % len(back)], first)
        state[0][at] += g * g
        self.e[at] -= rate * g / np.sqrt(state[0][at] + 1e-10)


def _count(batches: Iterator[pa.RecordBatch], radius: int, bits: int = COUNTED_BITS) -> Iterator[pa.RecordBatch]:
    """(code, n) of one task: a row for each window it keeps, and a row for each slice of one that found its place taken."""

    def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(W.signed(codes)), pa.array(n)], names=["code", "n"])

    kept = Kept(np.int64, bits)
    for batch in batches:
        for _, _, data, offsets in W.slices(batch.column("text"), SLICE):
            codes, n = np.unique(windows(data, offsets, radius), return_counts=True)
            out = kept.add(codes, n)
            yield rows(codes[out], n[out])
    for lo in range(0, len(kept.codes), ROWS):
        held = np.flatnonzero(kept.values[lo : lo + ROWS]) + lo
        yield rows(kept.codes[held], kept.values[held])


def count_windows(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(code, n) over all bytes of all texts (column ``text``)."""
    emit = lambda batches: _count(batches, radius)
    return texts.select("text").mapInArrow(emit, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(counted: DataFrame, network: Network, rounds: int = ROUNDS, workers: int | None = None, batch: int = BATCH, rate: float = RATE) -> Network:
    """Rounds of local passes and averaging, weighted by each worker's tokens; without windows the network stays as it is.

    Steps are weighted by the true counts. A worker sees its windows in the order of a hash, so every batch is a mixture, and holds one Arrow batch at a time.
    """
    counted = cut_lineage(counted, "counts")
    size = counted.agg(F.count("*").alias("windows"), F.sum("n").alias("n")).first()
    workers = workers or min(MOST_WORKERS, max(1, -(-size["windows"] // WINDOWS_PER_WORKER)))
    # A window weighs its count, measured by the mean count of the corpus: the same in every batch and worker.
    unit = batch * size["n"] / size["windows"] if size["windows"] else 1.0
    mixed = F.xxhash64(F.lit(1), "code")
    shards = cut_lineage(counted.repartition(workers, "code").sortWithinPartitions(mixed), "windows")
    for turn in range(rounds):
        start = network

        def fit(frames: Iterator[pd.DataFrame], start=start, turn=turn) -> Iterator[pd.DataFrame]:
            own = start.shaped(start.flat().copy())
            state, total, first = [np.zeros_like(x) for x in own.parts()], 0.0, None
            rng = np.random.default_rng(turn)
            for frame in frames:
                codes, n = frame["code"].to_numpy(np.int64), frame["n"].to_numpy(np.float64)
                order = rng.permutation(len(codes))
                for lo in range(0, len(order), batch):
                    at = order[lo : lo + batch]
                    own.step(codes[at].view(W.U), n[at] / unit, state, rate)
                if len(codes):
                    first, total = int(codes[0]) if first is None else first, total + float(n.sum())
            if first is not None:
                yield pd.DataFrame({"first": [first], "n": [total], "weights": [own.flat().astype(np.float32).tobytes()]})

        rows = shards.mapInPandas(fit, "first long, n double, weights binary").collect()
        if not rows:
            return network
        rows.sort(key=lambda r: r["first"])
        total = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["n"] for r in rows)
        network = network.shaped(total / sum(r["n"] for r in rows))
    return network


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens`` (bytes), ``log_likelihood`` (sum over all tokens), ``mean_log_likelihood``.

    A null or empty text has no tokens, the sum 0 and a null mean. Ids pass as they are, null or repeated; other columns are not read.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(np.float32, SCORED_BITS)
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text"), SLICE):
                each = network.kept_log_probability(windows(data, offsets, network.radius), kept)
                sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets]))], names=["id", "n_tokens", "log_likelihood"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, "id long, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains the network on all texts and scores every one of them."""
    return score(docs, train(count_windows(docs.select(F.col(text_col).alias("text"))), Network.fresh()), id_col, text_col)
