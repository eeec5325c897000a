"""Whitening of an embedding table by shifted Cholesky QR.

1. Entries become whole numbers (``units`` steps per 1.0); counts and sums per dimension are exact.
2. ``PASSES`` Gram passes over the centred rows: every task carries its rows through the triangular factors found so far, by forward
   substitution, and adds up one Gram matrix; Spark sums the matrices entry by entry, and the driver factors the
   result (as many numbers as the squared dimension, whatever the number of rows). The first factor is shifted, so
   that badly conditioned tables do not break it; the later passes repair what the shift costs.
3. The composed factor R has the centred table's singular values: its SVD names the components, and a row's whitened
   values come from its orthogonalised row, never from a covariance matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.session import cut_lineage

PASSES = 3
UNITS = 64
OFFSET = 1_000_000
LARGEST = float(1 << 62)  # whole numbers beyond do not fit a long
EPS = float(np.finfo(np.float64).eps)
SLICE_VALUES = 1 << 20


# Rows -------------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, units: int = UNITS, offset: int = OFFSET) -> DataFrame:
    """(id, x): vectors as whole numbers; rows whose vector is null or empty, or holds a null, non-finite or unstorable entry, go."""
    entry = F.floor(F.col("v").cast("double") * units)
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.size("vec") > 0)
    usable = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * units < LARGEST))
    return vectors.filter(usable).select("id", F.transform("vec", lambda v: F.floor(v * units).cast("long") + offset).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, matrix) of slices of a list column whose lists are equally long."""
    lists = column.cast(pa.large_list(column.type.value_type))
    n = len(lists)
    if not n:
        return
    ends = lists.offsets.to_numpy()
    width = int(ends[1] - ends[0])
    flat = lists.values.to_numpy(zero_copy_only=False)
    step = max(1, SLICE_VALUES // width)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        yield lo, hi, flat[ends[lo] : ends[hi]].reshape(hi - lo, width)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times the distance from the mean, as exact whole numbers (Python integers where 64 bits are too few)."""
    if n * max(float(np.abs(x).max(initial=0)), 1.0) + float(max(map(abs, sums.tolist()), default=0)) < 2.0**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squared_length(moved: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of each row."""
    top = float(np.abs(moved.astype(np.float64)).max(initial=0))
    if moved.dtype != object and top * top * moved.shape[1] < 2.0**62:
        return [Decimal(int(v)) for v in (moved * moved).sum(axis=1)]
    wide = moved.astype(object)
    return [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]


def forward(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper) by substitution, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


# Gram passes ------------------------------------------------------------------------------------


def gram(rows: DataFrame, column: str, size: int, turn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the outer product of ``turn``-ed rows: one matrix a task, summed by Spark entry by entry."""
    upper = np.triu_indices(size)
    keys = np.arange(len(upper[0]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((size, size)), False
        for batch in batches:
            for _, _, x in matrices(batch.column("x")):
                y = turn(x)
                total += y.T @ y
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[upper])], names=["entry", "value"])

    found = rows.select(F.col(column).alias("x")).mapInArrow(emit, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((size, size))
    out[upper[0][found["entry"]], upper[1][found["entry"]]] = found["value"]
    return np.triu(out) + np.triu(out, 1).T


def shift(matrix: np.ndarray, n: int) -> float:
    """What is added to the diagonal so that rounding cannot make the matrix indefinite."""
    d = len(matrix)
    return 11 * (n * d + d * (d + 1)) * EPS / 2 * max(float(np.trace(matrix)), np.finfo(np.float64).tiny)


def factor(matrix: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted in the first pass, and later only as far as a deficient rank asks for."""
    size = len(matrix)
    extra = shift(matrix, n) if first else 0.0
    least = size * EPS * float(np.trace(matrix))
    while True:
        try:
            return np.linalg.cholesky(matrix + extra * np.eye(size)).T
        except np.linalg.LinAlgError:
            extra = max(least, 4 * extra)


@dataclass(frozen=True)
class Whitening:
    """What a row needs to be whitened: exact sums, triangular factors, and the SVD of their product."""

    n: int
    sums: np.ndarray
    factors: tuple[np.ndarray, ...]
    left: np.ndarray  # left singular vectors of R
    singular: np.ndarray
    components: np.ndarray  # one component per row
    rank: int

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.singular**2 / self.n

    @property
    def explained(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else np.full(len(self.singular), np.nan)

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        return orthogonal(x, self.n, self.sums, self.factors)

    def whiten(self, x: np.ndarray, most: int) -> np.ndarray:
        """Values on the first components, NaN on those without variance."""
        out = np.sqrt(self.n) * (self.orthogonal(x) @ self.left[:, :most])
        out[:, self.rank :] = np.nan
        return out


def orthogonal(x: np.ndarray, n: int, sums: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Centred rows carried through the factors one after the other."""
    rows = centred(x, n, sums).astype(np.float64) / n
    for r in factors:
        rows = forward(rows, r)
    return rows


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of a written table of equally long whole vectors (``x``); ``None`` for an empty one."""
    totals = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    if not totals:
        return None
    n, size, sums = int(totals[0]["n"]), len(totals), np.array([int(r["s"]) for r in totals], object)
    factors: tuple[np.ndarray, ...] = ()
    whole = np.eye(size)
    for k in range(PASSES):
        done = factors
        products = gram(vectors, "x", size, lambda x: orthogonal(x, n, sums, done))
        if not np.trace(products) > 0:  # all rows are equal
            return Whitening(n, sums, (), np.eye(size), np.zeros(size), np.eye(size), 0)
        r = factor(products, n, first=k == 0)
        factors, whole = (*factors, r), r @ whole
    left, singular, components = np.linalg.svd(whole)
    rank = int((singular > 16 * size * EPS * max(singular[0], np.finfo(np.float64).tiny)).sum())
    return Whitening(n, sums, factors, left, np.where(np.arange(size) < rank, singular, 0.0), components, rank)


def whiten(rows: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", units: int = UNITS, offset: int = OFFSET) -> tuple[DataFrame, Whitening | None]:
    """One row per usable vector: id, ``x``, ``deviation`` (exact, decimal) and ``whitened`` (array of at most ``most`` values), and the fit.

    Rows whose vector is null, empty, or holds a null or non-finite entry (or one whose whole number does not fit a long) are left
    out. Vectors must have one length: of several lengths the most common stays, the longer on ties, since rows of another
    length have no place among the coordinates. Ids are passed on as they are, null or repeated; equal rows all count. On
    components without variance the value is null; an empty table gives an empty one. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = cut_lineage(whole_vectors(rows, id_col, vec_col, units, offset), "vectors")
    length = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, x array<long>, deviation decimal(38,0), whitened array<double>"
    if length is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), None
    vectors = vectors.filter(F.size("x") == length["d"])
    found = fit(vectors)
    kept = min(most, len(found.singular))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in matrices(batch.column("x")):
                values = found.whiten(x, kept)
                flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * kept), flat)
                far = pa.array(squared_length(centred(x, found.n, found.sums)), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("x").slice(lo, hi - lo), far, lists], names=["id", "x", "deviation", "whitened"])

    out = cut_lineage(vectors.mapInArrow(emit, schema), "whitened")
    return out.withColumnRenamed("id", id_col), found


def identity_error(whitened: DataFrame, found: Whitening, column: str = "whitened") -> float | None:
    """Largest absolute entry of the covariance of the whitened values minus the identity; components without variance do not count."""
    size = min(found.rank, len(whitened.select(F.col(column)).first()[0]))
    if not size:
        return None
    means = whitened.select(*[F.avg(F.col(column)[k]).alias(f"m{k}") for k in range(size)]).first()
    middle = np.array(list(means), np.float64)
    covariance = gram(whitened.select(F.slice(column, 1, size).alias(column)), column, size, lambda w: w.astype(np.float64) - middle) / found.n
    return float(np.abs(covariance - np.eye(size)).max())
