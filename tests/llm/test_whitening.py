"""Whitening against exact arithmetic and a plain eigendecomposition."""

import math

import numpy as np
import pytest

from ratewise.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, at string, entry string, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d", "e") for i, v in vectors], SCHEMA)


def plain(vectors, most=32):
    """(id, deviation, whitened up to sign) and the eigenvalues, from the definition."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    moved = n * x - s
    away = (moved**2).sum(axis=1)
    rows = moved.astype(float) / n
    values, vectors_ = np.linalg.eigh(rows.T @ rows / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    return [i for i, _ in kept], away, rows @ vectors_[:, :most] / np.sqrt(values[:most]), values


def odd(rng, n, d):
    out = [(i, rng.normal(0, 0.2, d).astype(np.float32).tolist()) for i in range(n)]
    out += [(None, out[0][1]), (3, out[1][1]), (3, out[1][1])]
    return out + [(990, None), (991, []), (992, [None] * d), (993, [float("nan")] * d), (994, [float("inf")] * d), (995, [3e38] * d), (996, [0.5] * (d - 1))]


def listed(df):
    return {(tuple([r["vec_id"]]), tuple(r["x"])): r for r in df.collect()}


@pytest.mark.parametrize("n,d", [(200, 8), (60, 40)])
def test_whitening_equals_the_plain_decomposition(spark, n, d):
    vectors = odd(np.random.default_rng(n), n, d)
    df, found = whitening.whiten(frame(spark, vectors).repartition(5), most=32)
    got = df.collect()
    ids, away, values, eigen = plain([v for v in vectors if v[0] not in (995, 996)])
    assert sorted(r["vec_id"] or -1 for r in got) == sorted(i or -1 for i in ids)
    assert sorted(int(r["deviation"]) for r in got) == sorted(int(a) for a in away)
    assert np.allclose(found.eigenvalues, eigen, rtol=1e-9)
    by = {(i, int(a)): v for i, a, v in zip(ids, away, values)}
    mine = np.array([r["whitened"] for r in got])
    want = np.array([by[(r["vec_id"], int(r["deviation"]))] for r in got])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.allclose(mine * signs, want, atol=1e-7)
    assert whitening.identity_error(df, found) < 1e-9


def test_badly_conditioned_and_deficient_tables(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (300, 4))
    wide = np.column_stack([base[:, 0] * 1e6, base[:, 1], base[:, 1] * 3, base[:, 2] * 0 + 2, base[:, 3] * 0.05])
    df, found = whitening.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(wide.astype(np.float32))]), most=5)
    x = np.array([[math.floor(64 * float(c)) for c in v] for v in wide.astype(np.float32)], float)
    eigen = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert found.rank == 4 and np.allclose(found.eigenvalues[:4], eigen[:4], rtol=1e-6)
    assert all(r["whitened"][4] is None and r["whitened"][3] is not None for r in df.collect())
    assert whitening.identity_error(df, found) < 1e-6


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_empty_and_constant_tables(spark, vectors):
    df, found = whitening.whiten(frame(spark, vectors))
    rows = df.collect()
    if found is None:
        assert rows == []
    else:
        assert found.rank == 0 and all(r["whitened"] == [None, None] and r["deviation"] == 0 for r in rows)
        assert whitening.identity_error(df, found) is None


def test_numbers_beyond_64_bits():
    x = np.array([[1 << 61, 5], [-(1 << 61), 7]])
    moved = whitening.centred(x, 2, np.array([0, 12], object))
    assert moved.tolist() == [[1 << 62, -2], [-(1 << 62), 2]]
    assert [int(v) for v in whitening.squared_length(moved)] == [(1 << 124) + 4] * 2


def test_the_query_has_one_row_per_vector_and_component(spark):
    df = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    data = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    ids, away, values, eigen = plain(data)
    assert len(rows) == len(ids) * min(32, len(eigen)) and {r["n"] for r in rows} == {len(ids)}
    assert {(r["vec_id"], r["deviation"]) for r in rows} == set(zip(ids, (int(a) for a in away)))
    share = {r["component"]: r["explained"] for r in rows}
    assert np.allclose([share[k] for k in sorted(share)], eigen[: len(share)] / eigen.sum(), rtol=1e-6)
    assert rows[0]["identity_error"] < 1e-4
