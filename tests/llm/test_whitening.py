"""Whitening against NumPy on whole tables, exact integer statistics, and the divide and conquer by itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm.registered import QUERIES
from trendloom.llm.spectral import eigenvectors, polar_factor
from trendloom.llm.whitening import fit_whitening, whiten

DRAW = np.random.default_rng(3)
TURN, _ = np.linalg.qr(DRAW.normal(size=(24, 24)))
MATRICES = {
    "one": np.array([[2.0]]), "identity": np.eye(9), "zero": np.zeros((4, 4)), "repeated": np.diag([5.0, 2, 2, 1, 1, 1]), "flip": np.array([[0.0, 1], [1, 0]]),
    "graded": TURN @ np.diag(10.0 ** -np.arange(24)) @ TURN.T, "two_values": TURN @ np.diag([3.0] * 10 + [1.0] * 14) @ TURN.T, "ones": np.ones((11, 11)),
    "close": TURN @ np.diag(1 + 1e-11 * np.arange(24)) @ TURN.T, "low_rank": TURN[:, :4] @ TURN[:, :4].T, "random": (lambda x: x.T @ x)(DRAW.normal(size=(90, 30))),
    "signs": TURN @ np.diag(np.linspace(-1, 1, 24)) @ TURN.T,
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenvectors(name):
    a = MATRICES[name]
    values, vectors = eigenvectors(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * size


def test_polar_factor_is_the_sign():
    values, vectors = np.linalg.eigh(MATRICES["signs"])
    assert np.abs(polar_factor(MATRICES["signs"]) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def brute(vectors):
    """(n, deviations, eigenvalues, eigenvectors, centred rows, trace), with whole numbers of any size."""
    x = [[math.floor(64 * c) + 1_000_000 for c in map(float, v)] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array([[o / n for o in r] for r in off])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum(o * o for o in r) for r in off], values[::-1], basis[:, ::-1], centred


def check(vectors, rows, model):
    n, deviations, values, basis, centred = brute(vectors)
    k = len(model.values)
    assert model.n == n and sorted(r["deviation"] for r in rows) == sorted(deviations)
    assert np.abs(model.values - values[:k]).max() <= 1e-12 * values[0]
    assert np.abs(np.array(model.explained) - values[:k] / values.sum()).max() < 1e-12 and model.identity_error < 1e-9
    got = np.array([r["whitened"] for r in rows])
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9 and np.abs(got.mean(axis=0)).max() < 1e-9
    for i in range(k):
        if min(np.abs(np.delete(values, i) - values[i])) > 1e-6 * values[0]:
            expected = centred @ basis[:, i] / math.sqrt(values[i])
            assert np.abs(expected * np.sign(expected @ got[:, i]) - got[:, i]).max() < 1e-7


def table_of(spark, vectors, kind="double"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("vectors", [
    DRAW.normal(size=(200, 7)) * [1, 2, 3, 4, 5, 6, 7], DRAW.normal(size=(60, 3)) + 10_000, [[1.5, -2.25], [0.3, 7.9], [4.0, 4.0]], DRAW.normal(size=(30, 5)) * 1e5,
    np.repeat(DRAW.normal(size=(20, 4)), 5, axis=0),
])
def test_against_numpy(spark, vectors):
    table = table_of(spark, vectors)
    model = fit_whitening(table)
    rows = whiten(table, model).orderBy("vec_id").collect()
    check(vectors, rows, model)


def test_numbers_beyond_exact_products(spark):
    vectors = (DRAW.normal(size=(40, 3)) * 1e9).tolist()
    table = table_of(spark, vectors)
    model = fit_whitening(table)
    _, deviations, values, _, _ = brute(vectors)
    assert np.abs(model.values / values - 1).max() < 1e-9 and model.identity_error < 1e-6
    assert [r["deviation"] for r in whiten(table, model).orderBy("vec_id").collect()] == [d if d < 2**63 else None for d in deviations]


def test_bad_rows_leave_and_the_rest_is_as_without_them(spark):
    good = DRAW.normal(size=(50, 4)).tolist()
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [1e300] * 4), (None, good[0])]
    schema = "vec_id long, embedding array<double>"
    clean = spark.createDataFrame([*enumerate(good), (None, good[0])], schema)
    mixed = spark.createDataFrame([*enumerate(good), *bad], schema).withColumn("deviation", F.lit("old")).withColumn("__other", F.lit(1))
    model, same = fit_whitening(mixed), fit_whitening(clean)
    assert model.n == same.n == 51 and (model.values == same.values).all() and (model.basis == same.basis).all()
    out = whiten(mixed, model)
    assert out.columns == ["vec_id", "embedding", "__other", "deviation", "whitened"] and out.count() == 51


@pytest.mark.parametrize("vectors, kept", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 5.0], [2.0, 5.0]], 1), (np.eye(3).tolist(), 2)])
def test_tables_without_spread(spark, vectors, kept):
    table = table_of(spark, vectors) if vectors else spark.createDataFrame([], "vec_id long, embedding array<double>")
    model = fit_whitening(table)
    rows = whiten(table, model).collect()
    assert len(model.values) == kept and len(rows) == len(vectors) and all(len(r["whitened"]) == kept for r in rows)


def test_query_over_all_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, basis, centred = brute([r["embedding"] for r in table])
    rows = QUERIES["op13_embedding_whitening"](spark, sf_dir).orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * n and {r["n"] for r in rows} == {n}
    assert [r["deviation"] for r in rows[::32]] == deviations and [r["component"] for r in rows[:32]] == list(range(1, 33))
    got = np.array([r["whitened"] for r in rows]).reshape(n, 32)
    expected = centred @ (basis[:, :32] / np.sqrt(values[:32]))
    assert np.abs(expected * np.sign((expected * got).sum(axis=0)) - got).max() < 1e-9
    assert np.abs(np.array([r["explained"] for r in rows[:32]]) - values[:32] / values.sum()).max() < 1e-12
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-9 and abs(error - np.abs(got.T @ got / n - np.eye(32)).max()) < 1e-9
