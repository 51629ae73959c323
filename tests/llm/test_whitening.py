import random

import numpy as np
import pytest

from gridloom.llm import whitening as wh
from gridloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def straight(vectors):
    """Integer vectors, exact means and the covariance's pairs by the plain definition."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array(((n * fit - sums) / n).tolist(), dtype=float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], axes[:, ::-1]


def check(got, rows, top):
    """``got`` rows of whiten() against the plain definition; columns may change sign, equal ones may turn."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x, n, sums, values, axes = straight([v for _, v in usable])
    top = min(top, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == len(usable) * top and {r["n"] for r in got} == {n}
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got if r["component"] == 1) == sorted(
        (str(i), int(d)) for (i, _), d in zip(usable, deviation)
    )
    assert max(r["identity_error"] for r in got) < 1e-9 and max(r["residual"] for r in got) < 1e-13
    mean = np.array([s / n for s in sums], float)
    for k in range(top):
        mine = sorted((str(r["vec_id"]), r["whitened"]) for r in got if r["component"] == k + 1)
        want = (np.array(x, float) - mean) @ axes[:, k] / np.sqrt(values[k])
        want = sorted((str(i), w) for (i, _), w in zip(usable, want))
        flipped = sorted((i, -w) for i, w in want)
        near = [max(abs(a[1] - b[1]) for a, b in zip(mine, w)) for w in (want, flipped)]
        assert min(near) < 1e-7
        assert abs(next(r["explained"] for r in got if r["component"] == k + 1) / (values[k] / values.sum()) - 1) < 1e-9


@pytest.mark.parametrize("dims", [1, 2, 9, 40])
def test_against_the_plain_definition(spark, dims):
    draw = random.Random(dims)
    rows = [(i, [draw.gauss(0, 1 + 5 / (1 + j)) for j in range(dims)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a hot vector counts once in the fit
    rows += [(3000, None), (3001, [None] + [0.0] * (dims - 1)), (3002, [float("nan")] * dims), (3003, [float("inf")] * dims), (3004, [])]
    rows += [(5, rows[5][1]), (None, rows[6][1])]  # a repeated row and a null id
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(6)
    check(wh.whiten(frame).collect(), [r for r in rows if r[1] != []], 16)


def test_huge_values_and_clashing_columns(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) * 10.0 ** draw.randrange(0, 9) for _ in range(5)]) for i in range(50)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "'x' as x", "1 as dims", "'y' as id", "2 as n")
    check(wh.whiten(frame).collect(), rows, 16)
    beyond = spark.createDataFrame([(1, [1e300, 2.0], 0), (2, [-1e300, 1.0], 0), (3, [5.0, 3.0], 0)], SCHEMA)
    got = wh.whiten(beyond).collect()
    assert {r["component"] for r in got} <= {1, 2} and all(np.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(9)], [(1, [], 0)]])
def test_tables_without_variance_have_no_component(spark, rows):
    assert wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_fewer_vectors_than_components_and_other_lengths(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(30)]) for i in range(6)]
    odd = [(100, [1.0, 2.0], 0), (101, [3.0, 4.0], 0)]
    got = wh.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows] + odd, SCHEMA)).collect()
    check(got, rows, 16)
    assert max(r["component"] for r in got) == 5


@pytest.mark.parametrize("shape", ["flat", "steep", "equal", "few"])
@pytest.mark.parametrize("dims", [20, 64, 300])
def test_pairs_by_products_alone(shape, dims):
    draw = np.random.default_rng(dims)
    data = draw.standard_normal((2000, dims))
    data *= {"flat": np.ones(dims), "steep": np.logspace(0, -3, dims), "equal": np.where(np.arange(dims) < 19, 3, 1),
             "few": np.where(np.arange(dims) < 4, 1, 0)}[shape]
    matrix = data.T @ data / len(data)
    values, vectors, residuals = wh.leading_pairs(lambda block: matrix @ block, dims, 16)
    want = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert np.abs(values - want).max() < 1e-13 * want[0] and residuals.max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


@pytest.mark.parametrize("reach", [10, 10**6, 10**9, 10**12, 2**52])
@pytest.mark.parametrize("n", [1, 50_000, 10**8])
def test_deviations_are_exact(reach, n):
    draw = random.Random(reach)
    x = [[draw.randrange(-reach, reach + 1) for _ in range(70)] for _ in range(5)]
    sums = [draw.randrange(-reach, reach + 1) * n for _ in range(70)]
    want = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert wh.deviations(np.array(x), n, sums) == want
    assert wh.deviations(np.zeros((0, 70), np.int64), n, sums) == []


def test_minres_solves_indefinite_systems():
    draw = np.random.default_rng(0)
    turn, _ = np.linalg.qr(draw.standard_normal((30, 30)))
    matrix = turn * np.r_[np.linspace(-3, -1, 10), np.linspace(1, 4, 20)] @ turn.T
    right = draw.standard_normal((30, 3))
    right[:, 1] = 0
    assert np.abs(matrix @ wh.minres(lambda b: matrix @ b, right, 60, 1e-13) - right).max() < 1e-10


def test_sums_on_executors_beyond_some_tasks(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    monkeypatch.setattr(wh, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(wh, "BLOCK_BYTES", 500)
    check(wh.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect(), rows, 16)


def test_query_against_the_plain_definition(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, sf).collect(), rows, 16)
