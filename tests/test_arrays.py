"""The solver on arrays of the driver: it does what the one on tables does, with few jobs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import queries
from tessella.operators import aggregation, mesh
from tessella.plans import arrays, multigrid
from tests.conftest import DATA
from tests.test_mesh_fem import square


def grid(m):
    """A positive definite matrix on a grid of m x m with couplings along its sides and one diagonal."""
    place = np.arange(m * m).reshape(m, m)
    one = [(place[:, :-1], place[:, 1:]), (place[:-1], place[1:]), (place[:-1, :-1], place[1:, 1:])]
    a, b = (np.concatenate([x[k].ravel() for x in one]) for k in (0, 1))
    every = np.arange(m * m)
    i, j = np.concatenate((a, b, every)), np.concatenate((b, a, every))
    return arrays.summed(i, j, np.where(i == j, 6.01, -1.0), (m * m, m * m))


@pytest.mark.parametrize("name", ["pcg_solve", "amg_solve"])
def test_a_solve_starts_few_jobs(spark, name):
    """On tables each step of a cycle has jobs of its own."""
    sf, tracker = f"{DATA}/sf0.001", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = {r.i: r.x for r in queries.QUERIES[name](spark, sf).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(tracker.getJobIdsForGroup(name))
    want = {r.p_partkey: float(r.p_size) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect()}
    assert len(got) > 128 and all(want[k] == x for k, x in got.items()) and jobs < 60, jobs


def test_parts_and_blocks_are_those_of_the_tables(spark):
    v, t = square(spark, 12)
    edges = mesh.neighbors(t).cache()
    rows = sorted((r.src, r.dst) for r in edges.collect())
    src, dst = (np.array([r[k] for r in rows]) for k in (0, 1))
    p = np.array([r.p for r in v.orderBy("vid").select(F.xxhash64("vid", F.lit(0)).alias("p")).collect()])
    want = {r.vid: r for r in aggregation.two_levels(edges, v.select("vid"), 1, 1, 4, 512).collect()}
    parts = arrays.aggregate(src, dst, p, 1, 4)
    blocks = arrays.blocks_of(*arrays.contracted(src, dst, parts), np.bincount(parts), p[: parts.max() + 1], 1, 512)
    assert parts.tolist() == [want[k].agg_id for k in range(144)]
    names = {(want[k].block_id, int(blocks[parts[k]])) for k in range(144)}  # their numbers may differ
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names}) > 1
    small = arrays.blocks_of(*arrays.contracted(src, dst, parts), np.bincount(parts), p[: parts.max() + 1], 1, 20)
    assert np.bincount(small[parts]).max() <= 20 and len(set(small)) == small.max() + 1


@pytest.mark.parametrize("cycle", ["V", "W", "F", "K"])
@pytest.mark.parametrize("solver", ["pcg", "amg"])
def test_cycles_of_arrays(cycle, solver):
    a, r = grid(40), np.random.default_rng(3)
    p, x = r.integers(-(2**62), 2**62, 1600), r.random(1600)
    opts = multigrid.SolverOptions(cycle=cycle, solver=solver, top_size=16, tolerance=1e-9)
    b = a @ x
    solve = arrays.Multigrid(a, opts, p, p)
    got, norm, done = solve.descend(b, 0, np.zeros(1600), 100, 1e-9 * np.linalg.norm(b))
    assert len(solve.levels) > 2 and 1 < done < 60 and norm <= 1e-9 * np.linalg.norm(b) and abs(got - x).max() < 1e-6


def test_products_in_steps():
    a = grid(12)
    want = arrays.dense(a) @ arrays.dense(a)
    for step in (1, 50, 1 << 21):
        got = arrays.product(a, a, step)
        assert np.allclose(arrays.dense(got), want) and len(set(zip(got.i, got.j, strict=True))) == len(got.i)


@pytest.mark.parametrize(("n", "m", "k"), [(5, 7, 0), (5, 7, 3), (1, 4, 3), (300, 200, 9000), (40000, 300, 300000)])
def test_products_of_packed_rows(n, m, k):
    """Rows without entries and a row of more entries than a piece are among them."""
    r = np.random.default_rng(7)
    i, j, v = r.integers(0, n, k), r.integers(0, m, k), r.random(k)
    i[: k // 3] = n // 2
    want = np.zeros((n, m))
    np.add.at(want, (i, j), v)
    a, x, y = arrays.summed(i, j, v, (n, m)), r.random(m), r.random(n)
    assert np.allclose(arrays.dense(a), want) and np.allclose(a @ x, want @ x)
    assert np.allclose(arrays.packed(a.t) @ y, y @ want) and np.allclose(arrays.packed(a) @ x, want @ x)


def test_sweeps_from_zero_take_no_product_first():
    class Counted:
        taken = 0

        def __matmul__(self, x):
            self.taken += 1
            return inside @ x

    a, p = grid(20), np.random.default_rng(3).integers(-(2**62), 2**62, 400)
    solve = arrays.Multigrid(a, multigrid.SolverOptions(top_size=16), p, p)
    right = np.random.default_rng(4).random(400)
    want = solve.sweeps(0, right, 5)
    inside, solve.levels[0].inside = solve.levels[0].inside, (counted := Counted())
    assert np.allclose(solve.sweeps(0, right, 5), want) and counted.taken == 4
    x = np.zeros(400)
    for _ in range(5):
        x += 0.67 * (right - inside @ x) / 6.01
    assert np.allclose(x, want) and not solve.sweeps(0, right, 0).any()


def test_a_matrix_by_blocks_is_not_held_twice():
    a, block, x = grid(60), np.arange(3600) // 50, np.random.default_rng(5).random(3600)
    want, inside = a @ x, np.where(block[a.i] == block[a.j], a.v, 0.0)
    inside = np.bincount(a.i, inside * x[a.j], 3600)
    got = arrays.split(a, block)
    assert np.allclose(got @ x, want) and np.allclose(got.inside @ x, inside) and not np.allclose(want, inside)
    assert got.inside.v is got.outside.v is a.v


def test_the_coarse_matrix_in_steps():
    a, parts = grid(30), np.arange(900) // 9
    p = arrays.prolongator(a, arrays.diagonal(a), parts, 100, 0.67)
    t = (parts[:, None] == np.arange(100)).astype(float)
    assert np.allclose(arrays.dense(p), t - 0.67 * arrays.dense(a) @ t / 6.01)
    for step in (1, 500, 1 << 19):
        assert np.allclose(arrays.dense(arrays.galerkin(a, p, step)), arrays.dense(p).T @ arrays.dense(a) @ arrays.dense(p))


def test_the_setup_takes_bounded_memory():
    """For each entry, the matrix included; it was 300 bytes."""
    a, p = grid(300), np.random.default_rng(3).integers(-(2**62), 2**62, 90000)
    entries = len(a.v)
    tracemalloc.start()
    arrays.Multigrid(a, multigrid.SolverOptions(), p, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + 16 * entries < 120 * entries, peak / entries


def test_entries_without_a_diagonal_stay_with_the_tables(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 5, 1.0)], "i long, j long, v double")
    b = spark.createDataFrame([(1, 4.0)], "i long, v double")
    assert multigrid._gathered(a, b, multigrid.SolverOptions(), None, 1e-9) is None
    assert multigrid._gathered(a.where("i = j").union(a.where("i = j")), b, multigrid.SolverOptions(), None, 1e-9) is None
    found = multigrid._gathered(a.where("i = j"), b, multigrid.SolverOptions(), None, 1e-9)
    assert found.converged and [(r.i, r.v) for r in found.x.collect()] == [(1, 2.0)]


def test_a_large_matrix_comes_in_batches(spark, monkeypatch):
    """The same solution as at once, with missing, doubled and foreign places found in both ways."""
    rows = [(10 * int(i), 10 * int(j), float(v)) for i, j, v in zip(*(getattr(grid(30), c) for c in "ijv"), strict=True)]
    a = spark.createDataFrame([*rows, rows[3], rows[3]], "i long, j long, v double").repartition(3)
    b = spark.createDataFrame([(10 * k, 1.0 + k % 5) for k in range(900)], "i long, v double")
    opts = multigrid.SolverOptions(top_size=16)
    at_once = multigrid._gathered(a, b, opts, None, 1e-9)
    monkeypatch.setattr(multigrid, "AT_ONCE", 100)
    batches = multigrid._gathered(a, b, opts, None, 1e-9)
    one, other = ({r.i: r.v for r in x.x.collect()} for x in (at_once, batches))
    assert at_once.converged and batches.converged and len(one) == 900 and one.keys() == other.keys()
    assert max(abs(one[k] - other[k]) for k in one) < 1e-9
    for extra in ((10, 15, 1.0), (None, 10, 1.0), (10, None, 1.0), (10, 10, 1.0)):
        more = a.union(spark.createDataFrame([extra], "i long, j long, v double"))
        assert multigrid._gathered(more, b, opts, None, 1e-9) is None


def test_long_vectors_stay_batches(spark):
    name, x = "spark.sql.execution.arrow.localRelationThreshold", np.arange(300_000)
    before = spark.conf.get(name)
    got = multigrid._vector(spark, x, x / 2)
    assert "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString() and spark.conf.get(name) == before
    assert got.count() == 300_000 and got.where("v <> i / 2").count() == 0
    assert multigrid._vector(spark, x[:5], x[:5] / 2).collect() == [(k, k / 2) for k in range(5)]
