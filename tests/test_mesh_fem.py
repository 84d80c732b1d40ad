import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import fem, mesh, sparse
from tessella.plans import multigrid


def square(spark, m=9):
    """A grid of m x m vertices on the unit square."""
    v = [(k, (k % m) / (m - 1), (k // m) / (m - 1), 0.0) for k in range(m * m)]
    t = [x for k in range(m * (m - 1)) if k % m < m - 1 for x in ((2 * k, k, k + 1, k + m + 1), (2 * k + 1, k, k + m + 1, k + m))]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(t, "cid long, v0 long, v1 long, v2 long")


def test_euler_and_valence(spark):
    v, t = square(spark)
    e = mesh.neighbors(t).count()
    assert v.count() - e // 2 + t.count() == 1
    assert mesh.boundary_vertices(t).count() == 32
    assert mesh.across_edge(t).count() == e - 2 * 32


def test_operator_invariants(spark):
    v, t = square(spark)
    k = fem.operator_2d(t, v, mass=0.0)
    assert k.groupBy("i").agg(F.sum("v").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-9
    m = fem.operator_2d(t, v, stiffness=0.0)
    assert m.agg(F.sum("v")).first()[0] == pytest.approx(1.0)
    assert sparse.add(k, sparse.transpose(k), 1, -1).agg(F.max(F.abs("v"))).first()[0] < 1e-12


def test_flat_triangle_is_an_error(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2)], "cid long, v0 long, v1 long, v2 long")
    with pytest.raises(Exception, match="triangle without area"):
        fem.operator_2d(t, v).collect()


def test_unknown_material_is_an_error(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    good = spark.createDataFrame([(0, 0, 1, 2, 3, 2)], "cid long, v0 long, v1 long, v2 long, v3 long, mat int")
    a = fem.operator_3d(good, v)
    assert a.agg(F.sum("v")).first()[0] == pytest.approx(1 / 6)
    with pytest.raises(Exception, match="unknown material"):
        fem.operator_3d(good.withColumn("mat", F.lit(9)), v).collect()


def system(spark, m):
    v, t = square(spark, m)
    return fem.operator_2d(t, v).cache(), v.select(F.col("vid").alias("i"), (F.col("x") + 1).alias("v"))


def values(x):
    return {r.i: r.v for r in x.collect()}


@pytest.mark.parametrize(("solver", "cycle", "aggregator"), [("amg", "F", "mis"), ("pcg", "W", "partition"), ("pcg", "K", "conditioned")])
def test_solvers_agree_with_numpy(spark, solver, cycle, aggregator):
    a, b = system(spark, 7)
    opts = multigrid.SolverOptions(solver=solver, cycle=cycle, aggregator=aggregator, top_size=4, least=1, depth=1, most=24, tolerance=1e-4, max_iters=60)
    found = multigrid.solution(a, b, opts)
    assert found.converged and 1 < found.iterations < 60
    m, ids = multigrid.dense(a)
    right = values(b)
    want = np.linalg.solve(m, [right[int(i)] for i in ids])
    got = values(found.x)
    assert max(abs(got[int(i)] - w) for i, w in zip(ids, want, strict=True)) < 2e-2
    if cycle == "W":
        direct = values(multigrid.direct(a, b))
        assert max(abs(direct[int(i)] - w) for i, w in zip(ids, want, strict=True)) < 1e-9
        near = multigrid.solution(a, b, opts, found.x)
        assert near.iterations == 0 and near.converged


def test_a_solve_that_does_not_converge_is_an_error(spark):
    a, b = system(spark, 7)
    opts = multigrid.SolverOptions(top_size=8, least=1, depth=1, most=12, tolerance=1e-13, max_iters=1)
    with pytest.raises(multigrid.NotConvergedError) as e:
        multigrid.solve(a, b, opts)
    assert e.value.solution.iterations == 1 and e.value.solution.residual > 0 and e.value.solution.x.count() == 49
    for wrong in ({"aggregator": "?"}, {"solver": "?"}, {"cycle": "?"}):
        with pytest.raises(ValueError, match="unknown"):
            multigrid.solve(a, b, multigrid.SolverOptions(top_size=8, **wrong))
    with pytest.raises(ValueError, match="too many"):
        multigrid.direct(a, b, most=40)


def test_a_cycle_and_its_levels(spark):
    a, b = system(spark, 7)
    grid = multigrid.Multigrid(a, multigrid.SolverOptions(top_size=8, depth=1, most=12))
    assert len(grid.levels) >= 2 and grid.levels[0].a.groupBy("block").agg(F.count_distinct("i").alias("n")).agg(F.max("n")).first()[0] <= 12
    left = sparse.residual(b, a, grid.cycle(b))
    assert sparse.norms(left).first()["norm2"] < 0.5 * sparse.norms(b).first()["norm2"]
    stats = grid.stats().collect()
    grids, entries = grid.complexity().first()
    assert [r.n_rows for r in stats] == [level.n for level in grid.levels]
    assert grids == pytest.approx(sum(r.n_rows for r in stats) / 49) and entries == pytest.approx(sum(r.nnz for r in stats) / stats[0].nnz)


def test_sweeps_inside_blocks_are_those_of_block_jacobi(spark):
    a, b = system(spark, 5)
    blocks = b.select(F.col("i").alias("vid"), (F.col("i") % 5).alias("block_id"))
    sides = sparse.block_split(a, blocks, symmetric=False).select("i", "j", "v", "block", (F.col("side") != "outside").alias("inside"))
    got, want = values(multigrid.in_block_sweeps(sides, b, 0.67, 4)), values(sparse.block_jacobi(a, b, blocks, 0.67, 4))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_empty_matrix_is_an_error(spark):
    with pytest.raises(ValueError):
        multigrid.solve(spark.createDataFrame([], "i long, j long, v double"), spark.createDataFrame([], "i long, v double"))


def test_rescale_of_a_flat_axis_and_index_shift(spark):
    v, t = square(spark, 3)
    assert mesh.rescale(v, 2.0).where("z is null and x <= 2").count() == 9
    moved = mesh.shift_indexes(t.select("cid", *[(F.col(c) + 1).alias(c) for c in ("v0", "v1", "v2")]), 9)
    assert sorted(moved.collect()) == sorted(t.collect())


def test_load_3d_is_volume_times_force(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 1.0, 1.0, 1.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 1, 2, 3, 4)], "cid long, v0 long, v1 long, v2 long, v3 long")
    got = values(fem.load_3d(t, v, F.lit(6.0)))
    assert sum(got.values()) == pytest.approx(6 * (1 / 6 + 1 / 3)) and got[0] == pytest.approx(0.25)
    assert values(fem.load_3d(t, v, F.col("z")))[0] == pytest.approx(0.25 / 24)


def test_colours_and_unit_vectors(spark):
    from tessella.functions import vectors as V

    row = spark.range(1).select(*[c.alias(n) for c, n in zip(V.colour("cyan"), "rgb", strict=True)]).first()
    assert tuple(row) == (0.0, 1.0, 1.0) and len(V.COLOURS) == 8
    unit = spark.range(1).select(*[c.alias(n) for c, n in zip(V.normalize((F.lit(3.0), F.lit(0.0), F.lit(4.0))), "xyz", strict=True)]).first()
    assert tuple(unit) == pytest.approx((0.6, 0.0, 0.8))
