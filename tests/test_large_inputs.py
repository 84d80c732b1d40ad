"""What holds at sizes beyond those of the other tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import queries
from tessella.plans import multigrid
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
UNSENT = (
    "diag",
    "fem_load_2d",
    "fem_load_3d",
    "fem_mirrored",
    "galerkin",
    "matrix_permuted",
    "mesh_normals",
    "mesh_radius_edge",
    "mesh_vertex_normals",
    "residual",
    "smoothed_prolongator",
    "tet_across_face",
    "fem_operator_2d",
    "fem_operator_3d",
    "fem_stiffness_2d",
    "tet_radius_edge",
    "tet_volume_by_material",
)


@pytest.mark.parametrize("name", UNSENT)
def test_no_table_of_the_mesh_is_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_direct_solve_beyond_the_dense_limit(spark):
    """A grid of 70 by 70 with couplings to all eight neighbours, a second piece and a row alone, in mixed order."""
    w, r = 70, np.random.default_rng(5)
    place = np.arange(w * w).reshape(w, w)
    pairs = [(place[max(0, -a) : w - max(0, a), max(0, -b) : w - max(0, b)].ravel(), place[max(0, a) : w - max(0, -a), max(0, b) : w - max(0, -b)].ravel()) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    n = w * w + 3
    extra = [(w * w, w * w), (w * w, w * w + 1), (w * w + 1, w * w), (w * w + 1, w * w + 1), (w * w + 2, w * w + 2)]
    ids = r.permutation(n) * 7
    i, j = (np.concatenate([*(p[k] for p in pairs), [e[k] for e in extra]]) for k in (0, 1))
    v, x = np.where(i == j, 12.0, -1.0 - (i < j) / 2), r.random(n)
    b = np.bincount(i, v * x[j], n)
    a = spark.createDataFrame(list(zip(ids[i].tolist(), ids[j].tolist(), v.tolist(), strict=True)), "i long, j long, v double")
    right = spark.createDataFrame(list(zip(ids.tolist(), b.tolist(), strict=True)), "i long, v double")
    got = {r.i: r.v for r in multigrid.direct(a, right).collect()}
    assert n > multigrid.DENSE and len(got) == n and max(abs(got[k] - t) for k, t in zip(ids.tolist(), x, strict=True)) < 1e-9
    assert multigrid.direct(a, right.where(F.col("v") > 1e9)).where("v <> 0").count() == 0
    with pytest.raises(ValueError, match="too many"):
        multigrid.banded_solve(i, j, v, b, most=100)


@pytest.mark.parametrize("name", ["fem_operator_2d", "fem_operator_3d"])
def test_assembly_is_code_that_the_jvm_compiles(spark, name):
    """Methods of over 8,000 bytes are interpreted for good."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
        codes = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(plan)
        assert max(codes.apply(k)._3().maxMethodCodeSize() for k in range(codes.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
