"""python -m tessella -i mesh [-t elements] [-A matrix.mat] [-b rhs.mat] [-o out] [-s pcg|amg] [-c V|W|F|K] [-v]: solves on a mesh, writes VTK."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import fem, sparse
from .plans import multigrid
from .plans.lineage import written
from .sources import matlab, meshes


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("-i", "--input", required=True, help="triangle mesh, or nodes of a tetrahedron mesh")
    p.add_argument("-t", "--tets", help="elements of the tetrahedron mesh")
    p.add_argument("-A", "--matrix", help="sparse matrix to solve with instead of the assembled one")
    p.add_argument("-b", "--rhs", help="right-hand side; ones if left out")
    p.add_argument("-o", "--output", help="folder for the VTK file")
    p.add_argument("-s", "--solver", choices=["pcg", "amg"], default="pcg")
    p.add_argument("-c", "--cycle", choices=["V", "W", "F", "K"], default="V")
    p.add_argument("--top-size", type=int, default=256, help="rows of the level that is solved directly")
    p.add_argument("-v", "--verbose", action="store_true", help="print rounds, the residual and its norms")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    vertices, cells = meshes.read_tets(spark, a.input, a.tets) if a.tets else meshes.read_triangles(spark, a.input)
    matrix = sparse.on_pattern(matlab.read_sparse(spark, a.matrix), fem.pattern(cells)) if a.matrix else (fem.operator_3d if a.tets else fem.operator_2d)(cells, vertices)
    b = matlab.read_vector(spark, a.rhs) if a.rhs else vertices.select(F.col("vid").alias("i"), F.lit(1.0).alias("v"))
    matrix = written(matrix, "matrix")
    found = multigrid.solution(matrix, b, multigrid.SolverOptions(solver=a.solver, cycle=a.cycle, top_size=a.top_size))
    if a.verbose:
        print(f"{found.iterations} rounds", sparse.norms(sparse.residual(b, matrix, found.x)).first())
    if not found.converged:
        raise multigrid.NotConvergedError(found)
    if a.output:
        meshes.write_vtk(vertices, cells, found.x, a.output)


if __name__ == "__main__":
    main()
