"""Finite-element assembly: local matrices by projection, the global one by a grouped sum with map-side combining.

The closed forms of linear elements take the place of quadrature: mass is measure / 12 (triangle) or / 20 (tetrahedron),
twice that on the diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cross, dot, scale, sub
from .mesh import corner, neighbors, unsent, with_corners


def _entries(cells: DataFrame, k: int, value) -> DataFrame:
    """(i, j, v): the sum over cells of the symmetric value(a, b) for each pair of corners. Joins do not broadcast it.

    A pair is summed once and mirrored afterwards. What value reads should be columns: the JVM leaves too long code uncompiled.
    """
    ends = lambda a, b: (F.least(f"v{a}", f"v{b}"), F.greatest(f"v{a}", f"v{b}")) if a != b else (F.col(f"v{a}"), F.col(f"v{a}"))
    local = F.array(*[F.struct(ends(a, b)[0].alias("i"), ends(a, b)[1].alias("j"), value(a, b).alias("v")) for a in range(k) for b in range(a, k)])
    half = cells.select(F.explode(local).alias("e")).select("e.*").groupBy("i", "j").agg(F.sum("v").alias("v"))
    there, back = F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return unsent(half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("e.*"))


def _area2() -> Column:
    (x0, y0, _), (x1, y1, _), (x2, y2, _) = (corner(k) for k in range(3))
    return (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)


def operator_2d(tris: DataFrame, vertices: DataFrame, stiffness: float = 1.0, mass: float = 1.0, signed: bool = False) -> DataFrame:
    """stiffness * K + mass * M of linear triangles in the xy plane as (i, j, v). signed keeps the sign of the area in M."""
    w = with_corners(tris, vertices).withColumn("_d", _area2())
    det = F.when(F.col("_d") == 0, F.raise_error(F.concat(F.lit("triangle without area: "), F.col("cid").cast("string"))).cast("double")).otherwise(F.col("_d"))
    w = w.withColumn("_d", det)
    b = [corner((k + 1) % 3)[1] - corner((k + 2) % 3)[1] for k in range(3)]
    c = [corner((k + 2) % 3)[0] - corner((k + 1) % 3)[0] for k in range(3)]
    area = F.abs(F.col("_d")) / 2
    weight = F.col("_d") / 2 if signed else area
    return _entries(w, 3, lambda p, q: stiffness * (b[p] * b[q] + c[p] * c[q]) / (4 * area) + mass * weight * ((2 if p == q else 1) / 12))


def coefficient(mat: Column) -> Column:
    """Conductivity of a material label: 0 and 1 have 1, 2 to 6 their number; any other label is an error."""
    return F.when(mat == 0, 1.0).when((mat >= 1) & (mat <= 6), mat.cast("double")).otherwise(F.raise_error(F.concat(F.lit("unknown material: "), F.coalesce(mat.cast("string"), F.lit("null")))).cast("double"))


def operator_3d(tets: DataFrame, vertices: DataFrame, stiffness: float = 1.0, mass: float = 1.0) -> DataFrame:
    """The same of linear tetrahedra with the coefficient of each cell's material on K."""
    w = with_corners(tets, vertices)
    faces = {0: (1, 3, 2), 1: (0, 2, 3), 2: (0, 3, 1), 3: (0, 1, 2)}
    det = dot(sub(corner(1), corner(0)), cross(sub(corner(2), corner(0)), sub(corner(3), corner(0))))
    w = w.withColumn("_d", det)
    w = w.withColumn("_d", F.when(F.col("_d") == 0, F.raise_error(F.concat(F.lit("tetrahedron without volume: "), F.col("cid").cast("string"))).cast("double")).otherwise(F.col("_d")))
    grad = [scale(cross(sub(corner(f[1]), corner(f[0])), sub(corner(f[2]), corner(f[0]))), 1 / F.col("_d")) for f in faces.values()]
    named = [c.alias(f"_g{k}{a}") for k, g in enumerate(grad) for c, a in zip(g, "xyz", strict=True)]
    w = w.select("v0", "v1", "v2", "v3", coefficient(F.col("mat")).alias("_co"), (F.abs(F.col("_d")) / 6).alias("_w"), *named)
    w = w.withColumn("_k", stiffness * F.col("_co") * F.col("_w"))
    g = [tuple(F.col(f"_g{k}{a}") for a in "xyz") for k in range(4)]
    return _entries(w, 4, lambda p, q: F.col("_k") * dot(g[p], g[q]) + mass * F.col("_w") * ((2 if p == q else 1) / 20))


def load_2d(tris: DataFrame, vertices: DataFrame, force: Column) -> DataFrame:
    """(i, v): the load of a force, an expression of columns x, y at a cell's centre; zero unless given."""
    w = with_corners(tris, vertices).withColumn("x", (F.col("x0") + F.col("x1") + F.col("x2")) / 3).withColumn("y", (F.col("y0") + F.col("y1") + F.col("y2")) / 3)
    share = force * F.abs(_area2()) / 6
    return w.select(F.explode(F.array("v0", "v1", "v2")).alias("i"), share.alias("v")).groupBy("i").agg(F.sum("v").alias("v"))


def load_3d(tets: DataFrame, vertices: DataFrame, force: Column) -> DataFrame:
    """(i, v): the load of a force, an expression of columns x, y, z at a cell's centre."""
    w = with_corners(tets, vertices)
    det = dot(sub(corner(1), corner(0)), cross(sub(corner(2), corner(0)), sub(corner(3), corner(0))))
    w = w.withColumn("_v", F.abs(det) / 6)
    for c in "xyz":
        w = w.withColumn(c, (F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 4)
    share = force * F.col("_v") / 4
    return w.select(F.explode(F.array("v0", "v1", "v2", "v3")).alias("i"), share.alias("v")).groupBy("i").agg(F.sum("v").alias("v"))


def pattern(cells: DataFrame) -> DataFrame:
    """(i, j): where an assembled matrix has entries."""
    edges = neighbors(cells).toDF("i", "j")
    return edges.union(edges.select("i", F.col("i").alias("j")).distinct())


def upper(a: DataFrame) -> DataFrame:
    return a.where("j >= i")


def mirrored(a: DataFrame) -> DataFrame:
    """A full symmetric matrix from its upper part."""
    return a.union(a.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
