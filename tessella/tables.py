"""Meshes, graphs and matrices derived from the star-schema tables, and the same as SQL for the oracle.

The triangle mesh has a vertex for each part, in rows of floor(sqrt(n)), z from p_size; the tetrahedron mesh has layers of
floor(cbrt(n)) squared. Every part is used; the last row or layer may be short.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.mesh import neighbors


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass
class Mesh:
    vertices: DataFrame
    cells: DataFrame
    part: DataFrame
    n: int
    m: int

    @property
    def edges(self) -> DataFrame:
        return neighbors(self.cells)

    @property
    def patches(self) -> DataFrame:
        """(vid, agg_id): squares of 4 x 4 vertices."""
        row, col = F.floor(F.col("vid") / self.m), F.col("vid") % self.m
        return self.vertices.select("vid", (F.floor(row / 4) * 1000 + F.floor(col / 4)).cast("long").alias("agg_id"))

    @property
    def rhs(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


def tri_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    n = part.count()
    m = math.isqrt(n)
    vid = F.col("p_partkey")
    vertices = part.select(vid.alias("vid"), ((vid % m) / (m - 1)).alias("x"), (F.floor(vid / m) / (m - 1)).alias("y"), (F.col("p_size") / 1000).alias("z"))
    corners = vertices.where((F.col("vid") % m < m - 1) & (F.col("vid") + m + 1 < n)).select("vid")
    two = F.array(*[F.struct((F.col("vid") * 2 + k).alias("cid"), *[(F.col("vid") + d).alias(f"v{j}") for j, d in enumerate(ds)]) for k, ds in enumerate(((0, 1, m + 1), (0, m + 1, m)))])
    return Mesh(vertices, corners.select(F.explode(two).alias("t")).select("t.*"), part, n, m)


def cube_side(n: int) -> int:
    k = round(n ** (1 / 3))
    return k - 1 if k**3 > n else k


def tet_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    n = part.count()
    k = cube_side(n)
    vid = F.col("p_partkey")
    vertices = part.select(vid.alias("vid"), (vid % k).cast("double").alias("x"), (F.floor(vid / k) % k).cast("double").alias("y"), F.floor(vid / (k * k)).cast("double").alias("z"))
    corners = part.select(vid.alias("vid"), (F.col("p_size") % 7).cast("int").alias("mat")).where((F.col("vid") % k < k - 1) & (F.floor(F.col("vid") / k) % k < k - 1) & (F.col("vid") + k * k + k + 1 < n))
    paths = [(0, a, a + b, 1 + k + k * k) for a, b in itertools.permutations((1, k, k * k), 2)]
    six = F.array(*[F.struct((F.col("vid") * 6 + t).alias("cid"), *[(F.col("vid") + d).alias(f"v{j}") for j, d in enumerate(p)], F.col("mat")) for t, p in enumerate(paths)])
    return Mesh(vertices, corners.select(F.explode(six).alias("t")).select("t.*"), part, n, k)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i part, j supplier, v quantity)."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def supplier_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))


TRI_SQL = """
c AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS m FROM part),
vertices AS (SELECT p_partkey AS vid, (p_partkey % m) / CAST(m - 1 AS DOUBLE) AS x,
  (p_partkey // m) / CAST(m - 1 AS DOUBLE) AS y, p_size / CAST(1000 AS DOUBLE) AS z FROM part, c),
tris AS (
  SELECT vid * 2 AS cid, vid AS v0, vid + 1 AS v1, vid + m + 1 AS v2 FROM vertices, c WHERE vid % m < m - 1 AND vid + m + 1 < n
  UNION ALL SELECT vid * 2 + 1, vid, vid + m + 1, vid + m FROM vertices, c WHERE vid % m < m - 1 AND vid + m + 1 < n),
edges AS (SELECT DISTINCT src, dst FROM (
  SELECT unnest([v0, v0, v1, v1, v2, v2]) AS src, unnest([v1, v2, v0, v2, v0, v1]) AS dst FROM tris)),
corners AS (SELECT t.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2
  FROM tris t JOIN vertices a ON a.vid = v0 JOIN vertices b ON b.vid = v1 JOIN vertices d ON d.vid = v2),
patches AS (SELECT vid, ((vid // m) // 4) * 1000 + (vid % m) // 4 AS agg_id FROM vertices, c)
"""

TET_SQL = """
c AS (SELECT count(*) AS n, CAST(floor(cbrt(count(*)) + 1e-9) AS BIGINT) AS k FROM part),
vertices AS (SELECT p_partkey AS vid, CAST(p_partkey % k AS DOUBLE) AS x, CAST((p_partkey // k) % k AS DOUBLE) AS y,
  CAST(p_partkey // (k * k) AS DOUBLE) AS z, p_size FROM part, c),
steps AS (SELECT * FROM (VALUES (0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 2, 0), (5, 2, 1)) AS s(t, a, b)),
tets AS (SELECT vid * 6 + t AS cid, vid AS v0, vid + CASE a WHEN 0 THEN 1 WHEN 1 THEN k ELSE k * k END AS v1,
  vid + CASE a WHEN 0 THEN 1 WHEN 1 THEN k ELSE k * k END + CASE b WHEN 0 THEN 1 WHEN 1 THEN k ELSE k * k END AS v2, vid + 1 + k + k * k AS v3, p_size % 7 AS mat
  FROM vertices, c, steps WHERE vid % k < k - 1 AND (vid // k) % k < k - 1 AND vid + k * k + k + 1 < n),
corners AS (SELECT t.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2, e.x AS x3, e.y AS y3, e.z AS z3
  FROM tets t JOIN vertices a ON a.vid = v0 JOIN vertices b ON b.vid = v1 JOIN vertices d ON d.vid = v2 JOIN vertices e ON e.vid = v3)
"""

#: Of the patches, the operator matrix of the triangle mesh.
FEM_SQL = """
g AS (SELECT *, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) AS d FROM corners),
local AS (SELECT unnest([v0, v0, v0, v1, v1, v1, v2, v2, v2]) AS i, unnest([v0, v1, v2, v0, v1, v2, v0, v1, v2]) AS j, abs(d) / 2 AS area,
  unnest([y1-y2, y1-y2, y1-y2, y2-y0, y2-y0, y2-y0, y0-y1, y0-y1, y0-y1]) AS bi, unnest([y1-y2, y2-y0, y0-y1, y1-y2, y2-y0, y0-y1, y1-y2, y2-y0, y0-y1]) AS bj,
  unnest([x2-x1, x2-x1, x2-x1, x0-x2, x0-x2, x0-x2, x1-x0, x1-x0, x1-x0]) AS ci, unnest([x2-x1, x0-x2, x1-x0, x2-x1, x0-x2, x1-x0, x2-x1, x0-x2, x1-x0]) AS cj FROM g),
stiff AS (SELECT i, j, sum((bi * bj + ci * cj) / (4 * area)) AS v FROM local GROUP BY i, j),
mass AS (SELECT i, j, sum(area * CASE WHEN i = j THEN 2 ELSE 1 END / 12.0) AS v FROM local GROUP BY i, j),
a AS (SELECT stiff.i, stiff.j, stiff.v + mass.v AS v FROM stiff JOIN mass ON stiff.i = mass.i AND stiff.j = mass.j)
"""
BUY_SQL = "b AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
