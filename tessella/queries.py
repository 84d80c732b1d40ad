"""Registered queries of the mesh, graph and matrix operators, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import quadrature
from .functions import vectors as V
from .operators import aggregation as G
from .operators import fem, graph, mesh, sparse
from .plans import multigrid
from .plans.lineage import written
from .tables import BUY_SQL, FEM_SQL, TET_SQL, TRI_SQL, purchases, read, supplier_vector, tet_mesh, tri_mesh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = ""):
    """Registers a function; base is put before the SQL as common tables."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {base.strip()} {sql.strip()}" if base else sql.strip()
        return f

    return take


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded, and a negative zero made zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in names else c for c in df.columns])


def r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# Primitives ---------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, sum(value) OVER w AS running, coalesce(sum(CAST(1 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, coalesce(event_id - lag(event_id) OVER w, 0) AS gap FROM (SELECT user_id, event_id, floor(value)::BIGINT::DOUBLE AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def prim_scan(spark, sf):
    """Inclusive and exclusive scans and adjacent differences by key."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("value"))
    return e.select("user_id", "event_id", F.sum("value").over(w).alias("running"), F.coalesce(F.sum(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"), F.coalesce(F.col("event_id") - F.lag("event_id").over(w), F.lit(0)).alias("gap"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_large, sum(l_quantity) AS total, max(l_quantity) AS most, CAST(count(DISTINCT (l_partkey, l_suppkey)) AS BIGINT) AS n_pairs, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")
def prim_reduce(spark, sf):
    """Counts, conditional counts, sums, maxima, runs of pairs and the spread, by key."""
    x = read(spark, sf, "lineitem")
    out = x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("most"), F.count_distinct("l_partkey", "l_suppkey").alias("n_pairs"), F.stddev_pop("l_quantity").alias("spread"))
    return out.withColumn("spread", F.round("spread", 6))


@query("SELECT row_number() OVER (PARTITION BY s ORDER BY p) AS k, s, p FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)")
def prim_sort_unique(spark, sf):
    """Distinct composite keys, and their places in lexicographic order within the first."""
    u = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    return u.select(F.row_number().over(Window.partitionBy("s").orderBy("p")).cast("long").alias("k"), "s", "p")


@query("SELECT l_partkey AS p, 'both' AS kind FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, 'both' FROM lineitem WHERE l_linestatus = 'O' UNION ALL (SELECT l_partkey, 'only' FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, 'only' FROM lineitem WHERE l_linestatus = 'O')")
def prim_set_ops(spark, sf):
    x = read(spark, sf, "lineitem")
    a, b = x.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p")), x.where("l_linestatus = 'O'").select("l_partkey")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b.distinct()).join(b, F.col("p") == F.col("l_partkey"), "left_anti").distinct().withColumn("kind", F.lit("only")))


# Meshes -------------------------------------------------------------------------------------------------------------------


@query("SELECT src, dst FROM edges", TRI_SQL)
def mesh_neighbors(spark, sf):
    return tri_mesh(spark, sf).edges


@query("SELECT DISTINCT src, dst FROM (SELECT unnest([v0,v0,v0,v1,v1,v1,v2,v2,v2,v3,v3,v3]) AS src, unnest([v1,v2,v3,v0,v2,v3,v0,v1,v3,v0,v1,v2]) AS dst FROM tets)", TET_SQL)
def tet_neighbors(spark, sf):
    return tet_mesh(spark, sf).edges


@query("SELECT min(n) AS min_valence, max(n) AS max_valence, CAST(sum(n) // count(*) AS BIGINT) AS mean_valence FROM (SELECT src, count(*) AS n FROM edges GROUP BY src)", TRI_SQL)
def mesh_valence_stats(spark, sf):
    return mesh.valence_stats(tri_mesh(spark, sf).edges)


TET_EDGES = "SELECT DISTINCT src, dst FROM (SELECT unnest([v0,v0,v0,v1,v1,v1,v2,v2,v2,v3,v3,v3]) AS src, unnest([v1,v2,v3,v0,v2,v3,v0,v1,v3,v0,v1,v2]) AS dst FROM tets)"


@query(f"SELECT min(n) AS min_valence, max(n) AS max_valence, CAST(sum(n) // count(*) AS BIGINT) AS mean_valence FROM (SELECT src, count(*) AS n FROM ({TET_EDGES}) GROUP BY src)", TET_SQL)
def tet_valence_stats(spark, sf):
    return mesh.valence_stats(tet_mesh(spark, sf).edges)


@query("SELECT unnest([v0, v1, v2]) AS vid, cid FROM tris", TRI_SQL)
def mesh_adjacent_cells(spark, sf):
    return mesh.adjacent_cells(tri_mesh(spark, sf).cells)


@query("SELECT unnest([v0, v1, v2, v3]) AS vid, cid FROM tets", TET_SQL)
def tet_adjacent_cells(spark, sf):
    return mesh.adjacent_cells(tet_mesh(spark, sf).cells)


@query(", h AS (SELECT cid, unnest([0, 1, 2]) AS slot, unnest([v1, v2, v0]) AS a, unnest([v2, v0, v1]) AS b FROM tris) SELECT h.cid, h.slot, min(o.cid) AS other FROM h JOIN h o ON h.a = o.b AND h.b = o.a AND h.cid <> o.cid GROUP BY 1, 2", TRI_SQL)
def mesh_across_edge(spark, sf):
    return mesh.across_edge(tri_mesh(spark, sf).cells)


@query(", h AS (SELECT cid, unnest([0, 1, 2, 3]) AS slot, unnest([list_sort([v1, v2, v3]), list_sort([v0, v2, v3]), list_sort([v0, v1, v3]), list_sort([v0, v1, v2])]) AS f FROM tets) SELECT h.cid, h.slot, min(o.cid) AS other FROM h JOIN h o ON h.f = o.f AND h.cid <> o.cid GROUP BY 1, 2", TET_SQL)
def tet_across_face(spark, sf):
    return mesh.across_face(tet_mesh(spark, sf).cells)


@query(", k AS (SELECT unnest([v0, v1, v2]) AS vid FROM tris) SELECT a.vid FROM (SELECT src AS vid, count(*) AS n FROM edges GROUP BY 1) a JOIN (SELECT vid, count(*) AS n FROM k GROUP BY 1) b ON a.vid = b.vid AND a.n <> b.n", TRI_SQL)
def mesh_boundary_vertices(spark, sf):
    return mesh.boundary_vertices(tri_mesh(spark, sf).cells)


EDGE_SQL = TRI_SQL + ", len AS (SELECT cid, sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)+(z0-z1)*(z0-z1)) AS a, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)+(z1-z2)*(z1-z2)) AS b, sqrt((x2-x0)*(x2-x0)+(y2-y0)*(y2-y0)+(z2-z0)*(z2-z0)) AS c FROM corners)"


@query(f"SELECT cid, {r('a', 6, 'e01')}, {r('b', 6, 'e12')}, {r('c', 6, 'e20')} FROM len", EDGE_SQL)
def mesh_edge_lengths(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(mesh.edge_lengths(m.cells, m.vertices), 6, "e01", "e12", "e20")


@query(f"SELECT cid, {r('a*b*c / sqrt((a+b+c)*(b+c-a)*(c+a-b)*(a+b-c)) / least(a,b,c)', 4, 'ratio')} FROM len", EDGE_SQL)
def mesh_radius_edge(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(mesh.radius_edge(m.cells, m.vertices), 4, "ratio")


@query(f"SELECT cid, {r('0.5*((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0))', 8, 'nx')}, {r('0.5*((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0))', 8, 'ny')}, {r('0.5*((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))', 8, 'nz')} FROM corners", TRI_SQL)
def mesh_normals(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(mesh.normals(m.cells, m.vertices), 8, "nx", "ny", "nz")


@query("SELECT cid, unnest([0, 1, 2]) AS slot, unnest([(x1-x0)*(x2-x0)+(y1-y0)*(y2-y0)+(z1-z0)*(z2-z0) > 1e-12, (x2-x1)*(x0-x1)+(y2-y1)*(y0-y1)+(z2-z1)*(z0-z1) > 1e-12, (x0-x2)*(x1-x2)+(y0-y2)*(y1-y2)+(z0-z2)*(z1-z2) > 1e-12]) AS acute FROM corners", TRI_SQL)
def mesh_non_obtuse(spark, sf):
    m = tri_mesh(spark, sf)
    return mesh.non_obtuse(m.cells, m.vertices)


@query("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM vertices", TRI_SQL)
def mesh_bounding_box(spark, sf):
    return mesh.bounding_box(tri_mesh(spark, sf).vertices)


@query(f", b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM vertices) SELECT vid, {r('CASE WHEN bx > ax THEN (x-ax)/(bx-ax)*16 END', 6, 'x')}, {r('CASE WHEN by_ > ay THEN (y-ay)/(by_-ay)*16 END', 6, 'y')}, {r('CASE WHEN bz > az THEN (z-az)/(bz-az)*16 END', 6, 'z')} FROM vertices, b", TRI_SQL)
def mesh_rescale(spark, sf):
    return rounded(mesh.rescale(tri_mesh(spark, sf).vertices, 16.0), 6, "x", "y", "z")


@query(f", b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM vertices) SELECT vid, {r('(x-ax)/(bx-ax)*9', 6, 'x')}, {r('(y-ay)/(by_-ay)*9', 6, 'y')}, {r('z', 6, 'z')} FROM vertices, b", TRI_SQL)
def mesh_rescale_flat(spark, sf):
    """Triangle meshes keep their height."""
    return rounded(mesh.rescale(tri_mesh(spark, sf).vertices, 9.0, "xy"), 6, "x", "y", "z")


NORMALS = """, n AS (SELECT cid, v0, v1, v2, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS b, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS c FROM corners),
 u AS (SELECT unnest([v0, v1, v2]) AS vid, a, b, c FROM n),
 w AS (SELECT vid, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM u GROUP BY vid)"""


@query(f"{NORMALS} SELECT vid, {r('a / sqrt(a*a+b*b+c*c)', 6, 'nx')}, {r('b / sqrt(a*a+b*b+c*c)', 6, 'ny')}, {r('c / sqrt(a*a+b*b+c*c)', 6, 'nz')} FROM w", TRI_SQL)
def mesh_vertex_normals(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(mesh.vertex_normals(m.cells, m.vertices), 6, "nx", "ny", "nz")


PIN = "x = 0 or x = 1 or y = 0"
SWEEP = "SELECT p.vid, CASE WHEN p.x = 0 OR p.x = 1 OR p.y = 0 OR q.vid IS NULL THEN p.x ELSE q.x END AS x, CASE WHEN p.x = 0 OR p.x = 1 OR p.y = 0 OR q.vid IS NULL THEN p.y ELSE q.y END AS y, CASE WHEN p.x = 0 OR p.x = 1 OR p.y = 0 OR q.vid IS NULL THEN p.z ELSE q.z END AS z FROM {0} p LEFT JOIN (SELECT src AS vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM edges JOIN {0} v ON v.vid = dst GROUP BY src) q ON p.vid = q.vid"


@query(f", s1 AS ({SWEEP.format('vertices')}), s2 AS ({SWEEP.format('s1')}) SELECT vid, {r('x', 9, 'x')}, {r('y', 9, 'y')}, {r('z', 9, 'z')} FROM s2", TRI_SQL)
def mesh_smooth_k(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(mesh.smooth(m.vertices, m.edges, 2, F.expr(PIN)), 9, "x", "y", "z")


TETM_SQL = TET_SQL + """, e AS (SELECT *, x1-x0 AS ax, y1-y0 AS ay, z1-z0 AS az, x2-x0 AS bx, y2-y0 AS by_, z2-z0 AS bz, x3-x0 AS cx, y3-y0 AS cy, z3-z0 AS cz FROM corners),
f AS (SELECT *, by_*cz-bz*cy AS ux, bz*cx-bx*cz AS uy, bx*cy-by_*cx AS uz, cy*az-cz*ay AS vx, cz*ax-cx*az AS vy, cx*ay-cy*ax AS vz, ay*bz-az*by_ AS wx, az*bx-ax*bz AS wy, ax*by_-ay*bx AS wz,
  ax*ax+ay*ay+az*az AS aa, bx*bx+by_*by_+bz*bz AS bb, cx*cx+cy*cy+cz*cz AS cc FROM e),
tm AS (SELECT cid, mat, ax*ux+ay*uy+az*uz AS det, sqrt(pow(aa*ux+bb*vx+cc*wx,2)+pow(aa*uy+bb*vy+cc*wy,2)+pow(aa*uz+bb*vz+cc*wz,2)) AS top,
  sqrt(least(aa, bb, cc, pow(ax-bx,2)+pow(ay-by_,2)+pow(az-bz,2), pow(ax-cx,2)+pow(ay-cy,2)+pow(az-cz,2), pow(bx-cx,2)+pow(by_-cy,2)+pow(bz-cz,2))) AS short FROM f)"""


@query(f"SELECT cid, mat, {r('abs(det)/6', 6, 'volume')}, {r('top/(2*det)/short', 4, 'ratio')} FROM tm", TETM_SQL)
def tet_radius_edge(spark, sf):
    m = tet_mesh(spark, sf)
    return rounded(mesh.tet_measures(m.cells, m.vertices), 6, "volume").withColumn("ratio", F.round("ratio", 4) + 0.0)


@query(f"SELECT {r('sum(abs(det)/6)', 4, 'total')}, {r('sum(CASE WHEN mat = 0 THEN abs(det)/6 ELSE 0 END)', 4, 'material_0')}, {r('sum(CASE WHEN mat = 0 THEN abs(det)/6 ELSE 0 END)/sum(abs(det)/6)', 6, 'share')} FROM tm", TETM_SQL)
def tet_volume_by_material(spark, sf):
    m = tet_mesh(spark, sf)
    return rounded(rounded(mesh.volume_by_material(m.cells, m.vertices), 4, "total", "material_0"), 6, "share")


@query(", q AS (SELECT vid AS pid, vid, vid + 1 AS b, vid + m + 1 AS d, vid + m AS e FROM vertices, c WHERE vid % m < m - 1 AND vid + m + 1 < n), g AS (SELECT q.*, sqrt(pow(p0.x-p2.x,2)+pow(p0.y-p2.y,2)+pow(p0.z-p2.z,2)) + 1e-12 < sqrt(pow(p1.x-p3.x,2)+pow(p1.y-p3.y,2)+pow(p1.z-p3.z,2)) AS first FROM q JOIN vertices p0 ON p0.vid = q.vid JOIN vertices p1 ON p1.vid = b JOIN vertices p2 ON p2.vid = d JOIN vertices p3 ON p3.vid = e) SELECT pid, 0 AS k, vid AS v0, b AS v1, CASE WHEN first THEN d ELSE e END AS v2 FROM g UNION ALL SELECT pid, 1, CASE WHEN first THEN vid ELSE b END, d, e FROM g", TRI_SQL)
def quad_tessellate(spark, sf):
    m = tri_mesh(spark, sf)
    quads = m.vertices.where((F.col("vid") % m.m < m.m - 1) & (F.col("vid") + m.m + 1 < m.n)).select(F.col("vid").alias("pid"), F.array("vid", F.col("vid") + 1, F.col("vid") + m.m + 1, F.col("vid") + m.m).alias("corners"))
    return mesh.tessellate(quads, m.vertices)


# Finite elements -----------------------------------------------------------------------------------------------------------

FEM = TRI_SQL + "," + FEM_SQL


@query(f"SELECT i, j, {r('v', 6, 'v')} FROM stiff", FEM)
def fem_stiffness_2d(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(fem.operator_2d(m.cells, m.vertices, mass=0.0), 6, "v")


@query(f"SELECT i, j, {r('v', 9, 'v')} FROM mass", FEM)
def fem_mass_2d(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(fem.operator_2d(m.cells, m.vertices, stiffness=0.0), 9, "v")


@query(f"SELECT i, j, {r('v', 6, 'v')} FROM a", FEM)
def fem_operator_2d(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(fem.operator_2d(m.cells, m.vertices), 6, "v")


FEM3 = TETM_SQL + """, gr AS (SELECT cid, v0, v1, v2, v3, CASE WHEN mat = 0 THEN 1.0 ELSE mat END AS co, abs(ax*ux+ay*uy+az*uz)/6 AS vol, ax*ux+ay*uy+az*uz AS det, ux, uy, uz, vx, vy, vz, wx, wy, wz FROM f),
gp AS (SELECT cid, co, vol, unnest([v0, v1, v2, v3]) AS vid, unnest([-(ux+vx+wx), ux, vx, wx])/det AS gx, unnest([-(uy+vy+wy), uy, vy, wy])/det AS gy, unnest([-(uz+vz+wz), uz, vz, wz])/det AS gz FROM (SELECT g.*, f.cid AS c2 FROM gr g JOIN f ON f.cid = g.cid))"""


@query(f"SELECT p.vid AS i, q.vid AS j, {r('sum(p.co*(p.gx*q.gx+p.gy*q.gy+p.gz*q.gz)*p.vol + p.vol*CASE WHEN p.vid = q.vid THEN 2 ELSE 1 END/20.0)', 6, 'v')} FROM gp p JOIN gp q ON p.cid = q.cid GROUP BY 1, 2", FEM3.replace("(SELECT g.*, f.cid AS c2 FROM gr g JOIN f ON f.cid = g.cid)", "gr"))
def fem_operator_3d(spark, sf):
    m = tet_mesh(spark, sf)
    return rounded(fem.operator_3d(m.cells, m.vertices), 6, "v")


@query(f", l AS (SELECT unnest([v0, v1, v2]) AS i, abs(d)/6 * ((x0+x1+x2)/3 + 2*(y0+y1+y2)/3) AS v FROM g) SELECT i, {r('sum(v)', 9, 'v')} FROM l GROUP BY i", FEM)
def fem_load_2d(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(fem.load_2d(m.cells, m.vertices, F.col("x") + 2 * F.col("y")), 9, "v")


@query("SELECT src AS i, dst AS j FROM edges UNION ALL SELECT DISTINCT src, src FROM edges", TRI_SQL)
def fem_pattern(spark, sf):
    return fem.pattern(tri_mesh(spark, sf).cells)


@query(f"SELECT src AS i, dst AS j FROM ({TET_EDGES}) UNION ALL SELECT DISTINCT src, src FROM ({TET_EDGES})", TET_SQL)
def fem_pattern_3d(spark, sf):
    return fem.pattern(tet_mesh(spark, sf).cells)


DET = "((x1-x0)*((y2-y0)*(z3-z0)-(z2-z0)*(y3-y0)) + (y1-y0)*((z2-z0)*(x3-x0)-(x2-x0)*(z3-z0)) + (z1-z0)*((x2-x0)*(y3-y0)-(y2-y0)*(x3-x0)))"


@query(f", l AS (SELECT unnest([v0, v1, v2, v3]) AS i, abs({DET}) / 24 * (1 + (x0+x1+x2+x3)/4 + 2*(z0+z1+z2+z3)/4) AS v FROM corners) SELECT i, {r('sum(v)', 6, 'v')} FROM l GROUP BY i", TET_SQL)
def fem_load_3d(spark, sf):
    m = tet_mesh(spark, sf)
    return rounded(fem.load_3d(m.cells, m.vertices, 1 + F.col("x") + 2 * F.col("z")), 6, "v")


@query("SELECT CAST(n AS INT) AS corners, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(CASE WHEN i = j THEN 2.0 ELSE 1.0 END / CASE n WHEN 3 THEN 24.0 ELSE 120.0 END, 9) AS v FROM (VALUES (3), (4)) c(n), range(4) a(i), range(4) b(j) WHERE i < n AND j < n")
def reference_mass(spark, sf):
    """Mass integrals of the linear basis on the reference cells, by quadrature in collapsed coordinates."""
    rows = [(n, i, j, round(float(v), 9)) for n in (3, 4) for (i, j), v in np.ndenumerate(quadrature.reference_mass(n))]
    return spark.createDataFrame(rows, "corners int, i int, j int, v double")


@query(f"SELECT i, j, {r('v', 6, 'v')} FROM a", FEM)
def fem_mirrored(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(fem.mirrored(fem.upper(fem.operator_2d(m.cells, m.vertices))), 6, "v")


# Sparse algebra ------------------------------------------------------------------------------------------------------------


@query(f"SELECT b.i, {r('sum(b.v * coalesce(s_acctbal, 0))', 2, 'v')} FROM b LEFT JOIN supplier ON s_suppkey = b.j GROUP BY 1", BUY_SQL)
def spmv(spark, sf):
    return rounded(sparse.spmv(purchases(spark, sf), supplier_vector(spark, sf)), 2, "v")


@query("SELECT p.j AS i, q.j AS j, sum(p.v * q.v) AS v FROM b p JOIN b q ON p.i = q.i GROUP BY 1, 2", BUY_SQL)
def spgemm(spark, sf):
    b = purchases(spark, sf)
    return sparse.spgemm(sparse.transpose(b), b)


@query("SELECT i, j, v FROM (SELECT l_partkey AS i, l_suppkey AS j, 2 * sum(l_quantity) - sum(l_linenumber) AS v FROM lineitem GROUP BY 1, 2)")
def sparse_add(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_linenumber").cast("double").alias("v"))
    return sparse.add(purchases(spark, sf), lines, 2.0, -1.0)


@query("SELECT j AS i, i AS j, v FROM b", BUY_SQL)
def transpose(spark, sf):
    return sparse.transpose(purchases(spark, sf))


@query(f"SELECT i, {r('v', 6, 'v')} FROM a WHERE i = j", FEM)
def diag(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(sparse.diagonal(fem.operator_2d(m.cells, m.vertices)), 6, "v")


@query(f"SELECT k.vid AS i, {r('p_retailprice - coalesce(s.y, 0)', 4, 'v')} FROM vertices k JOIN part ON p_partkey = vid LEFT JOIN (SELECT i, sum(a.v * vertices.x) AS y FROM a JOIN vertices ON vid = j GROUP BY i) s ON s.i = k.vid", FEM)
def residual(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(sparse.residual(m.rhs, fem.operator_2d(m.cells, m.vertices), m.vertices.select(F.col("vid").alias("i"), F.col("x").alias("v"))), 4, "v")


@query(f"SELECT {r('sum(s_acctbal * s_suppkey)', 2, 'dot')}, {r('sum(abs(s_acctbal))', 2, 'norm1')}, {r('sqrt(sum(s_acctbal * s_acctbal))', 4, 'norm2')}, max(abs(s_acctbal)) AS norm_max FROM supplier")
def blas1_norms(spark, sf):
    x = supplier_vector(spark, sf)
    y = x.select("i", F.col("i").cast("double").alias("v"))
    return rounded(rounded(sparse.dot(x, y).crossJoin(sparse.norms(x)), 2, "dot", "norm1"), 4, "norm2")


@query(f"SELECT i, {r('sum(v)', 4, 'v')} FROM (SELECT s_suppkey AS i, 0.5 * s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 2.0 * s_suppkey FROM supplier) GROUP BY i")
def blas1_axpby(spark, sf):
    x = supplier_vector(spark, sf)
    return rounded(sparse.axpby(0.5, x, 2.0, x.select("i", F.col("i").cast("double").alias("v"))), 4, "v")


@query("SELECT 0 AS level, count(DISTINCT i) AS n_rows, count(*) AS nnz, round(count(*) / (count(DISTINCT i) * CAST(count(DISTINCT i) AS DOUBLE)), 9) AS density FROM a UNION ALL SELECT 1, count(DISTINCT i), count(*), round(count(*) / (count(DISTINCT i) * CAST(count(DISTINCT i) AS DOUBLE)), 9) FROM b", FEM + "," + BUY_SQL)
def grid_stats(spark, sf):
    m = tri_mesh(spark, sf)
    rows = sparse.stats(fem.operator_2d(m.cells, m.vertices)).select(F.lit(0).alias("level"), "*").union(sparse.stats(purchases(spark, sf)).select(F.lit(1), "*"))
    return rows.withColumn("density", F.round("density", 9))


PRO_SQL = FEM + """, dg AS (SELECT i, v FROM a WHERE i = j), pt AS (SELECT a.i, agg_id AS j, -0.67 * a.v / dg.v AS v FROM a JOIN dg ON dg.i = a.i JOIN patches ON vid = a.j
 UNION ALL SELECT vid, agg_id, 1.0 FROM patches), p AS (SELECT i, j, sum(v) AS v FROM pt GROUP BY 1, 2)"""


@query(f"SELECT i, j, {r('v', 6, 'v')} FROM p", PRO_SQL)
def smoothed_prolongator(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(sparse.smoothed_prolongator(fem.operator_2d(m.cells, m.vertices), m.patches), 6, "v")


@query(f", ra AS (SELECT p.j AS i, a.j, sum(p.v * a.v) AS v FROM p JOIN a ON a.i = p.i GROUP BY 1, 2) SELECT ra.i, p.j, {r('sum(ra.v * p.v)', 5, 'v')} FROM ra JOIN p ON p.i = ra.j GROUP BY 1, 2", PRO_SQL)
def galerkin(spark, sf):
    m = tri_mesh(spark, sf)
    a = fem.operator_2d(m.cells, m.vertices)
    return rounded(sparse.galerkin(a, sparse.smoothed_prolongator(a, m.patches)), 5, "v")


@query("SELECT s.agg_id AS block, CASE WHEN s.agg_id <> t.agg_id THEN 'outside' WHEN a.j > a.i THEN 'inside' ELSE 'dropped' END AS side, count(*) AS n FROM a JOIN patches s ON s.vid = a.i JOIN patches t ON t.vid = a.j GROUP BY 1, 2", FEM)
def block_split(spark, sf):
    m = tri_mesh(spark, sf)
    blocks = m.patches.withColumnRenamed("agg_id", "block_id")
    return sparse.block_split(fem.operator_2d(m.cells, m.vertices), blocks).groupBy("block", "side").agg(F.count(F.lit(1)).alias("n"))


JAC = FEM + ", dg AS (SELECT i, v FROM a WHERE i = j), rhs AS (SELECT p_partkey AS i, p_retailprice AS v FROM part), x1 AS (SELECT rhs.i, 0.67 * rhs.v / dg.v AS v FROM rhs JOIN dg ON dg.i = rhs.i)"


@query(f", y AS (SELECT a.i, sum(a.v * x1.v) AS v FROM a JOIN x1 ON x1.i = a.j GROUP BY 1) SELECT x1.i, {r('x1.v + 0.67 * (rhs.v - y.v) / dg.v', 4, 'v')} FROM x1 JOIN y ON y.i = x1.i JOIN dg ON dg.i = x1.i JOIN rhs ON rhs.i = x1.i", JAC)
def jacobi_sweep(spark, sf):
    m = tri_mesh(spark, sf)
    return rounded(sparse.jacobi(written(fem.operator_2d(m.cells, m.vertices)), m.rhs.join(m.edges.select(F.col("src").alias("i")).distinct(), "i"), None, 0.67, 2), 4, "v")


@query(f", y AS (SELECT a.i, sum(a.v * x1.v) AS v FROM a JOIN x1 ON x1.i = a.j JOIN patches s ON s.vid = a.i JOIN patches t ON t.vid = a.j AND t.agg_id = s.agg_id GROUP BY 1) SELECT x1.i, {r('x1.v + 0.67 * (rhs.v - y.v) / dg.v', 4, 'v')} FROM x1 JOIN y ON y.i = x1.i JOIN dg ON dg.i = x1.i JOIN rhs ON rhs.i = x1.i", JAC)
def block_jacobi_sweep(spark, sf):
    m = tri_mesh(spark, sf)
    rhs = m.rhs.join(m.edges.select(F.col("src").alias("i")).distinct(), "i")
    return rounded(sparse.block_jacobi(written(fem.operator_2d(m.cells, m.vertices)), rhs, m.patches.withColumnRenamed("agg_id", "block_id"), 0.67, 2), 4, "v")


@query(f"SELECT (n - 1 - a.i) AS i, (n - 1 - a.j) AS j, {r('a.v', 6, 'v')} FROM a, c", FEM)
def matrix_permuted(spark, sf):
    """The operator with its rows and columns in descending order."""
    m = tri_mesh(spark, sf)
    ids = m.vertices.select("vid", (m.n - 1 - F.col("vid")).alias("new_id"))
    return rounded(sparse.permute(fem.operator_2d(m.cells, m.vertices), ids), 6, "v")


@query(f", coarse AS (SELECT agg_id, avg(p_size) AS v FROM patches JOIN part ON p_partkey = vid GROUP BY 1) SELECT p_partkey AS i, {r('p_retailprice + 0.5 * coarse.v', 4, 'v')} FROM part JOIN patches ON vid = p_partkey JOIN coarse ON coarse.agg_id = patches.agg_id", TRI_SQL)
def patch_correction(spark, sf):
    """A piecewise constant correction: half of the mean size of a vertex's patch is added to its price."""
    m = tri_mesh(spark, sf)
    size = m.part.select(F.col("p_partkey").alias("vid"), "p_size")
    coarse = m.patches.join(size, "vid").groupBy(F.col("agg_id").alias("i")).agg(F.avg("p_size").alias("v"))
    half = m.vertices.select(F.col("vid").alias("i"), F.lit(0.5).alias("v"))
    return rounded(sparse.piecewise_correction(m.rhs, coarse, m.patches, half), 4, "v")


def _system(spark, sf):
    """The operator of the mesh and the right-hand side whose solution is p_size, for each vertex of a triangle."""
    m = tri_mesh(spark, sf)
    a = written(fem.operator_2d(m.cells, m.vertices))
    x = m.part.select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v")).join(a.select("i").distinct(), "i")
    return a, written(sparse.spmv(a, x))


SOLVER = multigrid.SolverOptions(tolerance=1e-8, top_size=128)
SIZE = "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS x FROM part WHERE p_partkey IN (SELECT src FROM edges)"


def _rounded_solution(x):
    return rounded(x.select("i", F.col("v").alias("x")), 0, "x")


@query(SIZE, TRI_SQL)
def pcg_solve(spark, sf):
    return _rounded_solution(multigrid.solve(*_system(spark, sf), SOLVER))


@query(SIZE, TRI_SQL)
def amg_solve(spark, sf):
    return _rounded_solution(multigrid.solve(*_system(spark, sf), replace(SOLVER, solver="amg")))


@query("SELECT count(*) AS n_rows, TRUE AS shrinks, TRUE AS symmetric FROM (SELECT DISTINCT src FROM edges)", TRI_SQL)
def vcycle(spark, sf):
    """One V-cycle from zero: it halves the residual at least and is a symmetric operator, as conjugate gradients need."""
    a, b = _system(spark, sf)
    grid = multigrid.Multigrid(a, SOLVER)
    c = written(b.select("i", (F.col("i") % 7 - 3.0).alias("v")))
    x, y = grid.cycle(b), grid.cycle(c)
    norm = lambda v, name: sparse.norms(v).select(F.col("norm2").alias(name))
    dots = sparse.dot(x, c).select(F.col("dot").alias("p")).crossJoin(sparse.dot(b, y).select(F.col("dot").alias("q")))
    rows = x.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(norm(sparse.residual(b, a, x), "left")).crossJoin(norm(b, "whole")).crossJoin(dots)
    return rows.select("n_rows", (F.col("left") <= 0.5 * F.col("whole")).alias("shrinks"), (F.abs(F.col("p") - F.col("q")) <= 1e-6 * F.abs("p")).alias("symmetric"))


@query("SELECT DISTINCT agg_id AS i, CAST(agg_id % 97 AS DOUBLE) AS x FROM patches", TRI_SQL)
def direct_solve(spark, sf):
    """LU of the contracted system of the patches, a sixteenth of the vertices."""
    m = tri_mesh(spark, sf)
    a = fem.operator_2d(m.cells, m.vertices)
    coarse = written(sparse.galerkin(a, sparse.smoothed_prolongator(a, m.patches)))
    b = sparse.spmv(coarse, coarse.where("i = j").select("i", (F.col("i") % 97).cast("double").alias("v")))
    return _rounded_solution(multigrid.direct(coarse, b))


# Graphs --------------------------------------------------------------------------------------------------------------------


@query("SELECT src AS vid, count(*) AS valence FROM edges GROUP BY 1", TRI_SQL)
def graph_valence(spark, sf):
    return graph.valences(tri_mesh(spark, sf).edges)


@query("SELECT (SELECT count(*) FROM vertices) AS n_vertices, (SELECT count(*) FROM vertices WHERE vid NOT IN (SELECT src FROM edges)) AS isolated, (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT vid FROM vertices)) AS outside, (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.src = e.dst AND o.dst = e.src)) AS one_way", TRI_SQL)
def graph_valid(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.violations(m.edges, m.vertices)


INDUCED = "SELECT a.agg_id AS src, b.agg_id AS dst, count(*) AS n FROM edges JOIN patches a ON a.vid = src JOIN patches b ON b.vid = dst WHERE a.agg_id <> b.agg_id GROUP BY 1, 2"


@query(INDUCED, TRI_SQL)
def induced_graph(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.induced(m.edges, m.patches)


@query(f"SELECT i.*, s.w AS src_weight FROM ({INDUCED}) i JOIN (SELECT agg_id, count(*) AS w FROM patches GROUP BY 1) s ON s.agg_id = i.src", TRI_SQL)
def induced_graph_weighted(spark, sf):
    m = tri_mesh(spark, sf)
    w = graph.part_sizes(m.patches).select(F.col("agg_id").alias("src"), F.col("weight").alias("src_weight"))
    return graph.induced(m.edges, m.patches).join(w, "src")


@query("SELECT agg_id, count(*) AS size, CAST(sum(p_size) AS BIGINT) AS weight FROM patches JOIN part ON p_partkey = vid GROUP BY 1", TRI_SQL)
def part_sizes(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.part_sizes(m.patches, m.part.select(F.col("p_partkey").alias("vid"), F.col("p_size").alias("w")))


STATS = "SELECT min(s) AS min_size, max(s) AS max_size, round(avg(s), 6) AS mean_size, (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM q) WHERE k = (n - 1) // 2) AS median_size, round(stddev_pop(s), 6) AS std_size FROM q"


@query(f", q AS (SELECT count(*) AS s FROM patches GROUP BY agg_id) {STATS}", TRI_SQL)
def part_stats(spark, sf):
    return rounded(graph.size_stats(graph.part_sizes(tri_mesh(spark, sf).patches)), 6, "mean_size", "std_size")


@query(f", q AS (SELECT count(*) AS s FROM edges GROUP BY src) {STATS}", TRI_SQL)
def valence_stats(spark, sf):
    return rounded(graph.size_stats(graph.valences(tri_mesh(spark, sf).edges), "valence"), 6, "mean_size", "std_size")


@query("SELECT count(*) AS n_edges, count(*) FILTER (a.agg_id <> b.agg_id) AS n_cut, count(*) FILTER (a.agg_id <> b.agg_id) / CAST(count(*) AS DOUBLE) AS cut_ratio FROM edges JOIN patches a ON a.vid = src JOIN patches b ON b.vid = dst WHERE src < dst", TRI_SQL)
def edge_cut(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.edge_cut(m.edges, m.patches)


@query("SELECT agg_id, row_number() OVER (PARTITION BY agg_id ORDER BY vid) - 1 AS position, vid FROM patches", TRI_SQL)
def aggregate_map(spark, sf):
    return graph.aggregate_map(tri_mesh(spark, sf).patches)


@query("SELECT vid, agg_id, agg_id // 3000 AS block_id, row_number() OVER (ORDER BY agg_id // 3000, agg_id, vid) - 1 AS new_id FROM patches", TRI_SQL)
def aggregate_permutation(spark, sf):
    p = tri_mesh(spark, sf).patches
    return graph.permutation(p, p.select("agg_id", F.floor(F.col("agg_id") / 3000).cast("long").alias("block_id")).distinct())


@query("SELECT agg_id, CAST(sum(s) OVER (ORDER BY agg_id) - s AS BIGINT) AS start FROM (SELECT agg_id, count(*) AS s FROM patches GROUP BY 1)", TRI_SQL)
def part_offsets(spark, sf):
    return graph.offsets(tri_mesh(spark, sf).patches)


@query(", k AS (SELECT agg_id, row_number() OVER (ORDER BY agg_id) - 1 AS id FROM (SELECT agg_id FROM patches GROUP BY 1 HAVING count(*) >= 16)) SELECT vid, id AS agg_id FROM patches JOIN k ON k.agg_id = patches.agg_id", TRI_SQL)
def drop_small_parts(spark, sf):
    return graph.drop_small(tri_mesh(spark, sf).patches, 16)


@query(", k AS (SELECT agg_id, row_number() OVER (ORDER BY agg_id) - 1 AS id FROM (SELECT agg_id FROM patches JOIN part ON p_partkey = vid GROUP BY 1 HAVING sum(p_size) >= 400)) SELECT vid, id AS agg_id FROM patches JOIN k ON k.agg_id = patches.agg_id", TRI_SQL)
def drop_light_parts(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.drop_small(m.patches, 400, m.part.select(F.col("p_partkey").alias("vid"), F.col("p_size").alias("w")))


@query(f", q AS (SELECT sum(p_size) AS s FROM patches JOIN part ON p_partkey = vid GROUP BY agg_id) {STATS}".replace("min(s) AS", "CAST(min(s) AS BIGINT) AS").replace("max(s) AS", "CAST(max(s) AS BIGINT) AS").replace("(SELECT s FROM", "(SELECT CAST(s AS BIGINT) FROM"), TRI_SQL)
def part_weight_stats(spark, sf):
    m = tri_mesh(spark, sf)
    sizes = graph.part_sizes(m.patches, m.part.select(F.col("p_partkey").alias("vid"), F.col("p_size").alias("w")))
    return rounded(graph.size_stats(sizes, "weight"), 6, "mean_size", "std_size")


@query(", l AS (SELECT agg_id, vid, row_number() OVER (PARTITION BY agg_id ORDER BY vid) - 1 AS k FROM patches) SELECT a.agg_id, a.k AS src, b.k AS dst FROM edges JOIN l a ON a.vid = src JOIN l b ON b.vid = dst AND b.agg_id = a.agg_id", TRI_SQL)
def subgraphs(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.subgraphs(m.edges, m.patches)


BFS = """RECURSIVE """ + TRI_SQL.strip() + """, reached(round, vid, dist) AS (
  SELECT 0, CAST(0 AS BIGINT), 0
  UNION ALL (WITH now AS (SELECT * FROM reached), fresh AS (SELECT DISTINCT dst FROM now JOIN edges ON src = vid WHERE dst NOT IN (SELECT vid FROM now))
    SELECT round + 1, vid, dist FROM now WHERE EXISTS (SELECT 1 FROM fresh)
    UNION ALL SELECT (SELECT max(round) + 1 FROM now), dst, (SELECT max(round) + 1 FROM now) FROM fresh)),
 bfs AS (SELECT vid, dist FROM reached WHERE round = (SELECT max(round) FROM reached))"""


@query("SELECT vid, dist FROM bfs", BFS)
def bfs_distance(spark, sf):
    """Steps from vertex 0 over the whole mesh."""
    return graph.bfs(written(tri_mesh(spark, sf).edges), spark.range(1).select(F.col("id").alias("vid")))


@query("SELECT min(vid) AS vid, dist FROM bfs WHERE dist = (SELECT max(dist) FROM bfs) GROUP BY dist", BFS)
def farthest_node(spark, sf):
    return graph.farthest(written(tri_mesh(spark, sf).edges), spark.range(1).select(F.col("id").alias("vid")))


DIST = TRI_SQL + ", ins AS (SELECT a.agg_id, src, dst FROM edges JOIN patches a ON a.vid = src JOIN patches b ON b.vid = dst AND a.agg_id = b.agg_id), d0 AS (SELECT agg_id, vid AS s, vid AS t, 0 AS d FROM patches)" + "".join(f", d{k} AS (SELECT agg_id, s, t, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT x.agg_id, s, dst, d + 1 FROM d{k - 1} x JOIN ins ON src = t) GROUP BY 1, 2, 3)" for k in range(1, 8))


@query("SELECT agg_id, s AS vid, CAST(sum(d) AS BIGINT) AS mass, CAST(max(d) AS BIGINT) AS reach FROM d7 GROUP BY 1, 2", DIST)
def mass_score(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.part_distances(m.edges, m.patches)


@query(", q AS (SELECT agg_id, s, sum(d) AS w FROM d7 GROUP BY 1, 2) SELECT agg_id, s AS vid FROM (SELECT *, row_number() OVER (PARTITION BY agg_id ORDER BY w, s) AS k FROM q) WHERE k = 1", DIST)
def centroid(spark, sf):
    m = tri_mesh(spark, sf)
    return graph.centroids(m.edges, m.patches)


@query(", s AS (SELECT vid FROM vertices, c WHERE (vid // m) % 3 = 0 AND (vid % m) % 3 = 0), one AS (SELECT s.vid AS r, dst AS t FROM s JOIN edges ON src = s.vid), two AS (SELECT * FROM one UNION SELECT r, dst FROM one JOIN edges ON src = t) SELECT (SELECT count(DISTINCT t) FROM two WHERE r <> t AND t IN (SELECT vid FROM s)) AS too_near, (SELECT count(*) FROM vertices WHERE vid NOT IN (SELECT vid FROM s) AND vid NOT IN (SELECT t FROM two)) AS too_far", TRI_SQL)
def k_hop_ball(spark, sf):
    m = tri_mesh(spark, sf)
    chosen = m.vertices.where((F.floor(F.col("vid") / m.m) % 3 == 0) & (F.col("vid") % m.m % 3 == 0)).select("vid")
    return graph.ball_violations(m.edges, m.vertices, chosen, 2)


def _linked(m):
    e = written(m.edges)
    return e, e.select(F.col("src").alias("vid")).distinct()


PRIORITY = "(vid * 2654435761) % 4294967296"  #: scatters the ids; the same in SQL


def _mis_sql(k):
    """A maximal set of vertices more than k apart, in rounds: `chosen`; state is 0 open, 1 in, 2 out."""
    near = "near AS (SELECT src AS a, dst AS b FROM edges)" if k == 1 else "near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT x.src, y.dst FROM edges x JOIN edges y ON y.src = x.dst WHERE x.src <> y.dst)"
    return f"""RECURSIVE {TRI_SQL.strip()}, {near}, mis(round, vid, p, state) AS (
      SELECT 0, vid, {PRIORITY}, 0 FROM (SELECT DISTINCT src AS vid FROM edges)
      UNION ALL (WITH now AS (SELECT * FROM mis), free AS (SELECT * FROM now WHERE state = 0),
        lost AS (SELECT DISTINCT f.vid FROM free f JOIN near ON a = f.vid JOIN free g ON g.vid = b WHERE g.p > f.p OR g.p = f.p AND g.vid > f.vid),
        fresh AS (SELECT vid FROM free WHERE vid NOT IN (SELECT vid FROM lost)),
        gone AS (SELECT DISTINCT b AS vid FROM near JOIN fresh ON fresh.vid = a)
        SELECT round + 1, vid, p, CASE WHEN vid IN (SELECT vid FROM fresh) THEN 1 WHEN state = 0 AND vid IN (SELECT vid FROM gone) THEN 2 ELSE state END
        FROM now WHERE EXISTS (SELECT 1 FROM free))),
    chosen AS (SELECT vid FROM mis WHERE state = 1 AND round = (SELECT max(round) FROM mis))"""


@query("SELECT vid FROM chosen", _mis_sql(1))
def mis_k1(spark, sf):
    return G.independent_set(*_linked(tri_mesh(spark, sf)), 1, F.expr(PRIORITY))


@query("SELECT vid FROM chosen", _mis_sql(2))
def mis_k2(spark, sf):
    return G.independent_set(*_linked(tri_mesh(spark, sf)), 2, F.expr(PRIORITY))


ROOTS = TRI_SQL + ", g0 AS (SELECT vid, vid AS agg_id FROM vertices, c WHERE (vid // m) % 3 = 0 AND (vid % m) % 3 = 0)" + "".join(f", g{k} AS (SELECT * FROM g{k - 1} UNION ALL SELECT src, arg_min(agg_id, dst) FROM edges JOIN g{k - 1} g ON g.vid = dst WHERE src NOT IN (SELECT vid FROM g{k - 1}) GROUP BY src)" for k in range(1, 5))


@query("SELECT vid, agg_id FROM g4", ROOTS)
def nearest_root_agg(spark, sf):
    m = tri_mesh(spark, sf)
    roots = m.vertices.where((F.floor(F.col("vid") / m.m) % 3 == 0) & (F.col("vid") % m.m % 3 == 0)).select("vid")
    return G.from_roots(written(m.edges), roots)


GROWN = _mis_sql(2) + """, grown(round, vid, root) AS (
  SELECT 0, vid, vid FROM chosen
  UNION ALL (WITH now AS (SELECT * FROM grown), ring AS (SELECT src AS vid, arg_min(root, dst) AS root FROM edges JOIN now ON now.vid = dst WHERE src NOT IN (SELECT vid FROM now) GROUP BY src)
    SELECT round + 1, vid, root FROM now WHERE EXISTS (SELECT 1 FROM ring)
    UNION ALL SELECT (SELECT max(round) + 1 FROM now), vid, root FROM ring))"""


@query("SELECT vid, agg_id FROM g4", ROOTS.replace("arg_min(agg_id, dst)", "min(agg_id)"))
def least_root_agg(spark, sf):
    """As nearest_root_agg, but of the labels beside it a vertex takes the least."""
    m = tri_mesh(spark, sf)
    roots = m.vertices.where((F.floor(F.col("vid") / m.m) % 3 == 0) & (F.col("vid") % m.m % 3 == 0)).select("vid")
    return G.from_roots(written(m.edges), roots, "nearest")


@query("SELECT vid, dense_rank() OVER (ORDER BY root) - 1 AS agg_id FROM grown WHERE round = (SELECT max(round) FROM grown)", GROWN)
def aggregate_parts(spark, sf):
    return G.aggregate(*_linked(tri_mesh(spark, sf)), 2, priority=F.expr(PRIORITY))


FLAGS = "SELECT DISTINCT src AS vid, TRUE AS assigned, TRUE AS connected, TRUE AS fits FROM edges"


@query(FLAGS, TRI_SQL)
def aggregate_without_runts(spark, sf):
    """Parts of nine vertices at least; for each vertex whether it has a part, in one piece and of that size."""
    e, v = _linked(tri_mesh(spark, sf))
    return graph.label_flags(e, v, written(G.aggregate(e, v, 2, 9)), 9)


@query(", e AS (SELECT vid, (vid // m) // 4 AS stripe, ((vid // m) // 4) % 2 AS agg_id FROM vertices, c WHERE vid IN (SELECT src FROM edges)), s AS (SELECT stripe, min(vid) AS low FROM e GROUP BY 1), k AS (SELECT stripe, row_number() OVER (ORDER BY low) - 1 AS id FROM s) SELECT vid, id AS agg_id FROM e JOIN k ON k.stripe = e.stripe", TRI_SQL)
def components_in_parts(spark, sf):
    """Two labels in stripes of four rows fall apart into one part for each stripe."""
    m = tri_mesh(spark, sf)
    e, v = _linked(m)
    return graph.split_parts(e, v.select("vid", (F.floor(F.floor(F.col("vid") / m.m) / 4) % 2).cast("long").alias("agg_id")))


@query("SELECT DISTINCT src AS vid, TRUE AS assigned, TRUE AS fits FROM edges", TRI_SQL)
def restrict_part_size(spark, sf):
    """From parts of 32 and 16 vertices to parts of 28 at most."""
    m = tri_mesh(spark, sf)
    e, v = _linked(m)
    row, col = F.floor(F.floor(F.col("vid") / m.m) / 4), F.floor(F.col("vid") % m.m / 4)
    uneven = v.select("vid", (row * 1000 + col - F.when(col % 3 == 1, 1).otherwise(0)).cast("long").alias("agg_id"))
    return graph.label_flags(e, v, written(G.restrict(e, uneven, 28)), 1, 28).drop("connected")


@query(FLAGS, TRI_SQL)
def weighted_parts(spark, sf):
    """Connected parts that weigh 600 at most, where a vertex weighs its p_size."""
    m = tri_mesh(spark, sf)
    e, v = _linked(m)
    weights = m.part.select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("long").alias("w"))
    labels = written(G.weighted_aggregate(e, v, weights.join(v, "vid"), 2, 600))
    heavy = graph.part_sizes(labels, weights).where(F.col("weight") > 600).select("agg_id")
    flags = graph.label_flags(e, v, labels).drop("fits")
    fits = labels.join(heavy.withColumn("heavy", F.lit(True)), "agg_id", "left").select("vid", F.col("heavy").isNull().alias("fits"))
    return flags.join(fits, "vid").select("vid", "assigned", "connected", "fits")


@query(FLAGS, TRI_SQL)
def merge_split(spark, sf):
    m = tri_mesh(spark, sf)
    e, v = _linked(m)
    return graph.label_flags(e, v, written(G.condition(e, m.patches.join(v, "vid"), 10, 24)), 1, 24)


@query(FLAGS, TRI_SQL)
def k_way_partition(spark, sf):
    e, v = _linked(tri_mesh(spark, sf))
    return graph.label_flags(e, v, written(G.partition(e, v, 64)), 1, 96)


@query("SELECT DISTINCT src AS vid, TRUE AS assigned, TRUE AS connected, TRUE AS fits, TRUE AS in_order FROM edges", TRI_SQL)
def two_level_partition(spark, sf):
    """Parts of nine vertices at least in connected blocks of at most 512, and whether ids follow blocks and parts."""
    e, v = _linked(tri_mesh(spark, sf))
    out = written(G.two_levels(e, v))
    flags = graph.label_flags(e, v, out.select("vid", F.col("block_id").alias("agg_id")), 9, 512)
    spans = out.groupBy("block_id", "agg_id").agg(F.min("new_id").alias("low"), F.max("new_id").alias("high"), F.count(F.lit(1)).alias("n"))
    good = spans.select("agg_id", (F.col("high") - F.col("low") + 1 == F.col("n")).alias("in_order"))
    return flags.join(out.select("vid", "agg_id"), "vid").join(good, "agg_id").select("vid", "assigned", "connected", "fits", "in_order")


@query("SELECT (SELECT count(DISTINCT agg_id) FROM patches) AS n_parts, FALSE AS dense, CAST(0 AS BIGINT) AS unassigned, (SELECT count(*) FROM patches WHERE vid NOT IN (SELECT src FROM edges) AND (SELECT count(*) FROM patches q WHERE q.agg_id = patches.agg_id) > 1) AS alone, (SELECT count(*) FROM patches WHERE (SELECT count(*) FROM patches q WHERE q.agg_id = patches.agg_id) < 16) AS outsized", TRI_SQL)
def partition_valid(spark, sf):
    """The violations of the patches: their ids have gaps, those at the border are small, and unlinked vertices are pieces."""
    m = tri_mesh(spark, sf)
    e = written(m.edges)
    found = graph.label_violations(e, m.vertices, m.patches, 16)
    alone = m.patches.join(e.select(F.col("src").alias("vid")).distinct(), "vid", "left_anti").join(graph.part_sizes(m.patches).where("size > 1"), "agg_id").agg(F.count(F.lit(1)).alias("alone"))
    return found.drop("in_pieces").crossJoin(alone)


# Scalar functions ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT s_suppkey AS id, {r('x - floor(x)', 6, 'fract')}, {r('least(greatest(x, 0.25), 0.75)', 6, 'clamp')}, {r('x * x * x', 4, 'cube')}, CASE WHEN x < 0.5 THEN 0.0 ELSE 1.0 END AS step,
 {r('t * t * (3 - 2 * t)', 6, 'smoothstep')}, CASE WHEN x < 0 THEN -1 ELSE 1 END AS sgn, {r('1 * (1 - t) + 3 * t', 6, 'mix')}
 FROM (SELECT *, least(greatest(x / 2, 0.0), 1.0) AS t FROM (SELECT s_suppkey, s_acctbal / 1000 AS x FROM supplier))""")
def vec_scalars(spark, sf):
    x = F.col("s_acctbal") / 1000
    t = V.clamp(x / 2, 0, 1)
    out = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), V.fract(x).alias("fract"), V.clamp(x, 0.25, 0.75).alias("clamp"), V.cube(x).alias("cube"), V.step(0.5, x).alias("step"), V.smoothstep(0, 2, x).alias("smoothstep"), V.sgn(x).alias("sgn"), V.mix(F.lit(1.0), F.lit(3.0), t).alias("mix"))
    return rounded(rounded(out, 6, "fract", "clamp", "smoothstep", "mix"), 4, "cube")


@query(f"""SELECT id, {r("list_extract([v, q, p, p, t, v], i + 1)", 6, 'r')}, {r("list_extract([t, v, v, q, p, p], i + 1)", 6, 'g')}, {r("list_extract([p, p, t, v, v, q], i + 1)", 6, 'b')} FROM (
 SELECT id, v, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t, CAST(six - f AS INT) % 6 AS i FROM (SELECT *, six - floor(six) AS f FROM (SELECT s_suppkey AS id, (h - floor(h / (2 * pi())) * (2 * pi())) * 3 / pi() AS six, 0.75::DOUBLE AS s, 0.5::DOUBLE AS v FROM (SELECT s_suppkey, s_acctbal / 700 AS h FROM supplier))))""")
def hsv_to_rgb(spark, sf):
    rgb = V.hsv_to_rgb(F.col("s_acctbal") / 700, F.lit(0.75), F.lit(0.5))
    return rounded(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), *[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)]), 6, "r", "g", "b")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of the mesh applied to the prices of its vertices, with the price."""
    m = tri_mesh(spark, sf_dir)
    y = sparse.spmv(fem.operator_2d(m.cells, m.vertices), m.rhs)
    return y.join(m.rhs.withColumnRenamed("v", "price"), "i")
