"""Topology, quality and geometry of triangle and tetrahedron meshes.

vertices: vid, x, y, z. tris: cid, v0, v1, v2. tets: cid, v0 to v3, mat. Results are in long form; a missing neighbour is
a missing row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cross, distance, dot, length, scale, sub


def unsent(df: DataFrame) -> DataFrame:
    """df for joins that must not broadcast it: Spark judges a table by its files, and does not see what explode adds."""
    return df.hint("merge")


def corner_names(cells: DataFrame) -> list[str]:
    return [c for c in ("v0", "v1", "v2", "v3") if c in cells.columns]


def neighbors(cells: DataFrame) -> DataFrame:
    """(src, dst): distinct ordered pairs of corners of a cell. Partial distinct runs before the one shuffle."""
    names = corner_names(cells)
    pairs = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a in names for b in names if a != b])
    return cells.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").where("src <> dst").distinct()


def adjacent_cells(cells: DataFrame) -> DataFrame:
    """(vid, cid): cells that a vertex is a corner of."""
    return cells.select(F.explode(F.array(*corner_names(cells))).alias("vid"), "cid")


def across_edge(tris: DataFrame) -> DataFrame:
    """(cid, slot, other): the triangle on the other side of the edge opposite a corner, where it runs the other way."""
    half = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(f"v{(k + 1) % 3}").alias("a"), F.col(f"v{(k + 2) % 3}").alias("b")) for k in range(3)])
    edges = tris.select("cid", F.explode(half).alias("h")).select("cid", "h.slot", "h.a", "h.b")
    back = edges.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("cid").alias("found"))
    return edges.join(back, ["a", "b"]).where("cid <> found").groupBy("cid", "slot").agg(F.min("found").alias("other"))


def across_face(tets: DataFrame) -> DataFrame:
    """(cid, slot, other): the tetrahedron that shares the face opposite a corner; of several the least."""
    faces = F.array(*[F.struct(F.lit(k).alias("slot"), F.array_sort(F.array(*[f"v{j}" for j in range(4) if j != k])).alias("face")) for k in range(4)])
    sides = tets.select("cid", F.explode(faces).alias("f")).select("cid", "f.slot", "f.face")
    return sides.join(unsent(sides.select("face", F.col("cid").alias("found"))), "face").where("cid <> found").groupBy("cid", "slot").agg(F.min("found").alias("other"))


def boundary_vertices(tris: DataFrame) -> DataFrame:
    """vid of vertices that have not as many neighbours as triangles."""
    n = neighbors(tris).groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("n"))
    c = adjacent_cells(tris).groupBy("vid").agg(F.count(F.lit(1)).alias("c"))
    return n.join(c, "vid").where("n <> c").select("vid")


def valence_stats(edges: DataFrame) -> DataFrame:
    """Least, greatest and truncated mean number of neighbours."""
    v = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return v.agg(F.min("n").alias("min_valence"), F.max("n").alias("max_valence"), F.floor(F.sum("n") / F.count(F.lit(1))).cast("long").alias("mean_valence"))


def with_corners(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """cells with the coordinates of corner k as xk, yk, zk: one join of exploded corners and one group by cell."""
    names = corner_names(cells)
    points = cells.select("cid", F.posexplode(F.array(*names)).alias("k", "vid")).join(unsent(vertices.select("vid", "x", "y", "z")), "vid")
    wide = points.groupBy("cid").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(len(names)) for c in "xyz"])
    return cells.join(unsent(wide), "cid")


def corner(k: int):
    return F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"z{k}")


def edge_lengths(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    w = with_corners(tris, vertices)
    return w.select("cid", distance(corner(0), corner(1)).alias("e01"), distance(corner(1), corner(2)).alias("e12"), distance(corner(2), corner(0)).alias("e20"))


def radius_edge(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """Circumradius over the shortest edge of each triangle; null for one without area."""
    e = edge_lengths(tris, vertices)
    a, b, c = F.col("e01"), F.col("e12"), F.col("e20")
    s = (a + b + c) * (b + c - a) * (c + a - b) * (a + b - c)
    return e.select("cid", F.when(s > 0, a * b * c / F.sqrt(s) / F.least(a, b, c)).alias("ratio"))


def tet_measures(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """cid, mat, volume, and circumradius over the shortest edge with the sign of the orientation."""
    w = with_corners(tets, vertices)
    a, b, c = (sub(corner(k), corner(0)) for k in (1, 2, 3))
    det = dot(a, cross(b, c))
    top = [x + y + z for x, y, z in zip(scale(cross(b, c), dot(a, a)), scale(cross(c, a), dot(b, b)), scale(cross(a, b), dot(c, c)), strict=True)]
    shortest = F.least(*[distance(corner(i), corner(j)) for i in range(4) for j in range(i)])
    return w.select("cid", "mat", (F.abs(det) / 6).alias("volume"), F.when(det != 0, length(tuple(top)) / (2 * det) / shortest).alias("ratio"))


def volume_by_material(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    v = tet_measures(tets, vertices)
    return v.agg(F.sum("volume").alias("total"), F.sum(F.when(F.col("mat") == 0, F.col("volume")).otherwise(0.0)).alias("material_0")).select("*", (F.col("material_0") / F.col("total")).alias("share"))


def normals(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    w = with_corners(tris, vertices)
    n = scale(cross(sub(corner(1), corner(0)), sub(corner(2), corner(0))), 0.5)
    return w.select("cid", *[c.alias(f"n{a}") for c, a in zip(n, "xyz", strict=True)])


def non_obtuse(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cid, slot, acute): whether the angle at each corner is below a right angle."""
    w = with_corners(tris, vertices)
    flags = F.array(*[dot(sub(corner((k + 1) % 3), corner(k)), sub(corner((k + 2) % 3), corner(k))) > 1e-12 for k in range(3)])
    return w.select("cid", F.posexplode(flags).alias("slot", "acute"))


def bounding_box(vertices: DataFrame) -> DataFrame:
    return vertices.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def rescale(vertices: DataFrame, size: float = 1.0, axes: str = "xyz") -> DataFrame:
    """Each axis to 0..size on its own; an axis of no extent becomes null. Triangle meshes keep z: axes="xy"."""
    box = F.broadcast(bounding_box(vertices))  # one row

    def moved(c: str) -> Column:
        extent = F.col(f"max_{c}") - F.col(f"min_{c}")
        return (F.when(extent > 0, (F.col(c) - F.col(f"min_{c}")) / extent * size) if c in axes else F.col(c)).alias(c)

    return vertices.crossJoin(box).select("vid", *[moved(c) for c in "xyz"])


def smooth(vertices: DataFrame, edges: DataFrame, sweeps: int = 1, pinned: Column | None = None) -> DataFrame:
    """Laplacian smoothing, all vertices at once in each sweep; pinned ones and those without neighbours stay."""
    pinned = F.lit(False) if pinned is None else pinned
    for _ in range(sweeps):
        mean = edges.join(vertices.select(F.col("vid").alias("dst"), "x", "y", "z"), "dst").groupBy(F.col("src").alias("vid")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        vertices = vertices.join(mean, "vid", "left").select("vid", *[F.when(pinned | F.col(f"m{c}").isNull(), F.col(c)).otherwise(F.col(f"m{c}")).alias(c) for c in "xyz"])
    return vertices


def tessellate(polygons: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pid, k, v0, v1, v2) of polygons (pid, corners array): a quad by its shorter diagonal, more corners as a fan.

    Diagonals that are equal, to 1e-12, split from corner 1 to 3. Polygons of fewer than three corners give nothing.
    """
    quads = polygons.where(F.size("corners") == 4).select("pid", *[F.get("corners", F.lit(k)).alias(f"v{k}") for k in range(4)])
    pts = quads.select(F.col("pid").alias("cid"), "v0", "v1", "v2", "v3")
    w = with_corners(pts, vertices).select(F.col("cid").alias("pid"), (distance(corner(0), corner(2)) + 1e-12 < distance(corner(1), corner(3))).alias("first"))
    c = lambda k: F.get("corners", k if isinstance(k, Column) else F.lit(k))
    fan = F.transform(F.sequence(F.lit(1), F.size("corners") - 2), lambda k: F.array(c(0), c(k), c(k + 1)))
    other = F.array(F.array(c(0), c(1), c(3)), F.array(c(1), c(2), c(3)))
    split = F.when((F.size("corners") == 4) & ~F.coalesce("first", F.lit(False)), other).otherwise(fan)
    out = polygons.where(F.size("corners") >= 3).join(w, "pid", "left").select("pid", F.posexplode(split).alias("k", "t"))
    return out.select("pid", "k", *[F.get("t", F.lit(j)).alias(f"v{j}") for j in range(3)])


def shift_indexes(cells: DataFrame, n_vertices: int) -> DataFrame:
    """Corner ids moved to start at zero, where their range is as long as the list of vertices but starts elsewhere."""
    names = corner_names(cells)
    low, high = cells.agg(F.min(F.least(*names)), F.max(F.greatest(*names))).first()
    by = low if low and high - low + 1 <= n_vertices and high >= n_vertices else 0
    return cells.select(*[(F.col(c) - by).alias(c) if c in names else F.col(c) for c in cells.columns])


def vertex_normals(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit sums of the normals of the triangles at each vertex."""
    n = adjacent_cells(tris).join(unsent(normals(tris, vertices)), "cid").groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = reduce(lambda a, b: a + b, [F.col(f"n{a}") * F.col(f"n{a}") for a in "xyz"])
    return n.select("vid", *[F.when(size > 0, F.col(f"n{a}") / F.sqrt(size)).alias(f"n{a}") for a in "xyz"])
