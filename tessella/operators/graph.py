"""Graphs as edges (src, dst), both ways and distinct; labels as (vid, agg_id); weights as (vid, w)."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, written


FOLD = 16  #: rings of a search that are tables of their own at a time


def valences(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("valence"))


def violations(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row of counts: vertices, those without edges, edge ends that are no vertices, edges without their reverse."""
    v = vertices.select("vid")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = [
        v.select(F.lit("n_vertices").alias("k")),
        v.join(edges.select(F.col("src").alias("vid")).distinct(), "vid", "left_anti").select(F.lit("isolated").alias("k")),
        edges.join(v, edges["dst"] == v["vid"], "left_anti").select(F.lit("outside").alias("k")),
        edges.join(back, ["src", "dst"], "left_anti").select(F.lit("one_way").alias("k")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("n_vertices", "isolated", "outside", "one_way")])


def validate(edges: DataFrame, vertices: DataFrame) -> None:
    """Raises ValueError for an empty graph, isolated vertices, ends outside it or one-way edges."""
    found = violations(edges, vertices).first()
    if not found["n_vertices"]:
        raise ValueError("the graph has no vertices")
    for k in ("isolated", "outside", "one_way"):
        if found[k]:
            raise ValueError(f"{found[k]} {k}")


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst and the labels a, b of both ends."""
    a = labels.select(F.col("vid").alias("src"), F.col("agg_id").alias("a"))
    b = labels.select(F.col("vid").alias("dst"), F.col("agg_id").alias("b"))
    return edges.join(a, "src").join(b, "dst")


def induced(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The contracted graph (src, dst, n) with the number of edges that an edge stands for."""
    return labelled(edges, labels).where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def part_sizes(labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(agg_id, size, weight); without weights each vertex weighs 1."""
    rows = labels.withColumn("w", F.lit(1).cast("long")) if weights is None else labels.join(weights, "vid")
    return rows.groupBy("agg_id").agg(F.count(F.lit(1)).alias("size"), F.sum("w").cast("long").alias("weight"))


def size_stats(sizes: DataFrame, column: str = "size") -> DataFrame:
    """Least, greatest, mean, lower median and population deviation; the median from running counts of the distinct values."""
    counts = sizes.groupBy(F.col(column).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    upto = running_sum(counts, ["s"], "c", "upto")
    n = sizes.agg(F.count(F.lit(1)).alias("n"), F.min(column).cast("long").alias("min_size"), F.max(column).cast("long").alias("max_size"), F.avg(column).alias("mean_size"), F.stddev_pop(column).alias("std_size"))
    median = upto.crossJoin(F.broadcast(n.select("n"))).where(F.col("upto") > F.floor((F.col("n") - 1) / 2)).agg(F.min("s").cast("long").alias("median_size"))
    return n.crossJoin(median).select("min_size", "max_size", "mean_size", "median_size", "std_size")


def edge_cut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Undirected edges, those between parts, and their share."""
    e = labelled(edges.where("src < dst"), labels)
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_cut")).select("n_edges", "n_cut", (F.col("n_cut") / F.col("n_edges")).alias("cut_ratio"))


def aggregate_map(labels: DataFrame) -> DataFrame:
    """(agg_id, position, vid): members of each part in order."""
    return labels.select("agg_id", (F.row_number().over(Window.partitionBy("agg_id").orderBy("vid")) - 1).cast("long").alias("position"), "vid")


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows as a written table, sorted within ranges of the order, with the range (_p) and the place in it (_k)."""
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = written(held, "ranges")
    return held.withColumn("_p", F.shiftright("_at", 33)).withColumn("_k", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def _before(held: DataFrame, amount: Column) -> Column:
    """For a range, the sum of an amount over the ranges before it: one number for each range goes through the driver."""
    sums = sorted(held.groupBy("_p").agg(amount).collect())
    starts = itertools.accumulate([0, *(n for _, n in sums)])
    table = [F.lit(x) for (p, _), at in zip(sums, starts, strict=False) for x in (p, at)]
    return F.element_at(F.create_map(*table), F.col("_p")) if table else F.lit(0)


def numbered(rows: DataFrame, order: list[str], name: str = "new_id") -> DataFrame:
    """rows with 0, 1, ... in the order of columns: ranges are sorted apart and get offsets, so no task has all rows."""
    held = _ranges(rows, order)
    return held.withColumn(name, (_before(held, F.count(F.lit(1))) + F.col("_k")).cast("long")).drop("_p", "_k")


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of a whole number over themselves and all before, in the same way."""
    held = _ranges(rows, order)
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy("_k"))
    return held.withColumn(name, (_before(held, F.sum(value)) + inside).cast("long")).drop("_p", "_k")


def permutation(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """(vid, agg_id, block_id, new_id): vertices numbered by block (agg_id, block_id), part and id."""
    return numbered(labels.join(blocks, "agg_id").select("vid", "agg_id", "block_id"), ["block_id", "agg_id", "vid"])


def offsets(labels: DataFrame) -> DataFrame:
    """(agg_id, start): where a part begins when vertices are in the order of their labels."""
    sizes = part_sizes(labels).select("agg_id", "size")
    return running_sum(sizes, ["agg_id"], "size", "_upto").select("agg_id", (F.col("_upto") - F.col("size")).alias("start"))


def renumbered(labels: DataFrame) -> DataFrame:
    """Labels made dense, in their order."""
    ids = numbered(labels.select("agg_id").distinct(), ["agg_id"])
    return labels.join(ids, "agg_id").select("vid", F.col("new_id").alias("agg_id"))


def drop_small(labels: DataFrame, least: int, weights: DataFrame | None = None) -> DataFrame:
    """Labels of the parts of at least that size (or weight), made dense; members of others have no row."""
    kept = part_sizes(labels, weights).where((F.col("size") if weights is None else F.col("weight")) >= least).select("agg_id")
    return renumbered(labels.join(kept, "agg_id", "left_semi"))


def subgraphs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(agg_id, src, dst): edges inside parts, ends numbered within the part."""
    local = aggregate_map(labels)
    a = local.select(F.col("vid").alias("src"), F.col("position").alias("_s"), "agg_id")
    b = local.select(F.col("vid").alias("dst"), F.col("position").alias("_d"), F.col("agg_id").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where("agg_id = _b").select("agg_id", F.col("_s").alias("src"), F.col("_d").alias("dst"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): component is its smallest node.

    Alternates the large-star and small-star steps, each a grouped minimum and a join; both sides stay distributed.
    Null ends are left out. A component of n nodes takes O(log n) rounds; each round is a written table.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = None
    for _ in itertools.count():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    star = edges.groupBy("a").agg(F.min("b").alias("component"))
    return star.toDF("node", "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def split_parts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels where each connected piece of a part is a part of its own, made dense in the order of their least vertices."""
    inside = labelled(edges, labels).where("a = b").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = components(inside)
    return renumbered(labels.join(found, labels["vid"] == found["node"], "left").select("vid", F.coalesce("component", "vid").alias("agg_id")))


def bfs(edges: DataFrame, sources: DataFrame, depth: int = 1 << 30) -> DataFrame:
    """(vid, dist) of what sources (vid) reach in at most `depth` steps."""
    return bfs_from(edges, sources, depth)


def bfs_from(edges: DataFrame, sources: DataFrame, depth: int = 1 << 30) -> DataFrame:
    """The same; a step reads the edges of the last ring only, and its ends are held against the two rings before.

    That is enough where edges go both ways, as in all graphs here. Every FOLD rings are put in one table.
    """
    frontier = written(sources.select("vid", F.lit(0).alias("dist")).distinct(), "ring")
    rings, before = [frontier], frontier.where("false")
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).distinct()
        old = frontier.select("vid").union(before.select("vid"))
        ring = written(step.join(old, "vid", "left_anti").select("vid", F.lit(d).alias("dist")), "ring")
        if ring.isEmpty():
            break
        before, frontier = frontier, ring
        rings.append(ring)
        if len(rings) > FOLD:
            held = rings[:-2]
            rings = [written(_union(held), "reached"), *rings[-2:]]
            for x in held:
                discard(x)
    return _union(rings)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def ball_violations(edges: DataFrame, vertices: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Whether chosen (vid) is a set of distance over k that reaches all within k: counts of too_near and too_far.

    too_near counts the chosen with another one within k. For that each vertex hears, step by step, of the two greatest
    chosen around it; no pairs are made.
    """
    heard = chosen.select("vid", F.col("vid").alias("root"))
    for _ in range(k):
        spread = edges.join(heard.select(F.col("vid").alias("src"), "root"), "src").select(F.col("dst").alias("vid"), "root")
        heard = heard.union(spread).groupBy("vid").agg(F.slice(F.sort_array(F.collect_set("root"), False), 1, 2).alias("two")).select("vid", F.explode("two").alias("root"))
    near = heard.where("root <> vid").join(chosen, "vid", "left_semi").agg(F.count_distinct("vid").alias("too_near"))
    far = vertices.select("vid").join(heard.select("vid").distinct(), "vid", "left_anti").agg(F.count(F.lit(1)).alias("too_far"))
    return near.crossJoin(far)


def label_flags(edges: DataFrame, vertices: DataFrame, labels: DataFrame, least: int = 1, most: int = 1 << 62) -> DataFrame:
    """(vid, assigned, connected, fits) for each vertex: it has one label, its part is in one piece, and of least..most vertices."""
    pieces = split_parts(edges, labels).withColumnRenamed("agg_id", "piece")
    parts = labels.join(pieces, "vid").groupBy("agg_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.count(F.lit(1)).alias("size"))
    own = labels.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.min("agg_id").alias("agg_id"))
    rows = vertices.select("vid").join(own, "vid", "left").join(parts, "agg_id", "left")
    good = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("vid", good(F.col("n") == 1).alias("assigned"), good(F.col("low") == F.col("high")).alias("connected"), good(F.col("size").between(least, most)).alias("fits"))


def label_violations(edges: DataFrame, vertices: DataFrame, labels: DataFrame, least: int = 1, most: int = 1 << 62) -> DataFrame:
    """One row: parts, whether their ids are 0, 1, ..., and the vertices without (one) label, in parts in pieces, and in
    parts outside least..most."""
    flags = label_flags(edges, vertices, labels, least, most)
    bad = flags.agg(*[F.count(F.when(~F.col(c), 1)).alias(n) for c, n in (("assigned", "unassigned"), ("connected", "in_pieces"), ("fits", "outsized"))])
    ids = labels.agg(F.count_distinct("agg_id").alias("n_parts"), F.min("agg_id").alias("low"), F.max("agg_id").alias("high"))
    dense = F.coalesce((F.col("low") == 0) & (F.col("high") + 1 == F.col("n_parts")), F.lit(True))
    return ids.select("n_parts", dense.alias("dense")).crossJoin(bad)


def validate_labels(edges: DataFrame, vertices: DataFrame, labels: DataFrame) -> None:
    """Raises ValueError unless every vertex has one label, ids are 0, 1, ... and parts are connected."""
    found = label_violations(edges, vertices, labels).first()
    if not found["dense"]:
        raise ValueError("labels are not dense")
    for k in ("unassigned", "in_pieces"):
        if found[k]:
            raise ValueError(f"{found[k]} vertices {k.replace('_', ' ')}")


def part_distances(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(agg_id, vid, mass, reach): the sum and the greatest of the distances from a vertex within its part.

    Parts are small by construction (hundreds of vertices), so each is one group in numpy; unreachable ones count nothing.
    """
    inside = labelled(edges, labels).where("a = b").select(F.col("a").alias("agg_id"), "src", "dst")
    alone = labels.select("agg_id", F.col("vid").alias("src"), F.col("vid").alias("dst"))

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        near = {v: [x for x in d if x != v] for v, d in g.groupby("src")["dst"]}
        rows = []
        for v in sorted(near):
            dist, ring, d = {v: 0}, [v], 0
            while ring:
                d += 1
                ring = list(dict.fromkeys(x for u in ring for x in near[u] if x not in dist))
                dist |= dict.fromkeys(ring, d)
            rows.append((g["agg_id"].iloc[0], v, sum(dist.values()), max(dist.values())))
        return pd.DataFrame(rows, columns=["agg_id", "vid", "mass", "reach"])

    return inside.union(alone).groupBy("agg_id").applyInPandas(measure, "agg_id long, vid long, mass long, reach long")


def centroids(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(agg_id, vid): the vertex of a part with the least sum of distances, the least id of equals."""
    return part_distances(edges, labels).groupBy("agg_id").agg(F.min(F.struct("mass", "vid"))["vid"].alias("vid"))


def farthest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row (vid, dist): the vertex farthest from sources, the least id of equals."""
    return bfs(edges, sources).agg(F.max(F.struct(F.col("dist"), -F.col("vid"))).alias("m")).select((-F.col("m")["col2"]).alias("vid"), F.col("m")["dist"].alias("dist"))
