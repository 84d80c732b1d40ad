"""Aggregation of graphs: distance-k independent sets, nearest-root parts and the conditioning of part sizes.

Rounds are grouped maxima over edges; priorities are hashes of the ids, so results are the same in every run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, written
from .graph import bfs_from, induced, labelled, numbered, part_sizes, permutation, renumbered, split_parts

GROUP = 1 << 16  #: most vertices of a part that one worker takes whole


def independent_set(edges: DataFrame, vertices: DataFrame, k: int = 1, priority: Column | None = None, seed: int = 0) -> DataFrame:
    """(vid): a maximal set of vertices more than k apart. The greatest (priority, id) within k of itself joins, round by round.

    priority = -vid gives the set that a greedy pass by ascending id finds; without one it is a hash of id and seed.
    """
    priority = F.xxhash64("vid", F.lit(seed)) if priority is None else priority
    state = written(vertices.select("vid", priority.cast("long").alias("p"), F.lit(0).alias("kind")), "mis")  # 0 open, 1 in, 2 out
    while not state.where("kind = 0").isEmpty():
        free = state.where("kind = 0").select("vid", F.struct("p", "vid").alias("own"))
        heard = free.select("vid", F.col("own").alias("m"))
        for _ in range(k):
            spread = edges.join(heard.select(F.col("vid").alias("dst"), "m"), "dst").select(F.col("src").alias("vid"), "m")
            heard = heard.union(spread).groupBy("vid").agg(F.max("m").alias("m"))
        fresh = written(free.join(heard, "vid").where("own = m").select("vid"), "fresh")
        near = fresh
        for _ in range(k):
            near = near.union(edges.join(near.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid"))).distinct()
        state = state.join(near.withColumn("near", F.lit(True)), "vid", "left").join(fresh.withColumn("fresh", F.lit(True)), "vid", "left")
        kind = F.when(F.col("fresh"), 1).when((F.col("kind") == 0) & F.col("near"), 2).otherwise(F.col("kind"))
        state = written(state.select("vid", "p", kind.alias("kind")), "mis")
        discard(fresh)
    return state.where("kind = 1").select("vid")


def grow(edges: DataFrame, labels: DataFrame, rule: str = "first") -> DataFrame:
    """Labels spread, ring by ring, to all that they reach: a vertex takes that of its labelled neighbour of least id
    (first), the most frequent one among its neighbours (majority), or the least one (nearest)."""
    labels = written(labels.select("vid", "agg_id"), "grow")
    while True:
        offers = edges.join(labels.select(F.col("vid").alias("dst"), "agg_id"), "dst").join(labels.select(F.col("vid").alias("src")), "src", "left_anti")
        if rule == "first":
            new = offers.groupBy(F.col("src").alias("vid")).agg(F.min(F.struct("dst", "agg_id"))["agg_id"].alias("agg_id"))
        elif rule == "nearest":
            new = offers.groupBy(F.col("src").alias("vid")).agg(F.min("agg_id").alias("agg_id"))
        else:
            votes = offers.groupBy("src", "agg_id").agg(F.count(F.lit(1)).alias("n"))
            new = votes.groupBy(F.col("src").alias("vid")).agg(F.max(F.struct(F.col("n"), (-F.col("agg_id")).alias("m")))["m"].alias("m")).select("vid", (-F.col("m")).alias("agg_id"))
        new = written(new, "ring")
        if new.isEmpty():
            return labels
        labels = written(labels.unionByName(new), "grow")


def from_roots(edges: DataFrame, roots: DataFrame, rule: str = "first") -> DataFrame:
    """(vid, agg_id): each vertex with the root it was reached from; parts are named by their roots' ids."""
    return grow(edges, roots.select("vid", F.col("vid").alias("agg_id")), rule)


def aggregate(edges: DataFrame, vertices: DataFrame, k: int = 2, least: int = 1, rule: str = "first", seed: int = 0, priority: Column | None = None) -> DataFrame:
    """Dense (vid, agg_id): parts around a distance-k set; those under `least` vertices dissolve into their neighbours.

    A part with no other part beside it stays. Isolated vertices are parts of their own.
    """
    labels = from_roots(edges, independent_set(edges, vertices, k, priority, seed), rule)
    while least > 1:
        small = part_sizes(labels).where(F.col("size") < least).select("agg_id")
        beside = induced(edges, labels).select(F.col("src").alias("agg_id")).distinct()
        small = small.join(beside, "agg_id")
        # of two small neighbours one must stay to grow into: those of least id among their small neighbours stay this round
        pairs = labelled(edges, labels).where("a <> b").select(F.col("a").alias("agg_id"), "b")
        kept = small.join(pairs, "agg_id").join(small.select(F.col("agg_id").alias("b"), F.lit(True).alias("s")), "b", "left").groupBy("agg_id").agg(F.count(F.when(F.col("s").isNull() | (F.col("b") < F.col("agg_id")), 1)).alias("n")).where("n > 0")
        gone = written(kept.select("agg_id"), "gone")
        if gone.isEmpty():
            break
        labels = grow(edges, labels.join(gone, "agg_id", "left_anti"), rule)
    return renumbered(labels)


def drop_light(edges: DataFrame, labels: DataFrame, weights: DataFrame, share: float = 0.7, rule: str = "first") -> DataFrame:
    """Parts lighter than a share of the mean weight dissolve, in one pass, into the parts that grow over them.

    Vertices that no remaining part reaches keep their labels.
    """
    sizes = written(part_sizes(labels, weights).select("agg_id", "weight"), "weights")
    light = sizes.crossJoin(sizes.agg((share * F.avg("weight")).alias("bound"))).where("weight < bound").select("agg_id")
    grown = grow(edges, labels.join(light, "agg_id", "left_anti"), rule)
    return grown.unionByName(labels.select("vid", "agg_id").join(grown, "vid", "left_anti"))


def weighted_aggregate(edges: DataFrame, vertices: DataFrame, weights: DataFrame, k: int = 1, most: int | None = None, share: float = 0.7, seed: int = 0) -> DataFrame:
    """Dense (vid, agg_id): connected parts around a distance-k set; the light ones dissolve. None is heavier than `most`:
    vertices move out of heavy parts, and what stays heavy is cut. A vertex alone can be over `most`."""
    labels = from_roots(edges, independent_set(edges, vertices, k, seed=seed))
    labels = drop_light(edges, labels, weights, share)
    if most is not None:
        labels = split_parts(edges, cut_heavy(restrict(edges, labels, most, weights), weights, most))
    return renumbered(labels)


def cut_heavy(labels: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """Dense labels where parts heavier than `most` are cut, in the order of ids, into parts that are not.

    Cuts are as far apart as leaves room for the heaviest vertex, so vertices lie in one part unless one alone is too heavy.
    """
    rows = labels.join(weights.select("vid", "w"), "vid")
    sums = rows.groupBy("agg_id").agg(F.sum("w").alias("s"), F.max("w").alias("top"))
    upto = F.sum("w").over(Window.partitionBy("agg_id").orderBy("vid"))  # of the heavy parts only
    heavy = rows.join(sums.where(F.col("s") > most), "agg_id").select("vid", "agg_id", F.floor((upto - 1) / F.greatest(F.lit(1), most - F.col("top"))).alias("piece"))
    light = rows.join(sums.where(F.col("s") <= most), "agg_id").select("vid", "agg_id", F.lit(0).cast("long").alias("piece"))
    every = written(heavy.unionByName(light), "pieces")
    names = numbered(every.select("agg_id", "piece").distinct(), ["agg_id", "piece"])
    return every.join(names, ["agg_id", "piece"]).select("vid", F.col("new_id").alias("agg_id"))


def restrict(edges: DataFrame, labels: DataFrame, most: int, weights: DataFrame | None = None) -> DataFrame:
    """Moves border vertices out of parts of more than `most` (vertices, or weight) into lighter parts beside them.

    In a round a heavy part gives to one part, and a part takes from one; as many vertices go, the most wanted first, as
    leave the giver above the taker. So the sum of squared weights falls with every round: it ends when no part is too
    heavy or nothing can move.
    """
    labels = labels.select("vid", "agg_id")
    rows = labels.withColumn("w", F.lit(1).cast("long")) if weights is None else labels.join(weights.select("vid", F.col("w").cast("long").alias("w")), "vid")
    rows = written(rows, "restrict")
    while True:
        sizes = rows.groupBy("agg_id").agg(F.sum("w").alias("s"))
        if sizes.where(F.col("s") > most).isEmpty():
            break
        e = labelled(edges, rows)
        own = e.groupBy("src", "a").agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("kept"))
        to = e.where("a <> b").groupBy("src", "a", "b").agg(F.count(F.lit(1)).alias("links"))
        moves = to.join(own, ["src", "a"]).join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b").join(rows.select(F.col("vid").alias("src"), "w"), "src")
        moves = moves.where((F.col("sa") > most) & (F.col("sb") + F.col("w") < F.col("sa")))
        moves = written(moves.withColumn("score", (F.col("sa") - F.col("sb")) * (F.col("links") / (F.col("kept") + 1))), "moves")
        if moves.isEmpty():
            break
        offer = moves.groupBy("a", "b").agg(F.max("score").alias("score"))
        best = offer.groupBy("a").agg(F.max(F.struct(F.col("score"), -F.col("b")))["col2"].alias("nb")).select("a", (-F.col("nb")).alias("b"))
        pairs = offer.join(best, ["a", "b"]).groupBy("b").agg(F.max(F.struct(F.col("score"), -F.col("a")))["col2"].alias("na")).select((-F.col("na")).alias("a"), "b")
        chosen = moves.join(pairs, ["a", "b"])
        upto = F.sum("w").over(Window.partitionBy("a").orderBy(F.col("score").desc(), "src"))  # of the border to one other part
        gone = chosen.withColumn("upto", upto).where((F.col("upto") == F.col("w")) | (F.col("upto") <= F.least(F.col("sa") - most, (F.col("sa") - F.col("sb") - 1) / 2)))
        rows = rows.join(gone.select(F.col("src").alias("vid"), F.col("b").alias("_to")), "vid", "left").select("vid", F.coalesce("_to", "agg_id").alias("agg_id"), "w")
        rows = written(rows, "restrict")
        discard(moves)
    return rows.select("vid", "agg_id")


def merge(edges: DataFrame, labels: DataFrame, least: int, most: int, wanted: int, forced: bool = False) -> DataFrame:
    """Parts under `least` join the neighbour that brings both nearest to `wanted`, if the choice is mutual.

    No merged part is over `most`. Forced, size does not matter, and a part that is large enough takes one that chose it.
    """
    sizes = part_sizes(labels).select("agg_id", "size")
    a, b = sizes.toDF("src", "sa"), sizes.toDF("dst", "sb")
    pairs = induced(edges, labels).join(a, "src").join(b, "dst").where((F.col("sa") < least) | (F.col("sb") < least))
    if not forced:
        pairs = pairs.where(F.col("sa") + F.col("sb") <= most)
    near = F.struct(F.abs(F.col("sa") + F.col("sb") - wanted).alias("off"), F.col("dst"), F.col("sa"), F.col("sb"))
    choice = pairs.groupBy("src").agg(F.min(near).alias("c")).select("src", "c.*")
    mutual = choice.join(choice.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).where("src > dst").select(F.col("src").alias("agg_id"), F.col("dst").alias("_to"))
    if forced:
        busy = mutual.select("agg_id").union(mutual.select("_to"))
        rest = choice.where((F.col("sa") < least) & (F.col("sb") >= least)).join(busy.withColumnRenamed("agg_id", "src"), "src", "left_anti").join(busy.withColumnRenamed("agg_id", "dst"), "dst", "left_anti")
        taken = rest.groupBy(F.col("dst").alias("_to")).agg(F.min(F.struct("off", "src"))["src"].alias("agg_id")).select("agg_id", "_to")
        mutual = mutual.union(taken)
    return labels.join(mutual, "agg_id", "left").select("vid", F.coalesce("_to", "agg_id").alias("agg_id"))


def merge_splits(edges: DataFrame, labels: DataFrame, least: int, most: int, wanted: int) -> DataFrame:
    """Two adjacent parts, one of them outside least..most, with 2 * least to 2 * most vertices together are joined and cut anew.

    Of its possible partners each takes the one with the total nearest to 2 * wanted; only mutual choices count.
    """
    sizes = part_sizes(labels).select("agg_id", "size")
    outside = lambda c: ~F.col(c).between(least, most)
    pairs = induced(edges, labels).join(sizes.toDF("src", "sa"), "src").join(sizes.toDF("dst", "sb"), "dst").withColumn("total", F.col("sa") + F.col("sb"))
    pairs = pairs.where((outside("sa") | outside("sb")) & F.col("total").between(2 * least, 2 * most))
    choice = pairs.groupBy("src").agg(F.min(F.struct(F.abs(F.col("total") - 2 * wanted), "dst"))["dst"].alias("dst"))
    mutual = written(choice.join(choice.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).where("src > dst"), "pairs")
    joined = labels.join(mutual.select(F.col("src").alias("agg_id"), F.col("dst").alias("_to")), "agg_id", "left").select("vid", F.coalesce("_to", "agg_id").alias("agg_id"))
    return split(edges, written(joined, "joined"), 1, only=mutual.select(F.col("dst").alias("agg_id")))


def split(edges: DataFrame, labels: DataFrame, most: int, only: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """Parts over `most` vertices (of those in `only`, if given) in two: from two vertices far apart both sides grow.

    Up to `group` vertices a part is one group of a worker, where the smaller side grows next. Larger parts are never
    gathered: there both sides grow a ring at a time. The new part is named by the least vertex in it, moved beyond all labels.
    """
    large = part_sizes(labels).where(F.col("size") > most)
    large = large.select("agg_id", "size") if only is None else large.join(only, "agg_id", "left_semi").select("agg_id", "size")
    large = written(large, "large")
    within = labelled(edges, labels).where("a = b").select(F.col("a").alias("agg_id"), "src", "dst").join(large, "agg_id")
    alone = labels.join(large, "agg_id").select("agg_id", F.col("vid").alias("src"), F.col("vid").alias("dst"), "size")
    inside, alone = within.where(F.col("size") <= group).drop("size"), alone.where(F.col("size") <= group).drop("size")
    top = labels.agg(F.max("agg_id")).first()[0] or 0
    if not large.where(F.col("size") > group).isEmpty():
        labels = _split_by_rings(written(within.where(F.col("size") > group).select("agg_id", "src", "dst"), "within"), labels, top)
        top = labels.agg(F.max("agg_id")).first()[0]

    def halves(g: pd.DataFrame) -> pd.DataFrame:
        near = {v: sorted(x for x in d if x != v) for v, d in g.groupby("src")["dst"]}

        def far(v):
            seen, ring = {v}, [v]
            while ring:
                last, ring = ring, sorted({x for u in ring for x in near[u]} - seen)
                seen.update(ring)
            return min(last)

        one = far(min(near))
        side = {one: 0, far(one): 1}
        fronts, sizes = [[one], [far(one)]], [1, 1]
        while any(fronts):
            s = 0 if fronts[0] and (not fronts[1] or sizes[0] <= sizes[1]) else 1
            free = [x for x in near[fronts[s][0]] if x not in side]
            if not free:
                fronts[s].pop(0)
                continue
            side[free[0]] = s
            fronts[s].append(free[0])
            sizes[s] += 1
        moved = [v for v in near if side.get(v, 0) == 1]
        return pd.DataFrame({"vid": moved, "_to": top + 1 + min(moved)}) if moved else pd.DataFrame({"vid": pd.Series(dtype="int64"), "_to": pd.Series(dtype="int64")})

    new = inside.union(alone).groupBy("agg_id").applyInPandas(halves, "vid long, _to long")
    return labels.join(new, "vid", "left").select("vid", F.coalesce("_to", "agg_id").alias("agg_id"))


def _split_by_rings(within: DataFrame, labels: DataFrame, top: int) -> DataFrame:
    """split() for the parts of edges within (agg_id, src, dst), by steps over all of them at once."""
    members = within.select("agg_id", F.col("src").alias("vid")).distinct()
    edges = within.select("src", "dst")

    def ends(sources: DataFrame) -> DataFrame:
        far = bfs_from(edges, sources).join(members, "vid").groupBy("agg_id").agg(F.max(F.struct(F.col("dist"), -F.col("vid")))["col2"].alias("m"))
        return written(far.select("agg_id", (-F.col("m")).alias("vid")), "ends")

    one = ends(members.groupBy("agg_id").agg(F.min("vid").alias("vid")))
    two = ends(one)
    sides = from_roots(edges, one.select("vid").union(two.select("vid")))
    second = sides.join(two.select(F.col("vid").alias("agg_id"), F.col("agg_id").alias("part")), "agg_id")
    names = second.groupBy("part").agg((F.min("vid") + top + 1).alias("_to"))
    return written(labels.join(second.select("vid", "part").join(names, "part").select("vid", "_to"), "vid", "left").select("vid", F.coalesce("_to", "agg_id").alias("agg_id")), "parts")


def outsized(labels: DataFrame, least: int, most: int) -> float:
    """The share of parts outside least..most."""
    return part_sizes(labels).agg(F.avg(F.when(F.col("size").between(least, most), 0.0).otherwise(1.0))).first()[0] or 0.0


def condition(edges: DataFrame, labels: DataFrame, least: int, most: int, tolerance: float = 0.0, cycles: int = 10) -> DataFrame:
    """Merges, splits and merge-splits, cycle by cycle, until the share of parts outside least..most is within tolerance.

    In every other cycle merges are forced and too large parts then split. Ends after `cycles`, or when neither kind of
    cycle makes the share smaller; the parts of the smallest share are returned, none of them over `most`.
    """
    wanted = (least + most) // 2
    labels = written(labels.select("vid", "agg_id"), "parts")
    while not part_sizes(labels).where(F.col("size") > most).isEmpty():
        labels = written(split(edges, labels, most), "parts")
    best, share, worse = labels, outsized(labels, least, most), 0
    for c in range(cycles):
        if share <= tolerance or worse > 1:
            break
        labels = written(merge(edges, labels, least, most, wanted, forced=c % 2 == 1), "parts")
        while not part_sizes(labels).where(F.col("size") > most).isEmpty():
            labels = written(split(edges, labels, most), "parts")
        labels = written(merge_splits(edges, labels, least, most, wanted), "parts")
        while not part_sizes(labels).where(F.col("size") > most).isEmpty():
            labels = written(split(edges, labels, most), "parts")
        now = outsized(labels, least, most)
        worse = 0 if now < share else worse + 1
        if now < share:
            best, share = labels, now
    return renumbered(best)


def partition(edges: DataFrame, vertices: DataFrame, size: int) -> DataFrame:
    """Connected parts of about `size` vertices: parts around a distance set, then conditioned. Stands for a k-way partitioner."""
    k = max(1, round((size / 3) ** 0.5))
    return condition(edges, aggregate(edges, vertices, k), max(1, size // 2), size * 3 // 2)


def two_levels(edges: DataFrame, vertices: DataFrame, fine_depth: int = 2, coarse_depth: int = 1, least: int = 9, most: int = 512) -> DataFrame:
    """(vid, agg_id, block_id, new_id): parts, blocks of parts of at most `most` vertices, and the order by both.

    A block weighs as much as its parts have vertices; a part alone can be over `most`.
    """
    fine = written(aggregate(edges, vertices, fine_depth, least), "fine")
    between = written(induced(edges, fine).select("src", "dst"), "coarse")
    weights = written(part_sizes(fine).select(F.col("agg_id").alias("vid"), F.col("size").alias("w")), "weights")
    blocks = weighted_aggregate(between, weights.select("vid"), weights, coarse_depth, most)
    return permutation(fine, blocks.select(F.col("vid").alias("agg_id"), F.col("agg_id").alias("block_id")))
