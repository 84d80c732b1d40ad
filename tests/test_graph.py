import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregation, graph, mesh
from tests.test_mesh_fem import square


@pytest.fixture(scope="module")
def grid(spark):
    v, t = square(spark, 9)
    e = mesh.neighbors(t)
    e.cache().count()
    return e, v.select("vid")


@pytest.mark.parametrize("k", [1, 2])
def test_independent_sets(grid, k):
    e, v = grid
    chosen = aggregation.independent_set(e, v, k)
    assert tuple(graph.ball_violations(e, v, chosen, k).first()) == (0, 0)


def test_ascending_priority_is_the_greedy_set(grid):
    e, v = grid
    near = {}
    for a, b in e.collect():
        near.setdefault(a, set()).add(b)
    out, gone = set(), set()
    for x in sorted(near):
        if x not in gone:
            out.add(x)
            gone |= near[x] | {x}
    assert {r[0] for r in aggregation.independent_set(e, v, 1, -F.col("vid")).collect()} == out


def valid(e, v, labels, least=1, most=1 << 62):
    found = graph.label_violations(e, v, labels, least, most).first()
    return found["dense"] and (found["unassigned"], found["in_pieces"], found["outsized"]) == (0, 0, 0)


def test_aggregation_and_conditioning(grid):
    e, v = grid
    labels = aggregation.aggregate(e, v, 2, least=6)
    assert valid(e, v, labels, 6)
    assert valid(e, v, aggregation.condition(e, labels, 6, 14), 1, 14)


def test_label_violations(spark, grid):
    e, v = grid
    labels = v.select("vid", (F.col("vid") % 9 > 4).cast("long").alias("agg_id"))
    assert valid(e, v, labels) and not valid(e, v, labels, 1, 40)
    torn = labels.select("vid", F.when(F.col("vid") == 0, 1).otherwise(F.col("agg_id")).alias("agg_id"))
    assert tuple(graph.label_violations(e, v, torn).first()) == (2, True, 0, 37, 0)
    assert tuple(graph.label_violations(e, v, labels.where("vid <> 3").union(labels.where("vid = 4"))).first())[2] == 2
    with pytest.raises(ValueError, match="dense"):
        graph.validate_labels(e, v, labels.select("vid", (F.col("agg_id") * 2).alias("agg_id")))
    with pytest.raises(ValueError, match="in pieces"):
        graph.validate_labels(e, v, torn)
    assert graph.label_violations(e, v, labels.where("false")).first()["unassigned"] == 81


def test_a_split_of_a_part_that_no_worker_takes_whole(grid):
    e, v = grid
    one = v.select("vid", F.lit(0).cast("long").alias("agg_id"))
    for group in (1 << 16, 10):
        labels = aggregation.split(e, one, 10, group=group)
        sizes = sorted(r["size"] for r in graph.part_sizes(labels).collect())
        assert len(sizes) == 2 and sizes[0] >= 25
        assert graph.label_violations(e, v, labels).first()["in_pieces"] == 0


def test_weighted_parts(spark, grid):
    e, v = grid
    weights = v.select("vid", (F.col("vid") % 5 + 1).alias("w"))
    light = aggregation.drop_light(e, v.select("vid", F.when(F.col("vid") < 3, 0).when(F.col("vid") < 50, 1).otherwise(2).cast("long").alias("agg_id")), weights)
    assert {r.agg_id for r in light.select("agg_id").distinct().collect()} == {1, 2} and light.count() == 81
    parts = aggregation.weighted_aggregate(e, v, weights, 1, 40)
    assert valid(e, v, parts)
    assert max(r["weight"] for r in graph.part_sizes(parts, weights).collect()) <= 40


def test_forced_merges_and_merge_splits(spark, grid):
    e, v = grid
    row = F.floor(F.col("vid") / 9)
    labels = v.select("vid", F.when(F.col("vid") == 0, 9).otherwise(F.floor(row / 4)).cast("long").alias("agg_id"))  # 1, 35, 36 and 9 vertices
    sizes = lambda x: sorted(r["size"] for r in graph.part_sizes(x).collect())
    assert sizes(aggregation.merge(e, labels, 5, 20, 15)) == [1, 9, 35, 36]
    assert sizes(aggregation.merge(e, labels, 5, 20, 15, forced=True)) == [9, 36, 36]
    again = aggregation.merge_splits(e, labels, 12, 30, 20)
    assert sum(sizes(again)) == 81 and sizes(again)[:2] != [1, 9] and graph.label_violations(e, v, again).first()["in_pieces"] == 0


def test_majority_and_nearest_rules(grid):
    e, v = grid
    roots = v.where("vid % 20 = 0")
    for rule in ("first", "nearest", "majority"):
        assert aggregation.from_roots(e, roots, rule).count() == 81


def test_restrict(grid):
    e, v = grid
    labels = v.select("vid", (F.col("vid") % 9 > 6).cast("long").alias("agg_id"))
    sizes = [r["size"] for r in graph.part_sizes(aggregation.restrict(e, labels, 50)).collect()]
    assert max(sizes) <= 50 and sum(sizes) == 81
    assert sorted(r["size"] for r in graph.part_sizes(aggregation.restrict(e, labels, 30)).collect())[-1] <= 41  # no two parts can do


def test_violations(spark, grid):
    e, v = grid
    assert tuple(graph.violations(e, v).first()) == (81, 0, 0, 0)
    graph.validate(e, v)
    with pytest.raises(ValueError, match="one_way"):
        graph.validate(e.where("src <> 0 or dst <> 1"), v)
    with pytest.raises(ValueError, match="isolated"):
        graph.validate(e, v.union(spark.range(100, 101)))


def test_two_levels_and_empty(spark, grid):
    e, v = grid
    out = aggregation.two_levels(e, v, least=4, most=20)
    assert sorted(r.new_id for r in out.collect()) == list(range(81))
    assert valid(e, v, out.select("vid", "agg_id"), 4) and valid(e, v, out.select("vid", F.col("block_id").alias("agg_id")), 1, 20)
    none = e.where("false")
    assert graph.components(none.toDF("a", "b")).count() == 0
    assert graph.bfs(none, v.where("false")).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {k: k // 10 * 10 for k in range(40)} | {40: 40} if 40 in got else got == {k: k // 10 * 10 for k in range(40)}


def test_ball_violations(grid):
    e, v = grid
    chosen = v.where("vid in (0, 2, 80)")
    assert graph.ball_violations(e, v, chosen, 1).first()["too_near"] == 0
    found = graph.ball_violations(e, v, chosen, 2).first()
    assert found["too_near"] == 2 and found["too_far"] > 40


def test_search_over_many_rings(spark):
    n = 2 * graph.FOLD + 5
    path = spark.createDataFrame([(a, b) for k in range(n) for a, b in ((k, k + 1), (k + 1, k))], "src long, dst long")
    got = {r.vid: r.dist for r in graph.bfs(path, spark.range(1).select(F.col("id").alias("vid"))).collect()}
    assert got == {k: k for k in range(n + 1)}
