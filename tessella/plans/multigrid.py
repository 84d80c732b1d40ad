"""Smoothed-aggregation multigrid, alone or as the preconditioner of conjugate gradients.

The levels of a matrix are tables down to `top_size` rows, where a dense solve ends the cycle on the driver; `solution` takes
those of a matrix of at most `gather` entries as arrays (`arrays`), by the same steps. Vectors are written tables, so plans stay short. Smoothing works inside blocks: the residual comes from one
distributed product, then all sweeps of a block run in one task without a further shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregation, sparse
from ..operators.graph import induced, permutation
from . import arrays
from .lineage import discard, written

DENSE = 4096  #: most rows of a dense solve
BANDED = 1 << 26  #: most numbers that the elimination by levels keeps, 512 MB


@dataclass(frozen=True)
class SolverOptions:
    max_levels: int = 100
    top_size: int = 256  #: a level of no more rows is solved directly
    max_iters: int = 100
    tolerance: float = 1e-6
    relative: bool = True  #: to the norm of the right-hand side
    solver: str = "pcg"  #: or "amg"
    cycle: str = "V"  #: V, W, F, or K (two steps of conjugate gradients on each coarser level)
    pre_sweeps: int = 5
    post_sweeps: int = 5
    post_relaxes: int = 1  #: residuals that the post-smoother takes, each followed by post_sweeps
    smoother_weight: float = 0.67
    omega: float = 0.67  #: of the prolongator
    aggregator: str = "mis"  #: mis, partition or conditioned, see parts_of
    depth: int = 2  #: distance of the parts' roots
    block_depth: int = 1  #: distance of the blocks' roots, in parts
    least: int = 2  #: vertices of a part
    most: int = 512  #: vertices of a block
    gather: int = 9 << 20  #: entries of a matrix that `solution` takes to the driver at most, see README for its memory (mis)


@dataclass
class Level:
    a: DataFrame  #: i, j, v and, but for the last level, block (of i) and inside (whether j is in it)
    p: DataFrame | None
    n: int


@dataclass
class Solution:
    x: DataFrame
    residual: float
    iterations: int
    converged: bool


class NotConvergedError(ArithmeticError):
    """The tolerance was not reached; `solution` is what there is."""

    def __init__(self, solution: Solution):
        super().__init__(f"residual {solution.residual:.3g} after {solution.iterations} iterations")
        self.solution = solution


def size_of(a: DataFrame) -> int:
    n = a.where("i = j").count()
    if not n:
        raise ValueError("the matrix is empty or has no diagonal")
    return n


def dense(a: DataFrame, most: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """The matrix on the driver, and the ids of its rows; more than `most` rows are an error."""
    n = size_of(a)
    if n > most:
        raise ValueError(f"{n} rows are too many for a dense solve, the most is {most}")
    rows = a.select("i", "j", "v").toPandas()
    ids = np.unique(rows["i"].to_numpy())
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])), rows["v"].to_numpy(float))
    return out, ids


def _solved(solve, ids: np.ndarray, b: DataFrame) -> DataFrame:
    """(i, v): what solve gives for the right-hand side b of rows ids."""
    rows, right = b.select("i", "v").toPandas(), np.zeros(len(ids))  # no more rows than ids
    right[np.searchsorted(ids, rows["i"])] = rows["v"]
    x = solve(right)
    return b.sparkSession.createDataFrame(list(zip(map(int, ids), map(float, x), strict=True)), "i long, v double")


def dense_solve(matrix: np.ndarray, ids: np.ndarray, b: DataFrame) -> DataFrame:
    return _solved(lambda right: np.linalg.solve(matrix, right), ids, b)


def breadth_first(i: np.ndarray, j: np.ndarray, n: int) -> list[np.ndarray]:
    """The rows 0 to n - 1 in levels, so that each entry is of one level or of two that follow each other."""
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    order = np.argsort(i, kind="stable")
    to, start, seen = j[order], np.searchsorted(i[order], np.arange(n + 1)), np.zeros(n, bool)

    def search(root: int) -> list[np.ndarray]:
        levels, now = [], np.array([root])
        while len(now):
            seen[now] = True
            levels.append(now)
            near = np.unique(np.concatenate([to[start[k] : start[k + 1]] for k in now]))
            now = near[~seen[near]]
        return levels

    out: list[np.ndarray] = []
    for row in range(n):
        if not seen[row]:
            first = search(row)
            seen[np.concatenate(first)] = False
            out += search(first[-1][0])  # from a far end levels are narrow
    return out


def banded_solve(i: np.ndarray, j: np.ndarray, v: np.ndarray, right: np.ndarray, most: int = BANDED) -> np.ndarray:
    """Block elimination along breadth-first levels, with pivots inside a level: exact for positive definite matrices.

    It keeps the widths of neighbouring levels multiplied; more than `most` numbers are an error.
    """
    levels = breadth_first(i, j, len(right))
    width = [len(x) for x in levels] + [0]
    if (size := sum(a * b for a, b in zip(width, width[1:], strict=False))) > most:
        raise ValueError(f"{size} numbers are too many for a direct solve, the most is {most}")
    level, place = np.empty(len(right), int), np.empty(len(right), int)
    for k, rows in enumerate(levels):
        level[rows], place[rows] = k, np.arange(len(rows))
    order = np.argsort(level[i], kind="stable")
    i, j, v = i[order], j[order], v[order]
    start = np.searchsorted(level[i], np.arange(len(levels) + 1))

    def block(k: int, to: int) -> np.ndarray:
        part = slice(start[k], start[k + 1])
        here = level[j[part]] == to
        out = np.zeros((width[k], width[to]))
        np.add.at(out, (place[i[part][here]], place[j[part][here]]), v[part][here])
        return out

    solved: list[np.ndarray] = []  # of each level: what its rows take of the next level's, and the right-hand side
    for k, rows in enumerate(levels):
        own, rest = block(k, k), right[rows]
        if k:
            low = block(k, k - 1)
            own, rest = own - low @ solved[-1][:, :-1], rest - low @ solved[-1][:, -1]
        solved.append(np.linalg.solve(own, np.column_stack((block(k, k + 1), rest))))
    x = np.zeros(len(right))
    for k in range(len(levels) - 1, -1, -1):
        x[levels[k]] = solved[k][:, -1] - (solved[k][:, :-1] @ x[levels[k + 1]] if k + 1 < len(levels) else 0.0)
    if not np.linalg.norm(right - np.bincount(i, v * x[j], len(right))) <= 1e-8 * np.linalg.norm(right):
        raise ArithmeticError("the elimination lost accuracy, as pivots inside a level were not enough")
    return x


def direct(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """LU on the driver: dense up to DENSE rows, by banded_solve beyond. Where `most` is given it is dense, and a matrix of
    more rows is an error."""
    if most is not None or (n := size_of(a)) <= DENSE:
        return dense_solve(*dense(a, DENSE if most is None else most), b)
    rows = a.select("i", "j", "v").toPandas()
    ids = np.unique(rows["i"].to_numpy())
    if len(ids) != n:
        raise ValueError("the matrix has rows without diagonal")
    i, j, v = np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"]), rows["v"].to_numpy(float)
    return _solved(lambda right: banded_solve(i, j, v, right), ids, b)


def parts_of(edges: DataFrame, vertices: DataFrame, opts: SolverOptions) -> DataFrame:
    """(vid, agg_id, block_id, new_id) by the aggregator: parts around a distance set and weighted parts of these (mis), the
    same with blocks from the partitioner (partition), or with merged and split parts and blocks (conditioned)."""
    if opts.aggregator == "mis":
        return aggregation.two_levels(edges, vertices, opts.depth, opts.block_depth, opts.least, opts.most)
    if opts.aggregator not in ("partition", "conditioned"):
        raise ValueError(f"unknown aggregator: {opts.aggregator}")
    fine = aggregation.aggregate(edges, vertices, opts.depth, opts.least)
    if opts.aggregator == "conditioned":
        fine = aggregation.condition(edges, fine, max(opts.least, 4), 16 * max(1, opts.depth))
    fine = written(fine, "fine")
    between = written(induced(edges, fine).select("src", "dst"), "coarse")
    over = fine.select(F.col("agg_id").alias("vid")).distinct()
    size = max(1, opts.most // (16 * max(1, opts.depth)))
    blocks = aggregation.partition(between, over, size) if opts.aggregator == "partition" else aggregation.condition(between, aggregation.aggregate(between, over, opts.block_depth), max(1, size // 2), 2 * size)
    return permutation(fine, blocks.select(F.col("vid").alias("agg_id"), F.col("agg_id").alias("block_id")))


def setup(a: DataFrame, opts: SolverOptions) -> list[Level]:
    """Levels from the finest on; the last has no prolongator."""
    levels, a = [], written(a.select("i", "j", "v"), "level")
    n = size_of(a)
    while n > opts.top_size and len(levels) + 1 < opts.max_levels:
        edges = written(a.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst")).distinct(), "edges")
        parts = written(parts_of(edges, a.where("i = j").select(F.col("i").alias("vid")), opts), "parts")
        p = written(sparse.smoothed_prolongator(a, parts.select("vid", "agg_id"), opts.omega), "p")
        coarse = written(sparse.galerkin(a, p), "level")
        m = size_of(coarse)
        if m >= n:
            break
        sides = sparse.block_split(a, parts, symmetric=False).select("i", "j", "v", "block", (F.col("side") != "outside").alias("inside"))
        levels.append(Level(written(sides, "sides", a), p, n))
        discard(edges)
        a, n = coarse, m
    return [*levels, Level(a, None, n)]


def in_block_sweeps(a: DataFrame, r: DataFrame, weight: float, sweeps: int) -> DataFrame:
    """(i, v): Jacobi sweeps from zero for the right-hand side r (i, v) with the entries of a (Level.a) inside blocks.

    A block is one group of a worker; blocks have at most SolverOptions.most vertices.
    """
    blocks = a.where("i = j").select(F.col("i").alias("row"), F.col("block").alias("part"))
    inside = a.where("inside").select("block", "i", "j", "v")

    def smooth(m: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("row")
        ids, b, n = right["row"].to_numpy(), right["b"].to_numpy(), len(right)
        i, j, v = np.searchsorted(ids, m["i"]), np.searchsorted(ids, m["j"]), m["v"].to_numpy()
        diagonal = np.bincount(i[i == j], v[i == j], n)
        x = np.zeros(n)
        for _ in range(sweeps):
            x += weight * (b - np.bincount(i, v * x[j], n)) / diagonal
        return pd.DataFrame({"i": ids, "v": x})

    every = blocks.join(r.select(F.col("i").alias("row"), F.col("v").alias("b")), "row", "left").select("part", "row", F.coalesce("b", F.lit(0.0)).alias("b"))
    return inside.groupBy("block").cogroup(every.groupBy("part")).applyInPandas(smooth, "i long, v double")


class Multigrid:
    """Levels of a matrix and their cycle."""

    def __init__(self, a: DataFrame, opts: SolverOptions = SolverOptions()):
        if opts.cycle not in ("V", "W", "F", "K"):
            raise ValueError(f"unknown cycle: {opts.cycle}")
        self.opts, self.levels = opts, setup(a, opts)
        self.dense = dense(self.levels[-1].a)

    def relax(self, at: int, b: DataFrame, x: DataFrame | None, sweeps: int) -> DataFrame:
        """x, or zero, with the sweeps for its residual added."""
        a = self.levels[at].a
        step = in_block_sweeps(a, b if x is None else sparse.residual(b, a, x), self.opts.smoother_weight, sweeps)
        return written(step if x is None else sparse.axpby(1.0, x, 1.0, step), "x")

    def cycle(self, b: DataFrame, at: int = 0, kind: str | None = None) -> DataFrame:
        """An approximate solution of A x = b from zero."""
        level, o, kind = self.levels[at], self.opts, kind or self.opts.cycle
        if level.p is None:
            return dense_solve(*self.dense, b)
        below = self.levels[at + 1].p is not None
        x = self.relax(at, b, None, o.pre_sweeps)
        visits = {"V": "V", "W": "WW", "F": "FV", "K": "K"}[kind] if below else "V"  # a second visit of a dense level adds nothing
        for k, visit in enumerate(visits):
            down = sparse.spmv(sparse.transpose(level.p), sparse.residual(b, level.a, x))
            down = written(down, "r") if below else down
            low = self.descend(down, at + 1, None, 2, 0.0).x if visit == "K" and below else self.cycle(down, at + 1, visit)
            better = sparse.axpby(1.0, x, 1.0, sparse.spmv(level.p, low))
            if k + 1 < len(visits):
                better = written(better, "x")
                discard(x)
                x = better
            discard(down)
        for k in range(o.post_relaxes):
            new = self.relax(at, b, better, o.post_sweeps)
            discard(x if k == 0 else better)
            better = new
        return better

    def descend(self, b: DataFrame, at: int, x: DataFrame | None, iterations: int, limit: float) -> Solution:
        """Flexible conjugate gradients on a level, with its cycle as preconditioner; solver "amg" adds up cycles alone.

        A round writes two tables beside those of the cycle: p and A p, then x and the residual.
        """
        a, o = self.levels[at].a, self.opts
        rows = a.where("i = j").select("i").join(b.select("i", F.col("v").alias("b")), "i", "left").select("i", F.coalesce("b", F.lit(0.0)).alias("b"))
        rows = _beside(rows, x, "x") if x is not None else rows.withColumn("x", F.lit(0.0))
        first = rows.select("i", F.col("x").alias("v"))
        state = written(_beside(rows, sparse.spmv(a, first), "y").select("i", "x", (F.col("b") - F.col("y")).alias("r")), "cg")
        right, held, norm, done, before = b.select("i", "v"), None, _norm(state, "r"), 0, 0.0
        while norm > limit and done < iterations:
            z = self.cycle(state.select("i", F.col("r").alias("v")), at)
            if o.solver == "amg" and at == 0:
                new = sparse.axpby(1.0, state.select("i", F.col("x").alias("v")), 1.0, z)
                left = sparse.residual(right, a, new)
                state = written(_beside(new.select("i", F.col("v").alias("x")), left, "r"), "cg", state)
            else:
                zs = _beside(state, z, "z")
                rz, old = zs.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("_r") * F.col("z")) if held is not None else F.lit(0.0)).first()
                if not rz:
                    break
                p = z.select("i", "v") if held is None else sparse.axpby(1.0, z, (rz - old) / before, held.select("i", F.col("p").alias("v")))
                held, before = written(_beside(_beside(state.select("i", "x", "r"), p, "p"), sparse.spmv(a, p), "q"), "p", held), rz
                step = rz / held.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
                state = written(held.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), F.col("r").alias("_r")), "cg", state)
            discard(z)
            norm, done = _norm(state, "r"), done + 1
        return Solution(state.select("i", F.col("x").alias("v")), norm, done, norm <= limit)

    def stats(self) -> DataFrame:
        """(level, n_rows, nnz, density) of each level."""
        parts = [sparse.stats(level.a).select(F.lit(k).alias("level"), "n_rows", "nnz", "density") for k, level in enumerate(self.levels)]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def complexity(self) -> DataFrame:
        """One row (grid, operator): rows, and entries, of all levels for each one of the finest."""
        s = self.stats()
        top = s.where("level = 0").select(F.col("n_rows").alias("n0"), F.col("nnz").alias("z0"))
        return s.agg(F.sum("n_rows").alias("n"), F.sum("nnz").alias("z")).crossJoin(top).select((F.col("n") / F.col("n0")).alias("grid"), (F.col("z") / F.col("z0")).alias("operator"))


def _beside(rows: DataFrame, x: DataFrame, name: str) -> DataFrame:
    """rows with the values of a vector, 0 where it has none."""
    return rows.join(x.select("i", F.col("v").alias("_new")), "i", "left").select(*rows.columns, F.coalesce("_new", F.lit(0.0)).alias(name))


def _norm(rows: DataFrame, column: str) -> float:
    return float(rows.agg(F.sqrt(F.sum(F.col(column) * F.col(column)))).first()[0] or 0.0)


NULL = -(2**63)  #: stands for a missing id
AT_ONCE = 1 << 20  #: entries of a matrix that the driver's JVM takes at once


def _streamed(rows: DataFrame):
    """The columns (long or double) of each batch of rows, in their order; the driver's JVM holds one partition at a time."""
    kinds = [np.int64 if kind == "bigint" else np.float64 for _, kind in rows.dtypes]

    def packed(batches):
        for x in batches:
            filled = [c.fill_null(NULL) if pa.types.is_integer(c.type) else c for c in x.columns]
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in filled], names=x.schema.names)

    for row in rows.mapInArrow(packed, ", ".join(f"{c} binary" for c in rows.columns)).toLocalIterator():
        yield [np.frombuffer(x, kind) for x, kind in zip(row, kinds, strict=True)]


def _columns(rows: DataFrame) -> list[np.ndarray]:
    table = rows.toArrow()
    return [(c.fill_null(NULL) if pa.types.is_integer(c.type) else c).to_numpy() for c in table.columns]


def _vector(spark: SparkSession, ids: np.ndarray, v: np.ndarray) -> DataFrame:
    """(i, v). Long ones stay Arrow batches until the tasks read them; Spark makes shorter ones rows of the driver's JVM."""
    name, table = "spark.sql.execution.arrow.localRelationThreshold", pa.table({"i": ids, "v": v})
    if table.nbytes < 1 << 22:
        return spark.createDataFrame(table)
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        return spark.createDataFrame(table)
    finally:
        spark.conf.set(name, before)


def _places(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x is in ids, which are sorted, and whether it is there."""
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return at, ids[at] == x


def _matrix(a: DataFrame, ids: np.ndarray) -> arrays.Matrix | None:
    """The matrix by places in ids; nothing where an entry is not of those. Beyond AT_ONCE entries it comes in batches."""
    a = a.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
    if a.count() <= AT_ONCE:
        i, j, v = _columns(a)
        (row, own), (at, known) = _places(ids, i), _places(ids, j)
        if not (own.all() and known.all()) or NULL in (i.min(), j.min()):
            return None
        return arrays.summed(row, at, v, (len(ids), len(ids)))
    sizes, to, values = np.zeros(len(ids), np.int64), [], []
    for i, j, v in _streamed(a.orderBy("i", "j")):
        first = arrays.heads(i)
        (rows, held), (at, known) = _places(ids, i[first]), _places(ids, j)
        if not (held.all() and known.all()) or NULL in (i[0], j.min()):
            return None
        sizes[rows] += np.diff(np.append(first, len(i)))
        to.append(at.astype(np.int32))
        values.append(v)
    out = arrays.Matrix(np.concatenate(([0], np.cumsum(sizes))), np.concatenate(to), np.concatenate(values), (len(ids), len(ids)))
    again = np.flatnonzero(out.j[1:] == out.j[:-1]) + 1
    if len(np.setdiff1d(again, out.start)):  # a place has several entries
        return arrays.summed(out.i, out.j, out.v, out.shape)
    return out


def _gathered(a: DataFrame, b: DataFrame, opts: SolverOptions, x: DataFrame | None, limit: float) -> Solution | None:
    """The solution by arrays, or nothing where an entry has no row with one diagonal entry."""
    spark, vid = a.sparkSession, F.col("i").cast("long")
    ids, own = _columns(a.where("i = j").select(vid.alias("i"), F.xxhash64(vid, F.lit(0)).alias("own")).orderBy("i"))
    if (ids[1:] == ids[:-1]).any() or (matrix := _matrix(a, ids)) is None:
        return None
    n = len(ids)
    (coarse,) = _columns(spark.range(n).select(F.xxhash64("id", F.lit(0)).alias("coarse")))

    def vector(rows: DataFrame | None) -> np.ndarray:
        out = np.zeros(n)
        if rows is not None:
            at, values = _columns(rows.where("i is not null and v is not null").select(vid.alias("i"), F.col("v").cast("double").alias("v")))
            place, known = _places(ids, at)
            np.add.at(out, place[known], values[known])
        return out

    right, start = vector(b), vector(x)
    if len(matrix.j) > AT_ONCE:
        spark._jvm.System.gc()  # the driver's JVM gives back what it took for the batches, before the arrays of the levels are there
    grid = arrays.Multigrid(matrix, opts, own, coarse)
    del own, coarse
    if grid.levels[-1].a.shape[0] > DENSE:
        raise ValueError(f"{grid.levels[-1].a.shape[0]} rows are too many for a dense solve, the most is {DENSE}")
    found, norm, done = grid.descend(right, 0, start, opts.max_iters, limit)
    del grid, matrix, right, start
    return Solution(_vector(spark, ids, found), norm, done, norm <= limit)


def solution(a: DataFrame, b: DataFrame, opts: SolverOptions = SolverOptions(), x: DataFrame | None = None) -> Solution:
    """The solution of A x = b with its residual and whether that is within the tolerance; x is where it starts."""
    if opts.solver not in ("pcg", "amg"):
        raise ValueError(f"unknown solver: {opts.solver}")
    if opts.cycle not in ("V", "W", "F", "K"):
        raise ValueError(f"unknown cycle: {opts.cycle}")
    a, b = (t if hasattr(t, "_written_at") else written(t.select(*names), names[0]) for t, names in ((a, ["i", "j", "v"]), (b, ["i", "v"])))
    size_of(a)
    limit = opts.tolerance * (_norm(b, "v") if opts.relative else 1.0)
    if opts.aggregator == "mis" and a.count() <= opts.gather and (found := _gathered(a, b, opts, x, limit)):
        return found
    return Multigrid(a, opts).descend(b, 0, x, opts.max_iters, limit)


def solve(a: DataFrame, b: DataFrame, opts: SolverOptions = SolverOptions(), x: DataFrame | None = None) -> DataFrame:
    """(i, v) with |b - A x| within the tolerance; NotConvergedError if max_iters were not enough."""
    found = solution(a, b, opts, x)
    if not found.converged:
        raise NotConvergedError(found)
    return found.x
