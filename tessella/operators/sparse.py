"""Sparse matrices as (i, j, v) and vectors as (i, v). Missing entries are zero; sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import unsent


def summed(a: DataFrame) -> DataFrame:
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x; rows of A whose entries all meet zeros are there with 0."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("_x")), "j", "left").groupBy("i").agg(F.sum(F.col("v") * F.coalesce("_x", F.lit(0.0))).alias("v"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(unsent(right), a["j"] == F.col("_k")).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, ka: float = 1.0, kb: float = 1.0) -> DataFrame:
    return summed(a.select("i", "j", (F.col("v") * ka).alias("v")).unionByName(b.select("i", "j", (F.col("v") * kb).alias("v"))))


def on_pattern(a: DataFrame, pattern: DataFrame, value: float = 1e-12) -> DataFrame:
    """a with `value` added wherever pattern (i, j) has an entry, so that all of the pattern is there."""
    return add(a, pattern.select("i", "j", F.lit(value).alias("v")))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def axpby(ka: float, x: DataFrame, kb: float, y: DataFrame) -> DataFrame:
    both = x.select("i", (F.col("v") * ka).alias("v")).unionByName(y.select("i", (F.col("v") * kb).alias("v")))
    return both.groupBy("i").agg(F.sum("v").alias("v"))


def residual(b: DataFrame, a: DataFrame, x: DataFrame) -> DataFrame:
    return axpby(1.0, b, -1.0, spmv(a, x))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row, one column: dot."""
    return x.join(y.select("i", F.col("v").alias("_y")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("_y")), F.lit(0.0)).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    return x.agg(F.sum(F.abs("v")).alias("norm1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm2"), F.max(F.abs("v")).alias("norm_max"))


def stats(a: DataFrame) -> DataFrame:
    """rows, nnz and density (entries over rows squared)."""
    s = a.agg(F.count_distinct("i").alias("n_rows"), F.count(F.lit(1)).alias("nnz"))
    return s.select("n_rows", "nnz", (F.col("nnz") / (F.col("n_rows") * F.col("n_rows"))).alias("density"))


def permute(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows and columns renamed by ids (vid, new_id)."""
    p = ids.select(F.col("vid").alias("i"), F.col("new_id").alias("_i"))
    q = ids.select(F.col("vid").alias("j"), F.col("new_id").alias("_j"))
    return a.join(unsent(p), "i").join(unsent(q), "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "v")


def block_split(a: DataFrame, blocks: DataFrame, symmetric: bool = True) -> DataFrame:
    """a with its row's block and where it goes: inside a block (symmetric: strictly above the diagonal), outside, or neither."""
    p = blocks.select(F.col("vid").alias("i"), F.col("block_id").alias("block"))
    q = blocks.select(F.col("vid").alias("j"), F.col("block_id").alias("_b"))
    inside = F.when(F.col("j") > F.col("i"), "inside").otherwise("dropped") if symmetric else F.when(F.col("j") == F.col("i"), "dropped").otherwise("inside")
    return a.join(p, "i").join(q, "j").select("i", "j", "v", "block", F.when(F.col("block") == F.col("_b"), inside).otherwise("outside").alias("side"))


def smoothed_prolongator(a: DataFrame, agg: DataFrame, omega: float = 0.67) -> DataFrame:
    """(I - omega D^-1 A) T with the 0/1 membership T of agg (vid, agg_id)."""
    t = agg.select(F.col("vid").alias("j"), F.col("agg_id"))
    d = diagonal(a).select("i", F.col("v").alias("_d"))
    smooth = a.join(unsent(d), "i").join(unsent(t), "j").select("i", F.col("agg_id").alias("j"), (-omega * F.col("v") / F.col("_d")).alias("v"))
    return summed(smooth.unionByName(agg.select(F.col("vid").alias("i"), F.col("agg_id").alias("j"), F.lit(1.0).alias("v"))))


def galerkin(a: DataFrame, p: DataFrame) -> DataFrame:
    return spgemm(spgemm(transpose(p), a), p)


def jacobi(a: DataFrame, b: DataFrame, x: DataFrame | None = None, weight: float = 1.0, sweeps: int = 1) -> DataFrame:
    """Weighted Jacobi sweeps; without x the first gives weight * b / diagonal."""
    d = diagonal(a).select("i", F.col("v").alias("_d"))
    if x is None:
        x, sweeps = b.join(d, "i").select("i", (weight * F.col("v") / F.col("_d")).alias("v")), sweeps - 1
    for _ in range(sweeps):
        r = residual(b, a, x).join(d, "i").select("i", (weight * F.col("v") / F.col("_d")).alias("v"))
        x = axpby(1.0, x, 1.0, r)
    return x


def block_jacobi(a: DataFrame, b: DataFrame, blocks: DataFrame, weight: float = 1.0, sweeps: int = 5) -> DataFrame:
    """Jacobi sweeps from zero that use entries inside blocks (vid, block_id) and the diagonal only."""
    kept = block_split(a, blocks, symmetric=False).where("side = 'inside' or i = j").select("i", "j", "v")
    return jacobi(kept, b, None, weight, sweeps)


def piecewise_correction(x: DataFrame, coarse: DataFrame, agg: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """x plus, for each vertex, the coarse value of its part, times its weight (i, v) if weights are given."""
    step = agg.join(coarse.select(F.col("i").alias("agg_id"), "v"), "agg_id").select(F.col("vid").alias("i"), "v")
    if weights is not None:
        step = step.join(weights.select("i", F.col("v").alias("_w")), "i").select("i", (F.col("v") * F.col("_w")).alias("v"))
    return axpby(1.0, x, 1.0, step)
