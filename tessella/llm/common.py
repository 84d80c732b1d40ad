"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, numbered
from ..plans.lineage import discard, written

__all__ = ["LOWEST", "components", "discard", "groups", "keyed", "read", "run_starts", "texts", "utf8", "written"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column end to end, and the offsets of its rows (null: empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first `keys` (integer) columns, cut so that no run of equal keys is divided.

    Only the last run of a batch is carried, so a run is held whole; callers bound the length of a run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in range(keys):
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
            if held:
                new[0] |= held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(batch)
            continue
        if held or cuts[-1]:
            yield joined([*held, batch.slice(0, int(cuts[-1]))])
        held = [batch.slice(int(cuts[-1]))]
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [x for x in parts if x.num_rows] or parts[:1]
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, with the length at the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


LOWEST = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, tie, doc_id, text): key is doc_id (null: the lowest long) and (key, tie) tells every row from the others.

    tie is 0 unless a doc_id comes more than once; then rows are numbered in the order of key and text, by ranges, so rows
    of one id (or of none) need not meet in one task.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return rows.select("key", F.lit(0).cast("long").alias("tie"), "doc_id", "text")
    return numbered(rows, ["key", "text"], "tie").select("key", "tie", "doc_id", "text")
