"""MAT version 5 files, uncompressed: sparse matrices and dense vectors.

A file is read through Spark's `binaryFile`, so any store will do, and parsed in one task, which it must fit.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, SPARSE, DOUBLE = 14, 15, 5, 6


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type, content and the place of the next element; small elements hold up to four bytes in their tag."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + (size + 7) // 8 * 8


def _parts(data: bytes) -> tuple[str, int, list[tuple[int, bytes]]]:
    """Byte order, class and parts (after the flags) of the first matrix."""
    if len(data) < 136:
        raise ValueError("not a MAT file")
    order = "<" if data[126:128] == b"IM" else ">"
    kind, body, _ = _element(data, 128, order)
    if kind == COMPRESSED:
        raise ValueError("compressed MAT files are not read; save with -v6")
    if kind != MATRIX:
        raise ValueError("the first element is not a matrix")
    at, parts = 0, []
    while at < len(body):
        k, content, at = _element(body, at, order)
        parts.append((k, content))
    return order, parts[0][1][0 if order == "<" else 3], parts[1:]


def _numbers(part: tuple[int, bytes], order: str) -> np.ndarray:
    if part[0] not in TYPES:
        raise ValueError(f"unknown data type {part[0]}")
    return np.frombuffer(part[1], order + TYPES[part[0]])


def parse_sparse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values, sorted by row and column."""
    order, kind, parts = _parts(data)
    if kind != SPARSE:
        raise ValueError("the matrix is not sparse")
    rows, starts, values = (_numbers(p, order) for p in parts[2:5])
    n = int(starts[-1])
    cols = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    by = np.lexsort((cols, rows[:n]))
    return rows[:n][by].astype(np.int64), cols[by].astype(np.int64), values[:n][by].astype(float)


def parse_vector(data: bytes) -> np.ndarray:
    order, kind, parts = _parts(data)
    if kind != DOUBLE:
        raise ValueError("the matrix is not of doubles")
    return _numbers(parts[2], order).astype(float)


ROWS = 1 << 16  #: numbers of a batch


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                columns = parse(bytes(data))
                for at in range(0, len(columns[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in columns], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_sparse, "i long, j long, v double")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        values = parse_vector(data)
        return np.arange(len(values)), values

    return _read(spark, path, parse, "i long, v double")


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _vector_head(n: int, name: str) -> bytes:
    tag = lambda kind, data: struct.pack("<II", kind, len(data)) + _pad(data)
    body = tag(6, struct.pack("<II", DOUBLE, 0)) + tag(5, struct.pack("<ii", n, 1)) + tag(1, name.encode()) + struct.pack("<II", 9, 8 * n)
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", MATRIX, len(body) + 8 * n) + body


def vector_bytes(values: np.ndarray, name: str = "x_h") -> bytes:
    return _vector_head(len(values), name) + np.asarray(values, "<f8").tobytes()


def sparse_bytes(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, name: str = "A") -> bytes:
    tag = lambda kind, data: struct.pack("<II", kind, len(data)) + _pad(data)
    by = np.lexsort((i, j))
    starts = np.searchsorted(j[by], np.arange(n + 1))
    body = tag(6, struct.pack("<II", SPARSE, len(v))) + tag(5, struct.pack("<ii", n, n)) + tag(1, name.encode()) + tag(5, i[by].astype("<i4").tobytes()) + tag(5, starts.astype("<i4").tobytes()) + tag(9, v[by].astype("<f8").tobytes())
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", MATRIX, len(body)) + body


def write_vector(x: DataFrame, path: str, name: str = "x_h") -> None:
    """A vector (i, v) in order of i as a double column, in any store; the driver holds a partition of it at a time."""
    spark = x.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(_vector_head(x.count(), name)))
        held = []
        for row in x.orderBy("i").select("v").toLocalIterator():
            held.append(row[0])
            if len(held) == ROWS:
                out.write(bytearray(np.array(held, "<f8").tobytes()))
                held = []
        if held:
            out.write(bytearray(np.array(held, "<f8").tobytes()))
    finally:
        out.close()
