"""Readers and writers of mesh files.

Line formats that can be cut anywhere (node and element files) are read by Spark's text reader in parallel and numbered
over ranges of lines. Formats that only make sense from their start (PLY, OBJ, OFF, SM, RAY, 3DS, VVD) are parsed whole
in one worker for each file, from `binaryFile`, so any store that Spark reads will do; a file must fit in a worker.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import numbered

Mesh = tuple[DataFrame, DataFrame]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Split lines with text, comments left out, in order: at, f (fields)."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", "#.*", "")).alias("line"))
    return text.where("line <> ''").select("at", F.split("line", r"\s+").alias("f"))


def _body(lines: DataFrame, name: str, least: int) -> tuple[list[str], DataFrame]:
    """The header and the rows after it, numbered from 0 in the order of the file; fewer than the header says is an error."""
    head = lines.orderBy("at").first()
    if head is None or not all(re.fullmatch(r"[+-]?\d+", x) for x in head["f"]):
        raise ValueError(f"{name} file has no header of whole numbers")
    body = numbered(lines.where(F.col("at") > head["at"]), ["at"], "row")
    bad = body.where(F.size("f") < least).first()
    if bad is not None:
        raise ValueError(f"{name} file: too few fields in row {bad['row']}")
    n = int(head["f"][0])
    body = body.where(F.col("row") < n)
    if body.count() != n:
        raise ValueError(f"{name} file has fewer than {n} rows")
    return head["f"], body


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(vid, x, y, z) of a node file. The id in the file is not looked at: rows are numbered from 0."""
    _, body = _body(_lines(spark, path), "node", 4)
    return body.select(F.col("row").alias("vid"), *[F.get("f", F.lit(k)).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(cid, v0, v1, v2, v3, mat) of an element file; mat is 0 where the header announces no label.

    Ids count from 0 if any is 0, else from 1, or from 2 if none is below 2. So vertices that no element uses, at the start of
    the node file, keep their places.
    """
    head, body = _body(_lines(spark, path), "element", 5)
    label = F.get("f", F.lit(5)).cast("int") if len(head) > 2 and head[2] == "1" else F.lit(0)
    rows = body.select(F.col("row").alias("cid"), *[F.get("f", F.lit(k + 1)).cast("long").alias(f"v{k}") for k in range(4)], F.coalesce(label, F.lit(0)).alias("mat"))
    low = rows.agg(F.min(F.least("v0", "v1", "v2", "v3"))).first()[0] or 0
    base = low if low <= 2 else 1
    return rows.select("cid", *[(F.col(f"v{k}") - base).alias(f"v{k}") for k in range(4)], "mat") if base else rows


def read_tets(spark: SparkSession, nodes: str, elements: str) -> Mesh:
    return read_nodes(spark, nodes), read_elements(spark, elements)


def kind_of(data: bytes) -> str:
    """Format by the first bytes."""
    if data[:3] == b"ply":
        return "ply"
    if data[:2] == b"MM":
        return "3ds"
    if data[:1] == b"V":
        return "vvd"
    if data[:3] == b"OFF":
        return "off"
    if data[:1] == b"#" and re.search(rb"^#(vertex|shape)", data, re.M):
        return "ray"
    if data[:1] in (b"v", b"#", b"u", b"f", b"g", b"s", b"o"):
        return "obj"
    if data[:1].isdigit():
        return "sm"
    raise ValueError("unknown kind of mesh file")


PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _strips(ids: list[int]) -> list[list[int]]:
    """Triangles of strips that -1 ends; every other one is turned round."""
    out, run = [], []
    for v in [*ids, -1]:
        if v >= 0:
            run.append(v)
            if len(run) > 2:
                a, b, c = run[-3:]
                out.append([a, b, c] if len(run) % 2 else [b, a, c])
        else:
            run = []
    return out


#: Attributes of PLY vertices that are kept, and other names for them.
ATTRIBUTES = ("nx", "ny", "nz", "red", "green", "blue", "confidence")
ALIASES = {"diffuse_red": "red", "diffuse_green": "green", "diffuse_blue": "blue"}


def parse_ply(data: bytes) -> tuple[np.ndarray, list]:
    return parse_ply_attributes(data)[:2]


def parse_ply_attributes(data: bytes) -> tuple[np.ndarray, list, dict[str, np.ndarray]]:
    """ASCII and binary of either byte order; faces, triangle strips and range grids; and the ATTRIBUTES of the vertices,
    colours of whole numbers as shares of 255."""
    end = data.index(b"end_header")
    end = data.index(b"\n", end) + 1
    header = [x.split() for x in data[:end].decode("latin-1").splitlines()]
    form = next(x[1] for x in header if x[:1] == ["format"])
    grid = [int(x[2]) for x in header if x[:2] in (["obj_info", "num_cols"], ["obj_info", "num_rows"])]
    elements: list[tuple[str, int, list]] = []
    for x in header:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    order, at, fields = ("<" if "little" in form else ">"), end, None
    if form == "ascii":
        fields, at = data[end:].split(), 0
    points, faces, cells, more = np.zeros((0, 3)), [], [], {}
    for name, count, props in elements:
        plain = all(p[0] != "list" for p in props)
        names = [p[-1] for p in props]
        if plain and fields is None:
            table = np.frombuffer(data, np.dtype([(n, order + PLY_TYPES[p[0]]) for n, p in zip(names, props, strict=True)]), count, at)
            at += table.nbytes
            rows = {n: table[n].astype(float) for n in names}
        elif plain:
            table = np.array(fields[at : at + count * len(props)], float).reshape(count, -1)
            at += table.size
            rows = {n: table[:, k] for k, n in enumerate(names)}
        else:
            rows = {n: [] for n in names}
            for _ in range(count):
                for p in props:
                    if fields is None:
                        kinds = [order + PLY_TYPES[t] for t in (p[1:3] if p[0] == "list" else p[:1])]
                        n = int(np.frombuffer(data, kinds[0], 1, at)[0]) if p[0] == "list" else 1
                        at += np.dtype(kinds[0]).itemsize if p[0] == "list" else 0
                        got = np.frombuffer(data, kinds[-1], n, at).tolist()
                        at += n * np.dtype(kinds[-1]).itemsize
                    else:
                        n = int(fields[at]) if p[0] == "list" else 1
                        at += p[0] == "list"
                        got = [int(float(v)) for v in fields[at : at + n]]
                        at += n
                    rows[p[-1]].append([int(v) for v in got])
        if name == "vertex":
            points = np.column_stack([rows["x"], rows["y"], rows["z"]]) if count else points
            for p in props:
                known = ALIASES.get(p[-1], p[-1])
                if known in ATTRIBUTES:
                    values = np.asarray(rows[p[-1]], float)
                    more[known] = values / 255 if known in ("red", "green", "blue") and PLY_TYPES[p[0]][0] != "f" else values
        elif name == "face":
            faces = next((rows[k] for k in ("vertex_indices", "vertex_index") if k in rows), [])
        elif name == "tristrips":
            faces = [t for ids in rows[names[0]] for t in _strips(ids)]
        elif name == "range_grid":
            cells = [r[0] if r else -1 for r in rows[names[0]]]
    if cells and len(grid) == 2:
        cols, n_rows = grid
        for r in range(n_rows - 1):
            for c in range(cols - 1):
                square = [cells[k] for k in (r * cols + c, r * cols + c + 1, (r + 1) * cols + c + 1, (r + 1) * cols + c)]
                there = [k for k in square if k >= 0]
                if len(there) > 2:
                    faces.append(there)
    return points, [list(f) for f in faces], more


def parse_obj(data: bytes) -> tuple[np.ndarray, list]:
    points, faces = [], []
    for line in data.decode("latin-1").splitlines():
        f = line.split("#")[0].split()
        if f[:1] == ["v"]:
            points.append([float(x) for x in f[1:4]])
        elif f[:1] in (["f"], ["t"]):
            ids = [int(x.split("/")[0]) for x in f[1:]]
            faces.append([i - 1 if i > 0 else len(points) + i for i in ids])
    return np.array(points, float).reshape(-1, 3), faces


def parse_off(data: bytes) -> tuple[np.ndarray, list]:
    f = re.sub(rb"#.*", b"", data).split()[1:]
    n, m = int(f[0]), int(f[1])
    points, at, faces = np.array(f[3 : 3 + 3 * n], float).reshape(-1, 3), 3 + 3 * n, []
    for _ in range(m):
        k = int(f[at])
        faces.append([int(x) for x in f[at + 1 : at + 1 + k]])
        at += 1 + k
    return points, faces


def parse_sm(data: bytes) -> tuple[np.ndarray, list]:
    f = data.split()
    n = int(f[0])
    at = 1 + 3 * n
    m = int(f[at])
    return np.array(f[1:at], float).reshape(-1, 3), np.array(f[at + 1 : at + 1 + 3 * m], int).reshape(-1, 3).tolist()


def parse_ray(data: bytes) -> tuple[np.ndarray, list]:
    points, faces, f, at = [], [], data.decode("latin-1").split(), 0
    while at < len(f):
        if f[at] == "#vertex":
            points.append([float(x) for x in f[at + 1 : at + 4]])
        elif f[at] == "#shape_triangle":
            faces.append([int(x) for x in f[at + 2 : at + 5]])
        at += 1
    return np.array(points, float).reshape(-1, 3), faces


def parse_3ds(data: bytes) -> tuple[np.ndarray, list]:
    """Chunks of vertices (0x4110) and faces (0x4120); a mesh's faces count from its first vertex."""
    points, faces, base, at = [], [], 0, 0
    while at + 6 <= len(data):
        kind, size = struct.unpack_from("<HI", data, at)
        if kind in (0x4D4D, 0x3D3D, 0x4100):
            at += 6
        elif kind == 0x4000:
            at = data.index(b"\0", at + 6) + 1
        elif kind == 0x4110:
            n = struct.unpack_from("<H", data, at + 6)[0]
            base = len(points)
            points += np.frombuffer(data, "<f4", 3 * n, at + 8).reshape(-1, 3).astype(float).tolist()
            at += size
        elif kind == 0x4120:
            n = struct.unpack_from("<H", data, at + 6)[0]
            faces += (np.frombuffer(data, "<u2", 4 * n, at + 8).reshape(-1, 4)[:, :3].astype(int) + base).tolist()
            at += size
        else:
            at += max(size, 6)
    return np.array(points, float).reshape(-1, 3), faces


def parse_vvd(data: bytes) -> tuple[np.ndarray, list]:
    """Big-endian: 127 bytes, the number of vertices, their doubles, the number of polygons, each with its count."""
    at = 127
    n = struct.unpack_from(">i", data, at)[0]
    points = np.frombuffer(data, ">f8", 3 * n, at + 4).reshape(-1, 3).astype(float)
    at += 4 + 24 * n
    m = struct.unpack_from(">i", data, at)[0]
    at, faces = at + 4, []
    for _ in range(m):
        k = struct.unpack_from(">i", data, at)[0]
        faces.append(np.frombuffer(data, ">i4", k, at + 4).astype(int).tolist())
        at += 4 + 4 * k
    return points, faces


PARSERS = {"ply": parse_ply, "obj": parse_obj, "off": parse_off, "sm": parse_sm, "ray": parse_ray, "3ds": parse_3ds, "vvd": parse_vvd}


def triangles(points: np.ndarray, faces: list) -> list[list[int]]:
    """Triangles as they are, quads by the shorter diagonal, more corners as a fan; ids that start beyond 0 are moved."""
    flat = [v for f in faces for v in f]
    low = min(flat, default=0)
    if low and max(flat) - low + 1 <= len(points) and max(flat) >= len(points):
        faces = [[v - low for v in f] for f in faces]
    out = []
    for f in faces:
        if len(f) == 4 and not np.linalg.norm(points[f[0]] - points[f[2]]) < np.linalg.norm(points[f[1]] - points[f[3]]):
            out += [[f[0], f[1], f[3]], [f[1], f[2], f[3]]]
        else:
            out += [[f[0], f[k], f[k + 1]] for k in range(1, len(f) - 1)]
    return out


def read_triangles(spark: SparkSession, path: str, kind: str | None = None) -> Mesh:
    """vertices and tris of a mesh file of any of PARSERS; without kind its first bytes tell."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                points, faces = PARSERS[kind or kind_of(data)](data)
                tris = triangles(points, faces)
                n, m = len(points), len(tris)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * n + [1] * m, pa.int32()), pa.array([*range(n), *range(m)], pa.int64()), *(pa.array([*points[:, k].tolist(), *[None] * m], pa.float64()) for k in range(3)), *(pa.array([*[None] * n, *[t[k] for t in tris]], pa.int64()) for k in range(3))],
                    names=["kind", "k", "x", "y", "z", "v0", "v1", "v2"],
                )

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "kind int, k long, x double, y double, z double, v0 long, v1 long, v2 long")
    return rows.where("kind = 0").select(F.col("k").alias("vid"), "x", "y", "z"), rows.where("kind = 1").select(F.col("k").alias("cid"), "v0", "v1", "v2")


def read_ply_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(vid, nx, ny, nz, red, green, blue, confidence) of a PLY file's vertices; null where the file has no such property."""
    names = ["vid", *ATTRIBUTES]

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                points, _, more = parse_ply_attributes(data)
                cols = [pa.array(more[c], pa.float64()) if c in more else pa.nulls(len(points), pa.float64()) for c in ATTRIBUTES]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), *cols], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "vid long, " + ", ".join(f"{c} double" for c in ATTRIBUTES))


def _text(spark: SparkSession, parts: list[DataFrame], path: str) -> None:
    """Parts of (k, line), in order, as one text file."""
    rows = None
    for p, df in enumerate(parts):
        df = df.select(F.lit(p).alias("p"), F.col("k").cast("long").alias("k"), "line")
        rows = df if rows is None else rows.union(df)
    rows.orderBy("p", "k").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_ply(vertices: DataFrame, tris: DataFrame, path: str) -> None:
    """An ASCII PLY, in a folder with one part file."""
    spark = vertices.sparkSession
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *(f"property float {c}" for c in "xyz"), f"element face {tris.count()}", "property list uchar int vertex_indices", "end_header"]
    _text(spark, [spark.createDataFrame(list(enumerate(head)), "k long, line string"), vertices.select(F.col("vid").alias("k"), F.concat_ws(" ", "x", "y", "z").alias("line")), tris.select(F.col("cid").alias("k"), F.concat_ws(" ", F.lit(3), "v0", "v1", "v2").alias("line"))], path)


def write_mesh(vertices: DataFrame, tris: DataFrame, path: str, kind: str = "ply") -> None:
    """A text file of the kind ply, obj, off, sm or ray, in a folder with one part file."""
    if kind == "ply":
        return write_ply(vertices, tris, path)
    spark = vertices.sparkSession
    heads = {"off": ["OFF", f"{vertices.count()} {tris.count()} 0"], "sm": [str(vertices.count())], "obj": ["# vertices and faces"], "ray": ["#vertices and triangles"]}
    if kind not in heads:
        raise ValueError(f"unknown kind of mesh file: {kind}")
    points = {"obj": "v ", "ray": "#vertex "}.get(kind, "")
    first = 1 if kind == "obj" else 0
    cells = {"obj": "f ", "off": "3 ", "ray": "#shape_triangle 0 "}.get(kind, "")
    lines = lambda xs: spark.createDataFrame(list(enumerate(xs)), "k long, line string")
    parts = [lines(heads[kind]), vertices.select(F.col("vid").alias("k"), F.concat(F.lit(points), F.concat_ws(" ", "x", "y", "z")).alias("line"))]
    if kind == "sm":
        parts.append(lines([str(tris.count())]))
    corners = F.concat_ws(" ", *[(F.col(c) + first).cast("string") for c in ("v0", "v1", "v2")])
    _text(spark, [*parts, tris.select(F.col("cid").alias("k"), F.concat(F.lit(cells), corners).alias("line"))], path)


def write_vtk(vertices: DataFrame, cells: DataFrame, values: DataFrame, path: str, name: str = "traveltime") -> None:
    """A legacy ASCII VTK grid with one scalar (i, v) for each vertex, in a folder with one part file."""
    spark = vertices.sparkSession
    corners = [c for c in ("v0", "v1", "v2", "v3") if c in cells.columns]
    n, m, k = vertices.count(), cells.count(), len(corners)
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "k long, line string")
    _text(
        spark,
        [
            lines("# vtk DataFile Version 3.0", "vtk output", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} float"),
            vertices.select(F.col("vid").alias("k"), F.concat_ws(" ", "x", "y", "z").alias("line")),
            lines(f"CELLS {m} {m * (k + 1)}"),
            cells.select(F.col("cid").alias("k"), F.concat_ws(" ", F.lit(k), *corners).alias("line")),
            lines(f"CELL_TYPES {m}"),
            cells.select(F.col("cid").alias("k"), F.lit("10" if k == 4 else "5").alias("line")),
            lines(f"POINT_DATA {n}", f"SCALARS {name} float 1", "LOOKUP_TABLE default"),
            values.select(F.col("i").alias("k"), F.col("v").cast("string").alias("line")),
        ],
        path,
    )


def write_values(rows: DataFrame, order: str, value: str, path: str) -> None:
    """One value a line, in order: valences or ratios, never written unless asked for."""
    rows.orderBy(order).select(F.col(value).cast("string")).write.mode("overwrite").text(path)
