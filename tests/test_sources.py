import struct

import numpy as np
import pytest

from tessella.operators import mesh
from tessella.sources import matlab, meshes

TRI = ([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 1.0, 0.0]], [[0, 1, 2], [0, 2, 3]])


def test_ascii_ply_of_a_square(spark, tmp_path):
    m = 50
    points = "".join(f"{k % m / (m - 1):g} {k // m / (m - 1):g} 0\n" for k in range(m * m))
    faces = "".join(f"3 {k} {k + 1} {k + m + 1}\n3 {k} {k + m + 1} {k + m}\n" for k in range(m * (m - 1)) if k % m < m - 1)
    head = f"ply\nformat ascii 1.0\nelement vertex {m * m}\nproperty float x\nproperty float y\nproperty float z\nelement face 4802\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head + points + faces)
    v, t = meshes.read_triangles(spark, str(tmp_path / "a.ply"))
    e = mesh.neighbors(t)
    assert (v.count(), t.count(), e.count()) == (2500, 4802, 2 * 7301)
    assert tuple(mesh.valence_stats(e).first()) == (2, 6, 5)
    assert max(r.ratio for r in mesh.radius_edge(t, v).collect()) == pytest.approx(0.70711, abs=1e-4)


def test_nodes_and_elements(spark, tmp_path):
    k = 4
    nodes = "".join(f"{i + 1} {i % k} {i // k % k} {i // (k * k)}\n" for i in range(k**3))
    corners = [i for i in range(k**3) if i % k < k - 1 and i // k % k < k - 1 and i // (k * k) < k - 1]
    steps = [(1, 1 + k), (1, 1 + k * k), (k, k + 1), (k, k + k * k), (k * k, k * k + 1), (k * k, k * k + k)]
    cells = [(i, i + a, i + b, i + 1 + k + k * k) for i in corners for a, b in steps]
    (tmp_path / "a.node").write_text(f"{k**3} 3 0 0\n# comment\n\n{nodes}")
    for base in (0, 1):
        for label in (0, 1):
            lines = "".join(" ".join(map(str, [n + 1, *(c + base for c in cell), *([n % 3] if label else [])])) + "\n" for n, cell in enumerate(cells))
            (tmp_path / "a.ele").write_text(f"{len(cells)} 4 {label}\n{lines}")
            v, t = meshes.read_tets(spark, str(tmp_path / "a.node"), str(tmp_path / "a.ele"))
            assert [tuple(r) for r in t.orderBy("cid").collect()] == [(n, *cell, n % 3 if label else 0) for n, cell in enumerate(cells)]
    m = mesh.tet_measures(t, v)
    assert m.where("ratio < 0").count() == len(cells) // 2 and m.agg({"volume": "sum"}).first()[0] == pytest.approx(27)
    (tmp_path / "a.ele").write_text("2 4 0\n1 0 1 2 3\n")
    with pytest.raises(ValueError, match="fewer than 2"):
        meshes.read_elements(spark, str(tmp_path / "a.ele"))


def same(got):
    points, faces = got
    assert np.allclose(points, TRI[0]) and meshes.triangles(points, faces) == TRI[1]


def test_text_formats():
    p, f = TRI
    same(meshes.parse_obj(b"# x\n" + b"".join(b"v %g %g %g\n" % tuple(x) for x in p) + b"f 1 2 3\nf -4/1 -2/1 -1/1\n"))
    same(meshes.parse_off(b"OFF\n4 2 0\n" + b"".join(b"%g %g %g\n" % tuple(x) for x in p) + b"".join(b"3 %d %d %d\n" % tuple(x) for x in f)))
    same(meshes.parse_sm(b"4\n" + b"".join(b"%g %g %g\n" % tuple(x) for x in p) + b"2\n" + b"".join(b"%d %d %d\n" % tuple(x) for x in f)))
    same(meshes.parse_ray(b"".join(b"#vertex %g %g %g 0 0 1\n" % tuple(x) for x in p) + b"".join(b"#shape_triangle 0 %d %d %d\n" % tuple(x) for x in f)))


def test_range_grid():
    head = b"ply\nformat ascii 1.0\nobj_info num_cols 3\nobj_info num_rows 2\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement range_grid 6\nproperty list uchar int vertex_indices\nend_header\n"
    points, faces = meshes.parse_ply(head + b"0 0 0\n1 0 0\n2 0 0\n0 1 0\n1 1 0\n" + b"1 0\n1 1\n1 2\n1 3\n1 4\n0\n")
    assert len(points) == 5 and faces == [[0, 1, 4, 3], [1, 2, 4]]


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_ply(spark, tmp_path, order):
    name = {"<": "little", ">": "big"}[order]
    head = f"ply\nformat binary_{name}_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack(order + "fffB", *x, 9) for x in TRI[0]) + b"".join(struct.pack(order + "Biii", 3, *f) for f in TRI[1])
    same(meshes.parse_ply(head.encode() + body))
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    v, t = meshes.read_triangles(spark, str(tmp_path / "a.ply"))
    assert [tuple(r) for r in t.orderBy("cid").collect()] == [(0, 0, 1, 2), (1, 0, 2, 3)]
    meshes.write_ply(v, t, str(tmp_path / "out"))
    v2, t2 = meshes.read_triangles(spark, str(tmp_path / "out" / "part-*"))
    assert sorted(t2.collect()) == sorted(t.collect()) and sorted(v2.collect()) == sorted(v.collect())


def test_3ds_and_vvd_and_strips():
    pts, faces = np.array(TRI[0]), np.array(TRI[1])
    v = struct.pack("<HIH", 0x4110, 8 + 48, 4) + pts.astype("<f4").tobytes()
    f = struct.pack("<HIH", 0x4120, 8 + 16, 2) + np.column_stack([faces, [0, 0]]).astype("<u2").tobytes()
    same(meshes.parse_3ds(struct.pack("<HI", 0x4D4D, 0) + struct.pack("<HI", 0x3D3D, 0) + struct.pack("<HI", 0x0001, 8) + b"xx" + struct.pack("<HI", 0x4000, 0) + b"n\0" + struct.pack("<HI", 0x4100, 0) + v + f))
    same(meshes.parse_vvd(b"V".ljust(127) + struct.pack(">i", 4) + pts.astype(">f8").tobytes() + struct.pack(">i", 2) + b"".join(struct.pack(">iiii", 3, *x) for x in TRI[1])))
    assert meshes._strips([0, 1, 2, 3, -1, 4, 5, 6]) == [[0, 1, 2], [2, 1, 3], [4, 5, 6]]
    with pytest.raises(ValueError):
        meshes.kind_of(b"\0")


def test_matlab(spark, tmp_path):
    i, j, v = np.array([0, 2, 1]), np.array([0, 1, 2]), np.array([1.5, -2.0, 3.0])
    (tmp_path / "a.mat").write_bytes(matlab.sparse_bytes(i, j, v, 3))
    a = matlab.read_sparse(spark, str(tmp_path / "a.mat"))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 1.5), (1, 2, 3.0), (2, 1, -2.0)]
    x = spark.createDataFrame([(1, 2.0), (0, 1.0)], "i long, v double")
    matlab.write_vector(x, str(tmp_path / "x.mat"))
    assert sorted(map(tuple, matlab.read_vector(spark, str(tmp_path / "x.mat")).collect())) == [(0, 1.0), (1, 2.0)]
    with pytest.raises(ValueError):
        matlab.parse_sparse((tmp_path / "x.mat").read_bytes())


def test_vtk(spark, tmp_path):
    v = spark.createDataFrame([(k, *p) for k, p in enumerate(TRI[0])], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(k, *f) for k, f in enumerate(TRI[1])], "cid long, v0 long, v1 long, v2 long")
    meshes.write_vtk(v, t, v.selectExpr("vid as i", "x as v"), str(tmp_path / "vtk"))
    lines = next((tmp_path / "vtk").glob("part-*")).read_text().splitlines()
    assert lines[4] == "POINTS 4 float" and "CELLS 2 8" in lines and lines.count("5") == 2 and lines[-1] == "0.0"


def test_elements_keep_unused_first_vertices(spark, tmp_path):
    for first, want in ((0, 0), (1, 0), (2, 0), (3, 2), (7, 6)):
        (tmp_path / "b.ele").write_text(f"2 4 0\n1 {first} {first + 1} {first + 2} {first + 3}\n2 {first + 1} {first + 2} {first + 3} {first + 4}\n")
        got = [tuple(r)[1:5] for r in meshes.read_elements(spark, str(tmp_path / "b.ele")).orderBy("cid").collect()]
        assert got == [(want, want + 1, want + 2, want + 3), (want + 1, want + 2, want + 3, want + 4)]


def test_ply_attributes(spark, tmp_path):
    kinds = [("float", c) for c in ("x", "y", "z", "nx", "ny", "nz")] + [("uchar", c) for c in ("red", "green", "diffuse_blue")] + [("float", "confidence")]
    head = "".join(f"property {t} {c}\n" for t, c in kinds)
    rows = [(0, 0, 0, 0, 0, 1, 255, 0, 51, 0.5), (1, 0, 0, 1, 0, 0, 0, 102, 255, 1)]
    for form, body in (
        ("ascii", "".join(" ".join(map(str, r)) + "\n" for r in rows).encode()),
        ("binary_big_endian", b"".join(struct.pack(">6f3Bf", *r) for r in rows)),
    ):
        (tmp_path / "c.ply").write_bytes(f"ply\nformat {form} 1.0\nelement vertex 2\n{head}element face 0\nproperty list uchar int vertex_indices\nend_header\n".encode() + body)
        got = [tuple(r) for r in meshes.read_ply_attributes(spark, str(tmp_path / "c.ply")).orderBy("vid").collect()]
        assert got == [(0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.2, 0.5), (1, 1.0, 0.0, 0.0, 0.0, 0.4, 1.0, 1.0)]
    (tmp_path / "d.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 0\n")
    assert tuple(meshes.read_ply_attributes(spark, str(tmp_path / "d.ply")).first()) == (0, *[None] * 7)


@pytest.mark.parametrize("kind", ["ply", "obj", "off", "sm", "ray"])
def test_written_meshes_are_read_again(spark, tmp_path, kind):
    v = spark.createDataFrame([(k, *p) for k, p in enumerate(TRI[0])], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(k, *f) for k, f in enumerate(TRI[1])], "cid long, v0 long, v1 long, v2 long")
    meshes.write_mesh(v, t, str(tmp_path / kind), kind)
    points, tris = meshes.read_triangles(spark, str(next((tmp_path / kind).glob("part-*"))))
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, v.collect())) and sorted(map(tuple, tris.collect())) == sorted(map(tuple, t.collect()))
    with pytest.raises(ValueError, match="unknown kind"):
        meshes.write_mesh(v, t, str(tmp_path / "x"), "gif")


def test_side_files_and_patterns(spark, tmp_path):
    from tessella.operators import sparse

    meshes.write_values(spark.createDataFrame([(2, 7), (1, 5), (3, 6)], "vid long, valence long"), "vid", "valence", str(tmp_path / "valence"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "valence").glob("part-*"))) == "5\n7\n6\n"
    a = spark.createDataFrame([(0, 0, 2.0)], "i long, j long, v double")
    full = sparse.on_pattern(a, spark.createDataFrame([(0, 0), (0, 1)], "i long, j long"))
    assert {(r.i, r.j): r.v for r in full.collect()} == {(0, 0): pytest.approx(2.0), (0, 1): pytest.approx(1e-12)}


def test_command_line(spark, tmp_path, capsys):
    from tessella.__main__ import main

    m = 5
    v = spark.createDataFrame([(k, float(k % m), float(k // m), 0.0) for k in range(m * m)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([x for k in range(m * (m - 1)) if k % m < m - 1 for x in ((2 * k, k, k + 1, k + m + 1), (2 * k + 1, k, k + m + 1, k + m))], "cid long, v0 long, v1 long, v2 long")
    meshes.write_mesh(v, t, str(tmp_path / "mesh"), "ply")
    b = v.selectExpr("vid as i", "1.0D as v")
    matlab.write_vector(b, str(tmp_path / "b.mat"))
    main(["-i", str(next((tmp_path / "mesh").glob("part-*"))), "-b", str(tmp_path / "b.mat"), "-o", str(tmp_path / "out"), "-v"])
    assert "rounds" in capsys.readouterr().out and len(list((tmp_path / "out").glob("part-*"))) == 1
