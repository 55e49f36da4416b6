"""Hand-derived values for rasters, points, meshes, formats and tiles, and empty or odd inputs."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesalith.functions import codec, geom, grid, mercator, text
from mesalith.functions.grid import Meta
from mesalith.operators import dense, kernels, mesh, points, quality, raster, tiles
from mesalith.sources import binary
from mesalith.sources import text as files


def cells(spark, z):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "row int, col int, z double"), Meta(len(z[0]) if z else 0, len(z))


def as_dict(df):
    return {(r["row"], r["col"]): r["z"] for r in df.collect()}


def test_bbox_is_of_cell_centres():
    m = Meta(798, 212, 11.024, -334.242, 1.341)
    x0, y0, x1, y1 = m.bbox
    assert math.isclose(x1 - x0, 797 * 1.341) and math.isclose(y1 - y0, 211 * 1.341)


def test_coordinates_are_inverse(spark):
    m = Meta(7, 21, 11.0, -334.0, 1.341)
    g = raster.grid_cells(spark, m)
    back = g.select("row", "col", grid.y_to_row(grid.row_to_y(F.col("row"), m), m).alias("r"), grid.x_to_col(grid.col_to_x(F.col("col"), m), m).alias("c")).collect()
    assert len(back) == 147 and all((b.row, b.col) == (b.r, b.c) for b in back)


def test_downsample_of_ones(spark):
    m = Meta(8, 10)
    out, n = raster.downsample(raster.constant(spark, m, 1.0), m, 2)
    assert set(as_dict(out).values()) == {1.0} and out.count() == 20 and (n.width, n.height) == (4, 5)


def test_crop(spark):
    df, m = cells(spark, [[10 * r + c for c in range(5)] for r in range(6)])
    a, am = raster.crop(df, m, 0, 0, 3, 4)
    b, bm = raster.crop_ll(df, m, 0, 2, 3, 4)
    assert as_dict(a) == as_dict(b) and am == bm and (am.width, am.height, am.pos_x, am.pos_y) == (3, 4, 0.0, 2.0)
    df, m = cells(spark, [[r * c for c in range(10)] for r in range(23)])
    m = m.moved(cell_size=0.3, pos_x=-14.0, pos_y=18.0)
    assert as_dict(raster.crop(df, m, -5, -5, 300, 300)[0]) == as_dict(df)
    off, om = raster.crop(df, m, 5, 7, 300, 500)
    assert as_dict(off)[0, 0] == 35 and (om.width, om.height) == (5, 16)
    for box in ((-20, 0, 5, 5), (100, 0, 5, 5), (0, 100, 5, 5)):
        none, nm = raster.crop(df, m, *box)
        assert none.count() == 0 and nm.width * nm.height == 0


def test_raster_to_vertices(spark):
    df, m = cells(spark, [[r * 10 + c for c in range(10)] for r in range(10)])
    p = {(r.x, r.y): r.z for r in raster.to_points(df, m.moved(pos_x=10.0, pos_y=10.0), corner=True).collect()}
    assert p[10.0, 10.0] == 90 and p[19.0, 19.0] == 9


def test_points_to_raster(spark):
    pts = spark.createDataFrame([(float(x), float(y), float(y * 100 + x)) for x in range(100, 140) for y in range(100, 160)], "x double, y double, z double")
    out, m = points.to_raster(pts)
    got = as_dict(out)
    assert (m.width, m.height) == (40, 60) and got[0, 0] == 159 * 100 + 100 and got[59, 0] == 10100 and got[59, 39] == 10139
    one, m = points.to_raster(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"))
    assert (m.width, m.height) == (1, 1) and as_dict(one) == {(0, 0): 3.0}
    none, m = points.to_raster(pts.limit(0))
    assert none.count() == 0 and m.width == 0


def test_vertex_raster(spark):
    pts = spark.createDataFrame([(float(x), float(y), float(y * 4 + x)) for x in range(4) for y in range(4)], "x double, y double, z double")
    assert all(z == (3 - r) * 4 + c for (r, c), z in as_dict(points.to_vertex_raster(pts)).items())


@pytest.mark.parametrize("step,faces", [(1, 380), (2, 100), (3, 56), (4, 30)])
def test_dense_counts(spark, step, faces):
    m = Meta(11, 20, 42.0, 23.0, 1.5)
    df = raster.constant(spark, m, 1.0).withColumn("z", F.sin(F.col("col")) * F.sin(F.col("row")))
    v, f = dense.dense_mesh(df, m, step)
    assert f.count() == faces
    box = mesh.bbox(v).first()
    assert np.allclose((box.min_x, box.min_y, box.max_x, box.max_y), m.bbox)
    assert mesh.tin_report(v, f, 10.0).first().valid


def test_dense_fills_and_refuses(spark):
    df, m = cells(spark, [[1, None, 3], [4, 5, 6], [7, 8, None]])
    assert dense.dense_mesh(df, m, 1, kernels.ring_fill)[0].where("z is null").count() == 0
    assert dense.dense_mesh(df, m.moved(width=1), 1)[1].count() == 0
    with pytest.raises(ValueError):
        dense.dense_mesh(df, m, 0)
    with pytest.raises(ValueError):
        kernels.mesh_groups(df.withColumn("g", F.lit(0)), m, ("g",), "terra", -1.0)


def tin(spark, vertices, faces):
    return (spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vertices)], "vid long, x double, y double, z double"), spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "fid long, v0 long, v1 long, v2 long"))


SQUARE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1)]
FAN = [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)]


def test_holes_and_squares(spark):
    assert not mesh.has_hole(*tin(spark, SQUARE, FAN)).first().has_hole
    assert mesh.has_hole(*tin(spark, SQUARE, FAN[:3])).first().has_hole
    assert not mesh.is_square(tin(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [])[0]).first().is_square


@pytest.mark.parametrize("vertices,faces,check", [
    (SQUARE, FAN, None), (SQUARE, [(1, 0, 4), *FAN[1:]], "down"), (SQUARE, [(0, 1, 9), *FAN[1:]], "bad_index"), (SQUARE, [*FAN, (1, 1, 4)], "collapsed"),
    ([*SQUARE, (0.5, 0.5, 1)], [*FAN[:3], (3, 0, 5)], "duplicates"), ([*SQUARE, (0.2, 0.3, 1)], FAN, "unused"), ([*SQUARE, (2, 0.2, 0), (2, 0.4, 0), (0.6, 0.3, 0)], [*FAN, (5, 6, 7)], "crossing"),
])
def test_tin_checks(spark, vertices, faces, check):
    r = mesh.tin_report(*tin(spark, vertices, faces), 1.0).first()
    assert r.valid == (check is None) and (check is None or r[check] > 0)


def test_equal_and_add(spark):
    t = mesh.compose(*tin(spark, SQUARE, FAN))
    assert mesh.equal(t, t.select("tid", F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))).first().equal
    assert not mesh.equal(t, mesh.add_triangles(t, t.limit(1))).first().equal
    v, f = mesh.decompose(t)
    assert v.count() == 5 and f.count() == 4 and mesh.equal(t, mesh.compose(v, f)).first().equal
    v, f = mesh.decompose(t.limit(0))
    assert v.count() == f.count() == 0


def test_zigzag_values(spark):
    table = {0: 0, -1: 1, 1: 2, -2: 3, 2: 4, 16383: 32766, 32767: 65534, -32768: 65535}
    df = spark.createDataFrame([(k,) for k in table], "i int").withColumn("u", codec.zigzag(F.col("i")))
    assert {r.i: r.u for r in df.collect()} == table
    assert all(r.i == r.b for r in df.withColumn("b", codec.unzigzag(F.col("u"))).collect())
    assert binary.zigzag(np.array(list(table))).tolist() == list(table.values()) and binary.unzigzag(np.array(list(table.values()))).tolist() == list(table)


def test_zoom_estimates():
    assert mercator.zoom_range(3.91694, 100, 80, 0, 20) == (15, 15)
    assert mercator.zoom_range(3.91694, 4000, 4000)[0] < mercator.zoom_range(3.91694, 4000, 4000)[1] == 15
    assert mercator.zoom_range(3.91694, 4000, 4000, None, 3) == (10, 10)


def test_interpolation_and_degenerate(spark):
    p = lambda x, y, z: geom.point(float(x), float(y), float(z))
    a, b, c = p(0, 0, 1234), p(0, 10, 1234), p(10, 10, 1234)
    row = spark.range(1).select(geom.interpolate(a, b, c, F.lit(0.5), F.lit(0.5)).alias("z"), geom.interpolate(a, b, c, F.lit(5.0), F.lit(0.5)).alias("out"), geom.interpolate(a, a, c, F.lit(0.0), F.lit(0.0)).alias("flat"), geom.plane(a, a, c)[0].alias("p")).first()
    assert row.z == 1234 and row.out is None and row.flat is None and row.p is None


def test_clip_kernel_equals_expressions(spark):
    rng = np.random.default_rng(0)
    t = rng.uniform(-0.6, 1.6, (60, 3, 3))
    t[:5] = np.round(t[:5])
    d, e = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    flip = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0] < 0
    t[flip] = t[flip][:, ::-1]
    mine, source = tiles.clip_arrays(t)
    df = spark.createDataFrame([(i, *(tuple(map(float, q)) for q in x)) for i, x in enumerate(t)], "id int, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    rows = df.select("id", F.explode(geom.clip_to_unit_square(F.array(F.struct("a", "b", "c")))).alias("t")).select("id", "t.*").collect()
    area = lambda q: abs((q[1][0] - q[0][0]) * (q[2][1] - q[0][1]) - (q[1][1] - q[0][1]) * (q[2][0] - q[0][0])) / 2
    for i in range(60):
        own = [q for q, s in zip(mine, source, strict=True) if s == i]
        other = [(r.a, r.b, r.c) for r in rows if r.id == i]
        assert len(own) == len(other) and math.isclose(sum(map(area, own)), sum(map(area, other)), abs_tol=1e-9)
    assert mine.size == 0 or (mine[:, :, :2].min() >= -1e-12 and mine[:, :, :2].max() <= 1 + 1e-12)
    assert len(tiles.clip_arrays(np.zeros((0, 3, 3)))[0]) == 0


def test_rasterise_meta():
    m = quality.mesh_meta((0.5, 0.5, 3.5, 3.5), 4, 4)
    assert m.cell_size == 1.0
    assert math.isclose(quality.mesh_meta((0.5, 0.5, 3.5, 3.5), 10, 10, 4).cell_size, 0.4)


def test_formats(spark, tmp_path):
    assert text.output_format("auto", "a/b.OBJ") == "obj" and text.output_format("geojson", "x") == "geojson"
    with pytest.raises(ValueError):
        text.output_format("auto", "x.tif")
    v, f = tin(spark, [(1e-300, -1e300, 1 / 3), (1, 0, 0), (0, 1, -2.5)], [(0, 1, 2)])
    files.write_mesh(v, f, str(tmp_path / "off"), "off")
    back = files.read_off(spark, str(tmp_path / "off"))
    assert back[1].count() == 1 and math.isclose(back[0].orderBy("vid").first().z, 1 / 3, abs_tol=1e-15)
    (tmp_path / "g.asc").write_text("cellsize 2\nNROWS 2\nncols 3\nxllcorner 1\nyllcorner 5\nNODATA_value -1\n1 2 3\n\n4 -1 nan\n")
    df, m = files.read_asc(spark, str(tmp_path / "g.asc"))
    assert m == Meta(3, 2, 1.0, 5.0, 2.0) and as_dict(df) == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): None, (1, 2): None}
    (tmp_path / "p.xyz").write_text("1 2 3\n\nx\n4\t5   20000\n1 1 nan\n 7 8 -9 extra\n")
    assert [tuple(r) for r in files.read_xyz(spark, str(tmp_path / "p.xyz")).collect()] == [(1, 2, 3), (7, 8, -9)]
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nvn 1 1 1\nv 0 1 2\nf 1/1/1 2//2 3\n")
    v, f = files.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 3 and tuple(f.first()) == (0, 0, 1, 2)
    files.write_mesh(*tin(spark, SQUARE, FAN), str(tmp_path / "j"), "geojson")
    import json

    made = json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*")))
    assert len(made["features"]) == 9 and made["features"][-1]["geometry"]["type"] == "LineString"


def test_geotiff(spark, tmp_path):
    z = np.arange(8000.0).reshape(80, 100)
    z[3, 4] = -3.4028234663852886e38
    m = Meta(100, 80, -13636677.018, 4543905.659, 3.91694, 3857)
    for kind, deflate in (("f8", True), ("f4", False)):
        (tmp_path / "r.tif").write_bytes(binary.encode_tiff(z, m, -3.4028234663852886e38, kind, deflate))
        df, metas = binary.read_geotiff(spark, str(tmp_path / "r.tif"), 3857)
        got = as_dict(df.drop("raster_id"))
        assert got[3, 4] is None and got[79, 99] == 7999 and len(got) == 8000
        r = metas.first()
        assert (r.width, r.height, r.srid) == (100, 80, 3857) and math.isclose(r.pos_y, m.pos_y)
    assert binary.geotiff_points(spark, str(tmp_path / "r.tif")).count() == 7999
    with pytest.raises(ValueError):
        binary.decode_tiff((tmp_path / "r.tif").read_bytes(), 4326)
    data = bytearray(binary.encode_tiff(z, m))
    at = data.index(struct.pack("<ddd", m.cell_size, m.cell_size, 0.0))
    data[at: at + 8] = struct.pack("<d", 9.0)
    with pytest.raises(ValueError):
        binary.decode_tiff(bytes(data))


def test_quantised_tile():
    head = tuple(range(12))
    data = binary.encode_tile(np.array(SQUARE, float), np.array(FAN), head)
    assert len(data) > 88
    back, p, f, edges = binary.decode_tile(data)
    assert back[3:5] == (3.0, 4.0) and len(f) == 4 and np.abs(p[f] - np.array(SQUARE)[np.array(FAN)]).max() <= 1 / 32767
    assert [len(e) for e in edges] == [2, 2, 2, 2]
    assert binary.decode_tile(b"")[0] == ()


def test_flat_and_empty_tiles(spark):
    v, f = tin(spark, [(0, 0, 5), (500, 0, 5), (500, 500, 5), (0, 500, 5)], [(0, 1, 2), (0, 2, 3)])
    out = tiles.tile_triangles(mesh.compose(v, f), 15)
    assert out.count() > 0 and out.select(F.max("a.z")).first()[0] == 0
    assert tiles.tile_triangles(mesh.compose(v, f.limit(0)), 15).count() == 0


def test_strip_home_and_tokens(spark):
    r = spark.createDataFrame([("/h/u/x",), ("/other",), (None,)], "p string").select(text.strip_home(F.col("p"), "/h/u").alias("p")).collect()
    assert [x.p for x in r] == ["~/x", "/other", None]
    assert spark.createDataFrame([(" a\tb\x00\r\nc ",)], "s string").select(text.tokens(F.col("s")).alias("t")).first().t == ["a", "b", "c"]
