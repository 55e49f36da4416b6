"""Queries of tiling and tile codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mesalith.functions import codec, geom
from mesalith.operators import mesh, raster, tiles
from mesalith.plans import views
from mesalith.plans.raster_queries import longs, rounded
from mesalith.plans.registry import query
from mesalith.plans.views import DEM, SIZE, ZOOM, mesh_sql
from mesalith.sources import binary

HALF = "20037508.342789243e0"


def pyramid(spark, sf):
    cells, m = views.dem(spark, sf)
    return raster.pyramid(cells, m)


#: Zooms with their size, cell, and the extents of their cell centres.
LEVELS = f"""{DEM}, zr AS (SELECT CAST(round(log2(156543.04e0 / 3.91694e0)) AS INTEGER) AS hi, CAST(greatest(0, floor(log2(128e0 * pow(2, round(log2(156543.04e0 / 3.91694e0))) / greatest(100, h)))) AS INTEGER) AS lo, h FROM hh),
l AS (SELECT unnest(range(lo, hi + 1)) AS zoom, hi, h FROM zr), lv AS (SELECT zoom, 1::BIGINT << (hi - zoom) AS n, h FROM l),
lm AS (SELECT zoom, h // n AS lh, 100 // n AS lw, 3.91694e0 * n AS cs, 4543905.659e0 + (h % n) * 3.91694e0 AS py FROM lv),
lb AS (SELECT *, -13636677.018e0 + 0.5e0 * cs AS x0, py + 0.5e0 * cs AS y0, -13636677.018e0 + (lw - 0.5e0) * cs AS x1, py + (lh - 0.5e0) * cs AS y1, 2 * {HALF} / pow(2, zoom) AS tm FROM lm),
lt AS (SELECT *, greatest(1, CAST(trunc(cs * 800 / tm) AS BIGINT)) AS nt, """ + ", ".join(f"CAST(ceil(({v} + {HALF}) / tm) - 1 AS BIGINT) AS t{v}" for v in ("x0", "y0", "x1", "y1")) + f""" FROM lb),
pp AS (SELECT *, unnest(range(tx0, tx1 + 1, nt)) AS tx FROM lt), pq AS (SELECT *, unnest(range(ty0, ty1 + 1, nt)) AS ty FROM pp),
parts AS (SELECT zoom, (tx - tx0) // nt * ((ty1 - ty0) // nt + 1) + (ty - ty0) // nt AS part_id, tx * tm - {HALF} - 100 * cs AS min_x, ty * tm - {HALF} - 100 * cs AS min_y, least((tx + nt) * tm - {HALF}, x1) + 100 * cs AS max_x, least((ty + nt) * tm - {HALF}, y1) + 100 * cs AS max_y,
 tx AS tmin_x, ty AS tmin_y, CASE WHEN (tx + nt) * tm - {HALF} > x1 THEN tx1 ELSE tx + nt - 1 END AS tmax_x, CASE WHEN (ty + nt) * tm - {HALF} > y1 THEN ty1 ELSE ty + nt - 1 END AS tmax_y FROM pq)"""


@query("partition_plan", f"WITH {LEVELS} SELECT CAST(zoom AS BIGINT) AS zoom, part_id, round(min_x, 4) AS min_x, round(min_y, 4) AS min_y, round(max_x, 4) AS max_x, round(max_y, 4) AS max_y, tmin_x, tmin_y, tmax_x, tmax_y FROM parts")
def _(spark, sf):
    plan = tiles.plan(spark, pyramid(spark, sf)[1])
    return rounded(longs(plan, "zoom", "part_id", "tmin_x", "tmin_y", "tmax_x", "tmax_y"), "min_x", "min_y", "max_x", "max_y", digits=4)


@query("cells_to_partitions", f"""WITH {LEVELS}, cl AS (SELECT zoom, d.row // n AS row, d.col // n AS col, avg(d.z) AS z FROM dem d, lv WHERE d.row < lv.h // n * n AND d.col < 100 // n * n GROUP BY ALL)
SELECT CAST(p.zoom AS BIGINT) AS zoom, p.part_id, count(*) AS n, round(sum(z), 4) AS total FROM cl JOIN lm USING (zoom) JOIN parts p ON p.zoom = cl.zoom AND -13636677.018e0 + (cl.col + 0.5e0) * cs BETWEEN min_x - 1e-6 AND max_x + 1e-6 AND lm.py + (lh - 1 - cl.row + 0.5e0) * cs BETWEEN min_y - 1e-6 AND max_y + 1e-6 GROUP BY ALL""")
def _(spark, sf):
    cells, metas = pyramid(spark, sf)
    found = tiles.cells_to_partitions(cells, metas, tiles.plan(spark, metas))
    return rounded(longs(found.groupBy("zoom", "part_id").agg(F.count("*").alias("n"), F.sum("z").alias("total")), "zoom"), "total", digits=4)


#: Triangles with the tiles that they may lie in.
TILED = f"""{mesh_sql(3)}, bx AS (SELECT *, least(ax, bx, cx) AS x0, least(ay, "by", cy) AS y0, greatest(ax, bx, cx) AS x1, greatest(ay, "by", cy) AS y1 FROM tri),
e1 AS (SELECT *, unnest(range(CAST(ceil((x0 + {HALF} - 2e-9) / {SIZE} - 1.25e0) AS BIGINT), CAST(floor((x1 + {HALF} + 2e-9) / {SIZE} + 0.25e0) AS BIGINT) + 1)) AS tx FROM bx),
td AS (SELECT *, unnest(range(CAST(ceil((y0 + {HALF} - 2e-9) / {SIZE} - 1.25e0) AS BIGINT), CAST(floor((y1 + {HALF} + 2e-9) / {SIZE} + 0.25e0) AS BIGINT) + 1)) AS ty FROM e1)"""


def tiled(spark, sf):
    return tiles.triangles_to_tiles(views.triangles(spark, sf, 3), ZOOM)


@query("triangles_to_tiles", f"WITH {TILED} SELECT tx, ty, count(*) AS n, sum(tid)::BIGINT AS tids FROM td GROUP BY ALL")
def _(spark, sf):
    return longs(tiled(spark, sf).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum("tid").alias("tids")), "tx", "ty", "tids")


@query("tile_zrange", f"WITH {TILED} SELECT tx, ty, min(least(az, bz, cz)) AS min_z, max(greatest(az, bz, cz)) AS max_z FROM td GROUP BY ALL")
def _(spark, sf):
    return longs(tiles.z_ranges(tiled(spark, sf)), "tx", "ty").drop("zoom")


@query("tile_normalise", f"WITH {TILED}, r AS (SELECT tx, ty, min(least(az, bz, cz)) AS lo, max(greatest(az, bz, cz)) AS hi FROM td GROUP BY ALL) SELECT tid, tx, ty, round((ax + {HALF}) / {SIZE} - tx, 6) + 0e0 AS x, round((ay + {HALF}) / {SIZE} - ty, 6) + 0e0 AS y, round(coalesce((az - lo) / nullif(hi - lo, 0), 0), 6) + 0e0 AS z FROM td JOIN r USING (tx, ty)")
def _(spark, sf):
    t = tiled(spark, sf)
    n = tiles.normalise(t, tiles.z_ranges(t))
    return longs(n, "tx", "ty").select("tid", "tx", "ty", *((F.round(F.col(f"a.{c}"), 6) + 0.0).alias(c) for c in "xyz"))


def clipped(spark, sf):
    return tiles.tile_triangles(views.triangles(spark, sf, 3), ZOOM)


AREA = f"""{DEM}, b AS (SELECT (-13636677.018e0 + 0.5e0 * 3.91694e0 + {HALF}) / {SIZE} AS x0, (-13636677.018e0 + 99.5e0 * 3.91694e0 + {HALF}) / {SIZE} AS x1, (4543905.659e0 + 0.5e0 * 3.91694e0 + {HALF}) / {SIZE} AS y0, (4543905.659e0 + (h - 0.5e0) * 3.91694e0 + {HALF}) / {SIZE} AS y1 FROM hh),
tx AS (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS tx FROM b), t AS (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(floor(y1) AS BIGINT) + 1)) AS ty FROM tx)"""


@query("clip_unit_square", f"WITH {AREA} SELECT tx, ty, round((least(x1, tx + 1) - greatest(x0, tx)) * (least(y1, ty + 1) - greatest(y0, ty)), 6) AS area FROM t WHERE least(x1, tx + 1) > greatest(x0, tx) AND least(y1, ty + 1) > greatest(y0, ty)")
def _(spark, sf):
    area = F.sum(0.5 * geom.cross(F.col("a"), F.col("b"), F.col("c")))
    return rounded(longs(clipped(spark, sf).groupBy("tx", "ty").agg(area.alias("area")), "tx", "ty"), "area")


@query("clip_stays_inside", "SELECT true AS inside, true AS facing_up")
def _(spark, sf):
    xs = [F.col(f"{c}.{d}") for c in mesh.CORNERS for d in "xyz"]
    up = geom.cross(F.col("a"), F.col("b"), F.col("c")) >= -1e-15
    return clipped(spark, sf).agg(F.every((F.least(*xs) >= -1e-12) & (F.greatest(*xs) <= 1 + 1e-12)).alias("inside"), F.every(up).alias("facing_up"))


@query("tile_pipeline_counts")
def _(spark, sf):
    return tiles.catalog(*tiles.tile_meshes(clipped(spark, sf)))


@query("tile_header", f"""WITH {TILED}, r AS (SELECT tx, ty, min(least(az, bz, cz)) AS lo, max(greatest(az, bz, cz)) AS hi FROM td GROUP BY ALL), c AS (SELECT tx, ty, lo, hi, (lo + hi) / 2 AS hz, (tx + 0.5e0) * {SIZE} - {HALF} AS mx, (ty + 0.5e0) * {SIZE} - {HALF} AS my FROM r),
q AS (SELECT *, mx / {HALF} * pi() AS o, 2 * atan(exp(my / 6378137e0)) - pi() / 2 AS a FROM c), n AS (SELECT *, 6378137e0 / sqrt(1 - 0.00669437999014e0 * sin(a) * sin(a)) AS n FROM q)
SELECT tx, ty, round((n + hz) * cos(a) * cos(o), 3) AS center_x, round((n + hz) * cos(a) * sin(o), 3) AS center_y, round((n * (1 - 0.00669437999014e0) + hz) * sin(a), 3) AS center_z, round(sqrt(2 * {SIZE} * {SIZE} + (hi - lo) * (hi - lo)) / 2, 4) AS radius FROM n""")
def _(spark, sf):
    h = tiles.header(tiles.z_ranges(tiled(spark, sf)))
    return longs(h, "tx", "ty").select("tx", "ty", *(F.round(c, 3).alias(c) for c in ("center_x", "center_y", "center_z")), F.round("radius", 4).alias("radius"))


# Codecs ---------------------------------------------------------------------------------------------------------------

QUANT = "q AS (SELECT row, col, CAST(trunc((z - (SELECT min(z) FROM demz)) / ((SELECT max(z) FROM demz) - (SELECT min(z) FROM demz)) * 32767) AS BIGINT) AS q FROM demz)"


def quantised(spark, sf):
    cells, _ = views.dem(spark, sf, filled=True)
    return cells.crossJoin(F.broadcast(raster.min_max(cells))).withColumn("q", codec.quantise(F.col("z"), F.col("min_z"), F.col("max_z")))  # one row


@query("quantise", f"WITH {DEM}, {QUANT} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, q, round((SELECT min(z) FROM demz) + q / 32767e0 * ((SELECT max(z) FROM demz) - (SELECT min(z) FROM demz)), 6) AS back FROM q")
def _(spark, sf):
    q = quantised(spark, sf)
    return longs(q.select("row", "col", "q", F.round(codec.dequantise(F.col("q"), F.col("min_z"), F.col("max_z")), 6).alias("back")), "row", "col", "q")


DELTA = f"{DEM}, {QUANT}, d AS (SELECT row, col, q - lag(q, 1, 0) OVER (PARTITION BY row ORDER BY col) AS d FROM q)"


@query("zigzag", f"WITH {DELTA} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u, d AS back FROM d")
def _(spark, sf):
    d = quantised(spark, sf).select("row", "col", codec.zigzag(codec.differences(F.col("q"), ["row"], "col")).alias("u"))
    return longs(d.withColumn("back", codec.unzigzag(F.col("u"))), "row", "col", "u", "back")


@query("delta_encode", f"WITH {DELTA} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, d FROM d")
def _(spark, sf):
    return longs(quantised(spark, sf).select("row", "col", codec.differences(F.col("q"), ["row"], "col").alias("d")), "row", "col", "d")


@query("delta_decode", f"WITH {DEM}, {QUANT} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, q FROM q")
def _(spark, sf):
    d = quantised(spark, sf).select("row", "col", codec.differences(F.col("q"), ["row"], "col").alias("d"))
    return longs(d.select("row", "col", codec.running_sum(F.col("d"), ["row"], "col").alias("q")), "row", "col", "q")


def indices(spark, sf):
    """Corners of the faces in order, per strip of the mesh, as numbers of first appearance."""
    _, f = mesh.decompose(views.triangles(spark, sf, 3).withColumn("zoom", F.expr("tid div 66").cast("int")), ("zoom",))
    return f.select("zoom", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "i"), "fid").select("zoom", (F.col("fid") * 3 + F.col("k")).alias("pos"), "i")


INDEX = f"""{mesh_sql(3)}, c AS (SELECT fid // 66 AS zoom, fid * 3 AS pos, v0 AS v FROM df UNION ALL SELECT fid // 66, fid * 3 + 1, v1 FROM df UNION ALL SELECT fid // 66, fid * 3 + 2, v2 FROM df), fi AS (SELECT zoom, v, row_number() OVER (PARTITION BY zoom ORDER BY min(pos)) - 1 AS i FROM c GROUP BY zoom, v),
ix AS (SELECT zoom, pos, i FROM c JOIN fi USING (zoom, v))"""


@query("hwm_encode", f"WITH {INDEX} SELECT CAST(zoom AS BIGINT) AS strip, pos, coalesce(max(i) OVER (PARTITION BY zoom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) - i AS code FROM ix")
def _(spark, sf):
    return longs(indices(spark, sf).select(F.col("zoom").alias("strip"), "pos", codec.high_water_encode(F.col("i"), ["zoom"], "pos").alias("code")), "strip", "pos", "code")


@query("hwm_decode", f"WITH {INDEX} SELECT CAST(zoom AS BIGINT) AS strip, pos, i FROM ix")
def _(spark, sf):
    c = indices(spark, sf).select(F.col("zoom").alias("strip"), "pos", codec.high_water_encode(F.col("i"), ["zoom"], "pos").alias("code"))
    return longs(c.select("strip", "pos", codec.high_water_decode(F.col("code"), ["strip"], "pos").alias("i")), "strip", "pos", "i")


@query("edge_lists", f"WITH {mesh_sql(3)}, q AS (SELECT vid, x, y, min(x) OVER () AS x0, max(x) OVER () AS x1, min(y) OVER () AS y0, max(y) OVER () AS y1 FROM dv), e AS (SELECT 'west' AS edge, vid FROM q WHERE x = x0 UNION ALL SELECT 'east', vid FROM q WHERE x = x1 UNION ALL SELECT 'south', vid FROM q WHERE y = y0 UNION ALL SELECT 'north', vid FROM q WHERE y = y1) SELECT edge, count(*) AS n, sum(vid)::BIGINT AS vids FROM e GROUP BY edge")
def _(spark, sf):
    v = views.dense_mesh(spark, sf, 3)[0]
    q = v.crossJoin(F.broadcast(mesh.bbox(v).drop("min_z", "max_z")))  # one row
    u, w = codec.quantise(F.col("x"), F.col("min_x"), F.col("max_x")), codec.quantise(F.col("y"), F.col("min_y"), F.col("max_y"))
    names = F.filter(F.array(F.when(u == 0, "west"), F.when(u == codec.TOP, "east"), F.when(w == 0, "south"), F.when(w == codec.TOP, "north")), lambda s: s.isNotNull())
    return q.select("vid", F.explode(names).alias("edge")).groupBy("edge").agg(F.count("*").alias("n"), F.sum("vid").alias("vids"))


@query("index_width", "SELECT event_id, CASE WHEN event_id * 10 <= 65536 THEN 16 ELSE 32 END::BIGINT AS bits FROM events")
def _(spark, sf):
    return longs(views.events(spark, sf).select("event_id", codec.index_bits(F.col("event_id") * 10).alias("bits")), "bits")


@query("tile_encode_roundtrip", "SELECT true AS faces, true AS near")
def _(spark, sf):
    """Encoded and decoded tiles have the same faces, and corners within one quantum."""
    t = tiled(spark, sf)
    ranges = tiles.z_ranges(t)
    v, f = tiles.tile_meshes(tiles.clip(tiles.normalise(t, ranges)))
    blobs = binary.encode_tiles(v, f, tiles.header(ranges))
    keys = ["zoom", "tx", "ty"]
    back = binary.decode_tiles(blobs).withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("fid", "corner")))
    want = f.select(*keys, "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid")).join(v, [*keys, "vid"]).withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("fid", "corner")))
    both = want.select(*keys, "order", *(F.col(c).alias(f"w{c}") for c in "xyz")).join(back, [*keys, "order"], "full")
    near = F.every(F.coalesce(F.greatest(*(F.abs(F.col(c) - F.col(f"w{c}")) for c in "xyz")) <= 1.001 / codec.TOP, F.lit(False)))
    return both.agg((F.count_if(F.col("x").isNull() | F.col("wx").isNull()) == 0).alias("faces"), near.alias("near"))


@query("tile_obj_counts")
def _(spark, sf):
    """Vertex and face lines of each tile's OBJ payload."""
    t = tiled(spark, sf)
    ranges = tiles.z_ranges(t)
    made = binary.obj_tiles(*tiles.tile_meshes(tiles.clip(tiles.normalise(t, ranges))), ranges)
    lines = F.split(F.col("payload").cast("string"), "\n")
    count = lambda k: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(k)))).cast("long")
    return longs(made.select("tx", "ty", count("v ").alias("n_vertices"), count("f ").alias("n_faces")), "tx", "ty")
