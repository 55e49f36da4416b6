"""Queries of dense meshes, mesh relations, checks, geometry, kernels and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from mesalith.functions import geom
from mesalith.operators import dense, kernels, mesh, points, quality, raster
from mesalith.plans import views
from mesalith.plans.raster_queries import longs, rounded
from mesalith.plans.registry import query
from mesalith.plans.views import DEM, mesh_sql

for step in (1, 3):

    @query(f"dense_mesh_vertices_s{step}", f"WITH {mesh_sql(step)} SELECT vid, round(x, 6) AS x, round(y, 6) AS y, z FROM dv")
    def _(spark, sf, step=step):
        return rounded(views.dense_mesh(spark, sf, step)[0], "x", "y")

    @query(f"dense_mesh_faces_s{step}", f"WITH {mesh_sql(step)} SELECT fid, v0, v1, v2 FROM df")
    def _(spark, sf, step=step):
        return views.dense_mesh(spark, sf, step)[1]


@query("mesh_counts", f"WITH {mesh_sql(3)} SELECT (SELECT count(*) FROM dv) AS n_vertices, (SELECT count(*) FROM df) AS n_faces")
def _(spark, sf):
    v, f, _ = views.dense_mesh(spark, sf, 3)
    return v.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(f.agg(F.count("*").alias("n_faces"))))  # one row each


def flat(t, digits=6):
    """Corners of triangles as rounded columns."""
    return t.select("tid", *(F.round(F.col(f"{c}.{d}"), digits).alias(f"{c}{d}") for c in mesh.CORNERS for d in "xyz"))


CORNERS = ", ".join(f'round("{c}{d}", 6) AS "{c}{d}"' for c in "abc" for d in "xyz")


@query("compose", f"WITH {mesh_sql(3)} SELECT tid, {CORNERS} FROM tri")
def _(spark, sf):
    return flat(views.triangles(spark, sf, 3))


@query("compose_drops_bad_faces", f"WITH {mesh_sql(3)} SELECT count(*) AS n FROM tri WHERE tid % 7 <> 0")
def _(spark, sf):
    v, f, _ = views.dense_mesh(spark, sf, 3)
    return mesh.compose(v, f.withColumn("v1", F.when(F.col("fid") % 7 == 0, F.lit(-5)).otherwise(F.col("v1")))).agg(F.count("*").alias("n"))


FIRST = 'o AS (SELECT tid * 3 AS ord, ax AS x, ay AS y, az AS z FROM tri UNION ALL SELECT tid * 3 + 1, bx, "by", bz FROM tri UNION ALL SELECT tid * 3 + 2, cx, cy, cz FROM tri), vv AS (SELECT x, y, z, row_number() OVER (ORDER BY min(ord)) - 1 AS vid FROM o GROUP BY x, y, z)'


@query("decompose_vertices", f"WITH {mesh_sql(3)}, {FIRST} SELECT vid, round(x, 6) AS x, round(y, 6) AS y, z FROM vv")
def _(spark, sf):
    return rounded(mesh.decompose(views.triangles(spark, sf, 3))[0], "x", "y")


@query("decompose_faces", f'WITH {mesh_sql(3)}, {FIRST} SELECT tid AS fid, a.vid AS v0, b.vid AS v1, c.vid AS v2 FROM tri JOIN vv a ON a.x = ax AND a.y = ay AND a.z = az JOIN vv b ON b.x = bx AND b.y = "by" AND b.z = bz JOIN vv c ON c.x = cx AND c.y = cy AND c.z = cz')
def _(spark, sf):
    return mesh.decompose(views.triangles(spark, sf, 3))[1]


@query("add_triangles", f"WITH {mesh_sql(3)} SELECT count(*) * 2 AS n, max(tid) * 2 + 1 AS last FROM tri")
def _(spark, sf):
    t = views.triangles(spark, sf, 3)
    return mesh.add_triangles(t, t).agg(F.count("*").alias("n"), F.max("tid").alias("last"))


@query("distinct_edges", f"WITH {mesh_sql(3)}, e AS (SELECT v0 AS p, v1 AS q FROM df UNION ALL SELECT v1, v2 FROM df UNION ALL SELECT v2, v0 FROM df) SELECT DISTINCT least(p, q) AS lo, greatest(p, q) AS hi FROM e")
def _(spark, sf):
    return mesh.edges(views.dense_mesh(spark, sf, 3)[1])


@query("mesh_equal", "SELECT true AS turned, false AS mirrored")
def _(spark, sf):
    t = views.triangles(spark, sf, 3)
    turned = t.select((F.col("tid") * -1).alias("tid"), F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))
    mirrored = t.select("tid", F.col("b").alias("a"), F.col("a").alias("b"), "c")
    return mesh.equal(t, turned).withColumnRenamed("equal", "turned").crossJoin(F.broadcast(mesh.equal(t, mirrored).withColumnRenamed("equal", "mirrored")))  # one row each


@query("mesh_bbox", f"WITH {mesh_sql(3)} SELECT round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, min(z) AS min_z, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, max(z) AS max_z FROM dv")
def _(spark, sf):
    return rounded(mesh.bbox(views.dense_mesh(spark, sf, 3)[0]), "min_x", "min_y", "max_x", "max_y")


@query("mesh_square", f"WITH {mesh_sql(3)}, b AS (SELECT min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM dv), e AS (SELECT *, (x1 - x0 + y1 - y0) / 20000 AS e FROM b) SELECT count(*) FILTER (abs(x - x0) <= e AND abs(y - y0) <= e) > 0 AND count(*) FILTER (abs(x - x1) <= e AND abs(y - y1) <= e) > 0 AS is_square FROM dv, e")
def _(spark, sf):
    return mesh.is_square(views.dense_mesh(spark, sf, 3)[0])


@query("mesh_holes", "SELECT false AS whole, true AS holed")
def _(spark, sf):
    v, f, _ = views.dense_mesh(spark, sf, 3)
    return mesh.has_hole(v, f).withColumnRenamed("has_hole", "whole").crossJoin(F.broadcast(mesh.has_hole(v, f.where("fid <> 40")).withColumnRenamed("has_hole", "holed")))  # one row each


def broken(spark, sf):
    """The dense mesh with faults: wrong indices, collapsed, turned and doubled parts."""
    v, f, m = views.dense_mesh(spark, sf, 3)
    f = f.select("fid", F.when(F.col("fid") % 50 == 7, F.lit(-1)).when(F.col("fid") % 50 == 9, F.col("v1")).when(F.col("fid") % 50 == 11, F.col("v1")).otherwise(F.col("v0")).alias("v0"),
                 F.when(F.col("fid") % 50 == 11, F.col("v0")).otherwise(F.col("v1")).alias("v1"), "v2").where("fid % 50 <> 13")
    more = v.where("vid % 40 = 0").withColumn("vid", F.col("vid") + 1_000_000)
    return v.unionByName(more), f, m


BROKEN = f"""{mesh_sql(3)}, bf AS (SELECT fid, CASE fid % 50 WHEN 7 THEN -1 WHEN 9 THEN v1 WHEN 11 THEN v1 ELSE v0 END AS v0, CASE fid % 50 WHEN 11 THEN v0 ELSE v1 END AS v1, v2 FROM df WHERE fid % 50 <> 13),
bv AS (SELECT * FROM dv UNION ALL SELECT vid + 1000000, x, y, z FROM dv WHERE vid % 40 = 0), bc AS (SELECT fid, v0 AS vid FROM bf UNION ALL SELECT fid, v1 FROM bf UNION ALL SELECT fid, v2 FROM bf)"""


@query("tin_bad_index", f"WITH {BROKEN} SELECT DISTINCT fid FROM bc WHERE vid NOT IN (SELECT vid FROM bv)")
def _(spark, sf):
    return mesh.bad_index(*broken(spark, sf)[:2])


@query("tin_unused_vertex", f"WITH {BROKEN} SELECT vid FROM bv WHERE vid NOT IN (SELECT vid FROM bc)")
def _(spark, sf):
    return mesh.unused_vertices(*broken(spark, sf)[:2])


@query("tin_collapsed", f"WITH {BROKEN} SELECT fid FROM bf WHERE v0 = v1 OR v1 = v2 OR v2 = v0")
def _(spark, sf):
    return mesh.collapsed_faces(broken(spark, sf)[1])


@query("tin_facing", f"WITH {BROKEN} SELECT fid FROM bf JOIN bv a ON a.vid = v0 JOIN bv b ON b.vid = v1 JOIN bv c ON c.vid = v2 WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0")
def _(spark, sf):
    return mesh.facing_down(*broken(spark, sf)[:2])


@query("tin_duplicates", f"WITH {BROKEN} SELECT round(x, 6) AS x, round(y, 6) AS y, z, count(*) AS n FROM bv GROUP BY bv.x, bv.y, z HAVING count(*) > 1")
def _(spark, sf):
    return rounded(mesh.duplicate_vertices(broken(spark, sf)[0]), "x", "y")


@query("tin_crossing", f"""WITH {mesh_sql(3)}, bad AS (SELECT fid, CASE WHEN fid % 500 <> 0 THEN v0 WHEN fid // 2 % 33 < 25 THEN v0 + 5 ELSE v0 - 5 END AS v0, v1, v2 FROM df), ee AS (SELECT v0 AS p, v1 AS q FROM bad UNION ALL SELECT v1, v2 FROM bad UNION ALL SELECT v2, v0 FROM bad),
e AS (SELECT DISTINCT least(p, q) AS lo, greatest(p, q) AS hi FROM ee), g AS (SELECT lo, hi, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM e JOIN dv a ON a.vid = lo JOIN dv b ON b.vid = hi),
s AS (SELECT g.lo AS a_lo, g.hi AS a_hi, r.lo AS b_lo, r.hi AS b_hi, sign((g.qx - g.px) * (r.py - g.py) - (g.qy - g.py) * (r.px - g.px)) AS s1, sign((g.qx - g.px) * (r.qy - g.py) - (g.qy - g.py) * (r.qx - g.px)) AS s2,
 sign((r.qx - r.px) * (g.py - r.py) - (r.qy - r.py) * (g.px - r.px)) AS s3, sign((r.qx - r.px) * (g.qy - r.py) - (r.qy - r.py) * (g.qx - r.px)) AS s4,
 least(g.px, g.qx) <= greatest(r.px, r.qx) AND least(r.px, r.qx) <= greatest(g.px, g.qx) AND least(g.py, g.qy) <= greatest(r.py, r.qy) AND least(r.py, r.qy) <= greatest(g.py, g.qy) AS meet
 FROM g JOIN g r ON (g.lo, g.hi) < (r.lo, r.hi) AND least(g.px, g.qx) <= greatest(r.px, r.qx) + 1e-9 AND least(r.px, r.qx) <= greatest(g.px, g.qx) + 1e-9 AND least(g.py, g.qy) <= greatest(r.py, r.qy) + 1e-9 AND least(r.py, r.qy) <= greatest(g.py, g.qy) + 1e-9 WHERE g.lo <> r.lo AND g.lo <> r.hi AND g.hi <> r.lo AND g.hi <> r.hi)
SELECT a_lo, a_hi, b_lo, b_hi FROM s WHERE CASE WHEN s1 = 0 AND s2 = 0 THEN meet ELSE s1 * s2 <= 0 AND s3 * s4 <= 0 END""")
def _(spark, sf):
    v, f, m = views.dense_mesh(spark, sf, 3)
    f = f.withColumn("v0", F.expr("CASE WHEN fid % 500 <> 0 THEN v0 WHEN fid div 2 % 33 < 25 THEN v0 + 5 ELSE v0 - 5 END"))  # moved within the row
    return mesh.crossing_edges(v, f, 6 * m.cell_size)


@query("tin_report", "SELECT CAST(0 AS BIGINT) AS bad_index, CAST(0 AS BIGINT) AS unused, CAST(0 AS BIGINT) AS collapsed, CAST(0 AS BIGINT) AS down, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS hole, true AS valid")
def _(spark, sf):
    v, f, m = views.dense_mesh(spark, sf, 3)
    return mesh.tin_report(v, f, 6 * m.cell_size)


# Geometry -------------------------------------------------------------------------------------------------------------


def abc(spark, sf):
    """Triangles in cells of the raster: numbers without rounding."""
    t = views.triangles(spark, sf, 3)
    unit = lambda c: F.struct(F.round((F.col(f"{c}.x") - views.POS_X) / views.CELL * 2).alias("x"), F.round((F.col(f"{c}.y") - views.POS_Y) / views.CELL * 2).alias("y"), F.col(f"{c}.z").alias("z")).alias(c)
    return t.select("tid", *map(unit, mesh.CORNERS))


ABC = f"{mesh_sql(3)}, u AS (SELECT tid, " + ", ".join(f'round(("{c}x" + 13636677.018e0) / 3.91694e0 * 2) AS "{c}x", round(("{c}y" - 4543905.659e0) / 3.91694e0 * 2) AS "{c}y", "{c}z" AS "{c}z"' for c in "abc") + " FROM tri)"
UBOX = 'least(ax, bx, cx) AS x0, least(ay, "by", cy) AS y0, greatest(ax, bx, cx) AS x1, greatest(ay, "by", cy) AS y1'


def corners():
    return (F.col(c) for c in mesh.CORNERS)


@query("bbox_intersects", f"WITH {ABC} SELECT tid, x0 <= 60 AND 20 <= x1 AND y0 <= 90 AND 30 <= y1 AS meets FROM (SELECT tid, {UBOX} FROM u)")
def _(spark, sf):
    A, B, C = corners()
    return abc(spark, sf).select("tid", geom.boxes_meet(geom.bbox(A, B, C), tuple(map(F.lit, (20.0, 30.0, 60.0, 90.0)))).alias("meets"))


@query("bbox_contains", f"WITH {ABC} SELECT tid, ax BETWEEN 20 AND 60 AND ay BETWEEN 30 AND 90 AS inside, ax BETWEEN 20 AND 60 AND ay BETWEEN 30 AND 90 AND az BETWEEN 0 AND 50 AS inside_3d FROM u")
def _(spark, sf):
    A, B, C = corners()
    box = tuple(map(F.lit, (20.0, 30.0, 60.0, 90.0)))
    return abc(spark, sf).select("tid", geom.box_contains(box, A).alias("inside"), geom.box_contains(tuple(map(F.lit, (20.0, 30.0, 0.0, 60.0, 90.0, 50.0))), A, True).alias("inside_3d"))


@query("bbox_border", f"WITH {ABC} SELECT tid, (cx IN (x0, x1) OR cy IN (y0, y1)) AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 AS on_border, x1 - x0 = 6 AND y1 - y0 = 6 AS usual FROM (SELECT *, {UBOX} FROM u)")
def _(spark, sf):
    A, B, C = corners()
    box = geom.bbox(A, B, C)
    return abc(spark, sf).select("tid", geom.on_border(box, C).alias("on_border"), geom.boxes_equal(box, (box[0], box[1], box[0] + 6, box[1] + 6)).alias("usual"))


@query("segment_intersection", f'WITH {ABC}, d AS (SELECT *, (bx - ax) * 1e0 - ("by" - ay) * 2e0 AS d FROM u) SELECT tid, CASE WHEN d <> 0 THEN round(((50e0 - ax) * 1 - (40e0 - ay) * 2) / d, 6) + 0e0 END AS t FROM d')
def _(spark, sf):
    A, B, C = corners()
    t, _ = geom.segment_on_line(A, B, (50.0, 40.0), (2.0, 1.0))
    return abc(spark, sf).select("tid", (F.round(t, 6) + 0.0).alias("t"))


@query("segment_clip_z", f"WITH {ABC}, d AS (SELECT *, (CASE WHEN ax <> cx THEN (50e0 - ax) / (cx - ax) END) AS t FROM u) SELECT tid, round(az + t * (cz - az), 5) AS z FROM d WHERE t BETWEEN 0 AND 1")
def _(spark, sf):
    A, B, C = corners()
    line = ((50.0, 0.0), (0.0, 1.0))
    _, on = geom.segment_on_line(A, C, *line)
    return abc(spark, sf).where(on).select("tid", F.round(geom.clip_point(A, C, *line).z, 5).alias("z"))


@query("side_of_line", f"WITH {ABC} SELECT tid, CAST(-sign(2e0 * (ay - 40) - 1e0 * (ax - 50)) AS BIGINT) AS side FROM u")
def _(spark, sf):
    A, B, C = corners()
    return abc(spark, sf).select("tid", geom.side_of_line(A, (50.0, 40.0), (2.0, 1.0)).cast("long").alias("side"))


@query("segment_compare", f'WITH {ABC} SELECT tid, CAST(sign((pow(ax - bx, 2) + pow(ay - "by", 2)) - (pow(cx - bx, 2) + pow(cy - "by", 2))) AS BIGINT) AS flat, CAST(sign(round((az - bz) * (az - bz) + (ax - bx) * (ax - bx) + (ay - "by") * (ay - "by") - ((cx - bx) * (cx - bx) + (cy - "by") * (cy - "by") + (cz - bz) * (cz - bz)), 6)) AS BIGINT) AS solid FROM u')
def _(spark, sf):
    A, B, C = corners()
    solid = F.signum(F.round(geom.squared_length(A, B, True) - geom.squared_length(C, B, True), 6)).cast("long")
    return abc(spark, sf).select("tid", geom.compare_lengths(A, B, C, B, False).cast("long").alias("flat"), solid.alias("solid"))


@query("front_facing", f'WITH {ABC}, n AS (SELECT *, (cx - bx) * (ay - "by") - (cy - "by") * (ax - bx) AS n FROM (SELECT tid, bx AS ax, "by" AS ay, ax AS bx, ay AS "by", cx, cy FROM u)) SELECT tid, n >= 0 AS up, CASE WHEN n < 0 THEN bx ELSE ax END AS ax, CASE WHEN n < 0 THEN "by" ELSE ay END AS ay FROM n')
def _(spark, sf):
    A, B, C = corners()
    t = abc(spark, sf).select("tid", F.col("b").alias("a"), F.col("a").alias("b"), "c")
    a, _, _ = geom.front_facing(A, B, C)
    return t.select("tid", geom.facing_up(A, B, C).alias("up"), a.x.alias("ax"), a.y.alias("ay"))


@query("vertex_order", f"WITH {mesh_sql(3)} SELECT vid, row_number() OVER (PARTITION BY vid % 8 ORDER BY x, y, z) - 1 AS k FROM dv")
def _(spark, sf):
    from pyspark.sql import Window

    v = views.dense_mesh(spark, sf, 3)[0]
    return v.select("vid", (F.row_number().over(Window.partitionBy(F.col("vid") % 8).orderBy(F.struct("x", "y", "z"))) - 1).cast("long").alias("k"))


@query("vertex_hash_distinct", f"WITH {ABC}, p AS (SELECT ax AS x, ay AS y, az AS z FROM u UNION ALL SELECT bx, \"by\", bz FROM u UNION ALL SELECT cx, cy, cz FROM u) SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT x, y, z FROM p)) AS n_distinct FROM p")
def _(spark, sf):
    p = abc(spark, sf).select(F.explode(F.array("a", "b", "c")).alias("p"))
    return p.agg(F.count("*").alias("n"), F.count_distinct("p").alias("n_distinct"))


@query("barycentric", f'WITH {ABC}, w AS (SELECT *, (("by" - cy) * (x - cx) + (cx - bx) * (y - cy)) / d AS w0, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / d AS w1, ((ay - "by") * (x - bx) + (bx - ax) * (y - "by")) / d AS w2 FROM (SELECT *, ax - 2e0 AS x, ay + 1e0 AS y, ("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS d FROM u) WHERE d <> 0) SELECT tid, CASE WHEN w0 BETWEEN 0 AND 1 AND w1 BETWEEN 0 AND 1 AND w2 BETWEEN 0 AND 1 THEN round(w0 * az + w1 * bz + w2 * cz, 5) END AS z FROM w')
def _(spark, sf):
    A, B, C = corners()
    return abc(spark, sf).select("tid", F.round(geom.interpolate(A, B, C, A.x - 2, A.y + 1), 5).alias("z"))


@query("plane_fit", f'WITH {ABC}, w AS (SELECT *, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS d FROM u), q AS (SELECT *, ((bz - az) * (cy - ay) - (cz - az) * ("by" - ay)) / d AS p, ((bx - ax) * (cz - az) - (cx - ax) * (bz - az)) / d AS q FROM w) SELECT tid, round(p, 5) + 0e0 AS p, round(q, 5) + 0e0 AS q, round(az - p * ax - q * ay, 4) + 0e0 AS r FROM q')
def _(spark, sf):
    A, B, C = corners()
    p, q, r = geom.plane(A, B, C)
    return abc(spark, sf).select("tid", (F.round(p, 5) + 0.0).alias("p"), (F.round(q, 5) + 0.0).alias("q"), (F.round(r, 4) + 0.0).alias("r"))


@query("orientation", f'WITH {ABC} SELECT tid, CAST(sign((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) AS BIGINT) AS turn, pow(ax + 2 - (ax + cx) / 2, 2) + pow(ay - (ay + cy) / 2, 2) < (pow(ax - cx, 2) + pow(ay - cy, 2)) / 4 AS in_circle FROM u WHERE tid % 2 = 1 AND FALSE UNION ALL SELECT tid, CAST(sign((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) AS BIGINT), false FROM u')
def _(spark, sf):
    A, B, C = corners()
    # the first corner lies on the circle through all three, not in it
    return abc(spark, sf).select("tid", geom.orientation(A, B, C).cast("long").alias("turn"), geom.in_circle(A, B, C, A).alias("in_circle"))


# Kernels --------------------------------------------------------------------------------------------------------------

CHIP = 25


def chipped(spark, sf, filled=False):
    cells, m = views.dem(spark, sf, filled)
    return cells.withColumns({"chip_row": F.expr(f"cast(row div {CHIP} as int)"), "chip_col": F.expr(f"cast(col div {CHIP} as int)")}), m


#: Chips' cells as SQL: k has those that a mesh without error uses, valid ones and corners.
KEPT = f"""{DEM}, c AS (SELECT row // {CHIP} AS chip_row, col // {CHIP} AS chip_col, row % {CHIP} AS r, col % {CHIP} AS c, least(h - row // {CHIP} * {CHIP}, {CHIP}) - 1 AS rh, least(100 - col // {CHIP} * {CHIP}, {CHIP}) - 1 AS cw, z FROM dem, hh),
k AS (SELECT * FROM c WHERE z IS NOT NULL OR ((r = 0 OR r = rh) AND (c = 0 OR c = cw)))"""


@query("terra_zero_error_vertices", f"""WITH {KEPT}
SELECT CAST(chip_row AS BIGINT) AS chip_row, CAST(chip_col AS BIGINT) AS chip_col, count(*) AS n_vertices, 2 * count(*) - 2 - count(*) FILTER (r = 0 OR r = rh OR c = 0 OR c = cw) AS n_faces FROM k GROUP BY ALL""")
def _(spark, sf):
    cells, m = chipped(spark, sf)
    v, f = kernels.mesh_groups(cells, m, ("chip_row", "chip_col"), "terra", 0.0, keep=True)
    n = v.groupBy("chip_row", "chip_col").agg(F.count("*").alias("n_vertices")).join(f.groupBy("chip_row", "chip_col").agg(F.count("*").alias("n_faces")), ["chip_row", "chip_col"])
    return longs(n, "chip_row", "chip_col")


def bound(spark, sf, method, max_error):
    """Whether the chips' meshes are valid and nearer than max_error to every valid cell, and how many faces they save."""
    cells, m = chipped(spark, sf)
    v, f = kernels.mesh_groups(cells, m, ("chip_row", "chip_col"), method, max_error, keep=True)
    key = F.col("chip_row").cast("long") * 1_000_000 + F.col("chip_col")
    big = F.lit(1_000_000)
    v = v.select((key * big + F.col("vid")).alias("vid"), "x", "y", "z", key.alias("g"))
    f = f.select((key * big + F.col("fid")).alias("fid"), *((key * big + F.col(f"v{k}")).alias(f"v{k}") for k in range(3)))
    tri = mesh.compose(v, f).persist()  # drawn and checked
    off = quality.differences(cells, quality.rasterise(tri, m), m, 0).agg(F.max(F.abs("d")).alias("worst"), F.count("*").alias("n"))
    valid = cells.agg(F.count("z").alias("want"), F.count("*").alias("cells"))
    fewer = f.agg(F.count("*").alias("faces"), F.count_if((F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v2") == F.col("v0"))).alias("collapsed"))
    # a face with an index that no vertex has is no triangle
    bad = tri.agg(F.count("*").alias("whole_faces"), F.count_if(~geom.facing_up(F.col("a"), F.col("b"), F.col("c"))).alias("down"))
    one = off.crossJoin(F.broadcast(valid)).crossJoin(F.broadcast(fewer)).crossJoin(F.broadcast(bad))  # one row each
    return one.select((F.col("worst") < max_error + 1e-6).alias("within"), (F.col("n") == F.col("want")).alias("whole"), (F.col("faces") < 2 * F.col("cells")).alias("fewer"), ((F.col("collapsed") == 0) & (F.col("down") == 0) & (F.col("whole_faces") == F.col("faces"))).alias("valid"))


for method in ("terra", "zemlya"):

    @query(f"{method}_bound", "SELECT true AS within, true AS whole, true AS fewer, true AS valid")
    def _(spark, sf, method=method):
        return bound(spark, sf, method, 40.0)


# The first ring is the eight cells around, each with the weighted mean of the nine around itself, on the raster or not: wider rings serve cells with none of these 25 valid.
@query("ring_fill", f"""WITH {DEM}, o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
p AS (SELECT row, col, i, j, row + i AS pr, col + j AS pc FROM dem, o WHERE z IS NULL AND (i <> 0 OR j <> 0)),
n AS (SELECT p.row, p.col, p.i, p.j, abs(o.i) + abs(o.j) AS far, avg(d.z) AS z FROM p, o, dem d WHERE d.row = pr + o.i AND d.col = pc + o.j AND d.z IS NOT NULL GROUP BY ALL),
s AS (SELECT row, col, i, j, sum((3 - far) * z) / sum(3 - far) AS z FROM n GROUP BY ALL)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(avg(s.z), 9) AS z FROM dem LEFT JOIN s USING (row, col) WHERE dem.z IS NULL GROUP BY row, col""")
def _(spark, sf):
    return rounded(longs(kernels.ring_fill(*views.dem(spark, sf)), "row", "col"), "z", digits=9)  # halves of the last digit occur at 6


@query("delaunay_grid_faces", f"WITH {DEM}, b AS (SELECT row // 10 AS br, col // 20 AS bc, max(row) - min(row) AS dh, max(col) - min(col) AS dw FROM dem GROUP BY ALL) SELECT CAST(br AS BIGINT) AS br, CAST(bc AS BIGINT) AS bc, CAST(2 * dh * dw AS BIGINT) AS n_faces FROM b WHERE dh * dw > 0")
def _(spark, sf):
    p = views.dem(spark, sf)[0].select(F.expr("row div 10").alias("br"), F.expr("col div 20").alias("bc"), (F.col("row") * 100 + F.col("col")).cast("long").alias("id"), F.col("col").cast("double").alias("x"), (-F.col("row")).cast("double").alias("y"))
    return kernels.triangulate_groups(p, ("br", "bc")).groupBy("br", "bc").agg(F.count("*").alias("n_faces"))


@query("zemlya_average_pyramid", f"WITH {DEM}, c AS (SELECT row // 24 AS chip_row, col // 24 AS chip_col, row % 24 // 2 AS r, col % 24 // 2 AS c, count(*) AS n, avg(z) AS z FROM dem GROUP BY ALL) SELECT CAST(chip_row AS BIGINT) AS chip_row, CAST(chip_col AS BIGINT) AS chip_col, CAST(2 * r + 1 AS BIGINT) AS row, CAST(2 * c + 1 AS BIGINT) AS col, round(z, 6) AS z FROM c WHERE n = 4 AND z IS NOT NULL")
def _(spark, sf):
    import numpy as np
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, _, _ = kernels.as_grid(pdf)
        m = kernels.average_pyramid(z) if min(z.shape) > 1 else np.full(z.shape, np.nan)
        r, c = np.mgrid[1: z.shape[0]: 2, 1: z.shape[1]: 2]  # centres of the squares of two cells
        r, c = r.ravel(), c.ravel()
        ok = ~np.isnan(m[r, c])
        return pd.DataFrame({"chip_row": key[0], "chip_col": key[1], "row": r[ok], "col": c[ok], "z": m[r, c][ok]})

    cells = views.dem(spark, sf)[0].withColumns({"chip_row": F.expr("row div 24"), "chip_col": F.expr("col div 24")})
    return rounded(cells.groupBy("chip_row", "chip_col").applyInPandas(run, "chip_row long, chip_col long, row long, col long, z double"), "z")


def points_meshed(spark, sf, max_error):
    """Vertices of each chip of the raster that the points make."""
    p = views.points(spark, sf)
    cells, m = points.to_raster(p, points.infer_grid(p))
    cells = cells.withColumns({"chip_row": F.expr(f"cast(row div {CHIP} as int)"), "chip_col": F.expr(f"cast(col div {CHIP} as int)")})
    return kernels.mesh_groups(cells, m, ("chip_row", "chip_col"), "terra", max_error)[0].groupBy("chip_row", "chip_col").agg(F.count("*").alias("n_vertices"))


@query("raster_from_points_terra")
def _(spark, sf):
    return points_meshed(spark, sf, 60.0)


@query("points_terra_exact", f"WITH {KEPT} SELECT CAST(chip_row AS BIGINT) AS chip_row, CAST(chip_col AS BIGINT) AS chip_col, count(*) AS n_vertices FROM k GROUP BY ALL")
def _(spark, sf):
    return longs(points_meshed(spark, sf, 0.0), "chip_row", "chip_col")


# Errors ---------------------------------------------------------------------------------------------------------------

def drawn_sql(step: int) -> str:
    """Plane of the triangle a cell lies in: squares of `step` cells, the last ones shorter, split from the upper left."""
    last = -(-99 // step) - 1
    return f"""{DEM}, g AS (SELECT row, col, z, h, least(row // {step}, (h - 2 + {step}) // {step} - 1) AS qr, least(col // {step}, {last}) AS qc FROM demz, hh), s AS (SELECT *, qr * {step} AS r0, qc * {step} AS c0, least(qr * {step} + {step}, h - 1) AS r1, least(qc * {step} + {step}, 99) AS c1 FROM g),
p AS (SELECT s.*, (s.row - r0) / (r1 - r0)::DOUBLE AS v, (s.col - c0) / (c1 - c0)::DOUBLE AS u, ul.z AS ul, ur.z AS ur, ll.z AS ll, lr.z AS lr FROM s JOIN demz ul ON ul.row = r0 AND ul.col = c0 JOIN demz ur ON ur.row = r0 AND ur.col = c1 JOIN demz ll ON ll.row = r1 AND ll.col = c0 JOIN demz lr ON lr.row = r1 AND lr.col = c1),
drawn AS (SELECT row, col, z, h, CASE WHEN u >= v THEN ul + (ur - ul) * u + (lr - ur) * v ELSE ul + (lr - ll) * u + (ll - ul) * v END AS m FROM p)"""


DRAWN = drawn_sql(3)


def drawn(spark, sf):
    cells, m = views.dem(spark, sf, filled=True)
    return cells, quality.rasterise(mesh.compose(*dense.dense_mesh(cells, m, 3)), m), m


@query("rasterise_mesh", f"WITH {DRAWN} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(m, 5) + 0e0 AS z FROM drawn")
def _(spark, sf):
    return rounded(longs(drawn(spark, sf)[1], "row", "col"), "z", digits=5).withColumn("z", F.col("z") + 0.0)


@query("measure_error", f"WITH {DRAWN} SELECT round(avg(z - m), 6) AS mean_error, round(stddev_pop(z - m), 6) AS std_dev_error, round(max(abs(z - m)), 5) AS max_error FROM drawn WHERE row BETWEEN 2 AND h - 3 AND col BETWEEN 2 AND 97")
def _(spark, sf):
    return rounded(rounded(quality.measure_error(*drawn(spark, sf)), "mean_error", "std_dev_error"), "max_error", digits=5)


@query("rms_error", f"WITH {DRAWN} SELECT round(sqrt(avg((z - m) * (z - m))), 6) AS rms, round(max(abs(z - m)), 5) AS max_error FROM drawn WHERE row BETWEEN 2 AND h - 3 AND col BETWEEN 2 AND 97")
def _(spark, sf):
    return rounded(rounded(quality.rms_error(*drawn(spark, sf)), "rms"), "max_error", digits=5)


# The mesh ends at the centres of the outermost cells, so rounding decides whether these are sampled: the same sums as the operator's.
@query("rasterise_halfpixel", f"""WITH {DRAWN}, e AS (SELECT ((-13636677.018e0 + 0.5e0 * 3.91694e0) + 13636677.018e0) / 3.91694e0 - 0.5e0 AS x0, ((-13636677.018e0 + 99.5e0 * 3.91694e0) + 13636677.018e0) / 3.91694e0 - 0.5e0 AS x1,
h - ((4543905.659e0 + (h - 0.5e0) * 3.91694e0) - 4543905.659e0) / 3.91694e0 - 0.5e0 AS y0, h - ((4543905.659e0 + 0.5e0 * 3.91694e0) - 4543905.659e0) / 3.91694e0 - 0.5e0 AS y1 FROM hh)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(m, 5) + 0e0 AS z FROM drawn, e WHERE col BETWEEN x0 AND x1 AND row BETWEEN y0 AND y1""")
def _(spark, sf):
    cells, m = views.dem(spark, sf, filled=True)
    return rounded(longs(quality.rasterise(mesh.compose(*dense.dense_mesh(cells, m, 3)), m, half=True), "row", "col"), "z", digits=5).withColumn("z", F.col("z") + 0.0)


# A corner is snapped to one of the smaller cells around its place: lines of squares are as wide as rounding makes them.
FINE = "(3.91694e0 / 2)"


@query("oversample_downsample", f"""WITH {DEM}, mc AS (SELECT col AS c0, CAST(trunc(0.5e0 + ((-13636677.018e0 + (col + 0.5e0) * 3.91694e0) + 13636677.018e0 - 0.5e0 * {FINE}) / {FINE}) AS INTEGER) AS p0 FROM demz WHERE row = 0 AND (col % 3 = 0 OR col = 99)),
mr AS (SELECT row AS r0, 2 * h - CAST(trunc(0.5e0 + ((4543905.659e0 + ((h - 1 - row) + 0.5e0) * 3.91694e0) - 4543905.659e0 - 0.5e0 * {FINE}) / {FINE}) AS INTEGER) - 1 AS q0 FROM demz, hh WHERE col = 0 AND (row % 3 = 0 OR row = h - 1)),
sc AS (SELECT c0, p0, lead(c0) OVER (ORDER BY c0) AS c1, lead(p0) OVER (ORDER BY c0) AS p1 FROM mc), sr AS (SELECT r0, q0, lead(r0) OVER (ORDER BY r0) AS r1, lead(q0) OVER (ORDER BY r0) AS q1 FROM mr),
fc AS (SELECT *, unnest(range(p0, p1 + (c1 = 99)::INTEGER)) AS f FROM sc WHERE c1 IS NOT NULL), fr AS (SELECT *, unnest(range(q0, q1 + (r1 = h - 1)::INTEGER)) AS g FROM sr, hh WHERE r1 IS NOT NULL),
p AS (SELECT f, g, (f - p0) / (p1 - p0)::DOUBLE AS u, (g - q0) / (q1 - q0)::DOUBLE AS v, ul.z AS ul, ur.z AS ur, ll.z AS ll, lr.z AS lr FROM fc, fr, demz ul, demz ur, demz ll, demz lr
 WHERE ul.row = r0 AND ul.col = c0 AND ur.row = r0 AND ur.col = c1 AND ll.row = r1 AND ll.col = c0 AND lr.row = r1 AND lr.col = c1),
d AS (SELECT f, g, CASE WHEN u >= v THEN ul + (ur - ul) * u + (lr - ur) * v ELSE ul + (lr - ll) * u + (ll - ul) * v END AS z FROM p)
SELECT CAST(g // 2 AS BIGINT) AS row, CAST(f // 2 AS BIGINT) AS col, round(avg(z), 6) + 0e0 AS z FROM d GROUP BY ALL""")
def _(spark, sf):
    cells, m = views.dem(spark, sf, filled=True)
    return rounded(longs(quality.oversampled(mesh.compose(*dense.dense_mesh(cells, m, 3)), m, 2)[0], "row", "col"), "z").withColumn("z", F.col("z") + 0.0)


STEPS = (1, 2, 4, 5)


@query("sweep_stats", f"WITH {DEM}, s(step) AS (VALUES {', '.join(f'({s})' for s in STEPS)}) SELECT 'events' AS input_file, 'regular' AS method_name, CAST(step AS BIGINT) AS param_step, CAST(h * 100 AS BIGINT) AS input_num_points, CAST(((98 + step) // step + 1) * ((h - 2 + step) // step + 1) AS BIGINT) AS num_vertices, CAST(2 * ((98 + step) // step) * ((h - 2 + step) // step) AS BIGINT) AS num_faces, step = 1 AS exact FROM hh, s")
def _(spark, sf):
    cells, m = views.dem(spark, sf, filled=True)
    runs = quality.sweep(cells, m, "events", [("regular", s) for s in STEPS], timed=False)
    return longs(runs.select("input_file", "method_name", "param_step", "input_num_points", "num_vertices", "num_faces", (F.col("max_error") < 1e-9).alias("exact")), "param_step", "input_num_points", "num_vertices", "num_faces")


@query("sweep_methods", f"""WITH {DEM}, n AS (SELECT CAST(h // 2 * 50 AS BIGINT) AS cells, CAST(2 * (h // 2 - 1) * 49 AS BIGINT) AS faces FROM hh)
SELECT 'events' AS input_file, method_name, cells AS input_num_points, cells AS num_vertices, faces AS num_faces, true AS exact FROM n, (VALUES ('regular'), ('terra'), ('zemlya')) t(method_name)""")
def _(spark, sf):
    """Every method at its exact parameter over the means of blocks: all cells are vertices."""
    cells, m = raster.downsample(*views.dem(spark, sf, filled=True), 2)
    runs = quality.sweep(cells, m, "events", [("regular", 1), ("terra", 0.0), ("zemlya", 0.0)], timed=False)
    return longs(runs.select("input_file", "method_name", "input_num_points", "num_vertices", "num_faces", (F.col("max_error") < 1e-9).alias("exact")), "input_num_points", "num_vertices", "num_faces")


@query("stats_row", f"""WITH {drawn_sql(2)} SELECT 'events' AS input_file, 'regular' AS method_name, any_value(h * 100)::BIGINT AS input_num_points, 100::BIGINT AS input_width, any_value(h)::BIGINT AS input_height, NULL::DOUBLE AS param_max_error, NULL::DOUBLE AS param_threshold, 2::BIGINT AS param_step,
round(avg(z - m), 6) AS mean_error, round(stddev_pop(z - m), 6) AS std_dev_error, round(max(abs(z - m)), 5) AS max_error, any_value(51 * (h // 2 + 1))::BIGINT AS num_vertices, any_value(2 * 50 * (h // 2))::BIGINT AS num_faces FROM drawn WHERE row BETWEEN 2 AND h - 3 AND col BETWEEN 2 AND 97""")
def _(spark, sf):
    row = quality.stats_row(*views.dem(spark, sf, filled=True), "events", "regular", 2, timed=False).drop("meshing_time_seconds")
    return longs(rounded(rounded(row, "mean_error", "std_dev_error"), "max_error", digits=5), "input_num_points", "input_width", "input_height", "param_step", "num_vertices", "num_faces")


@query("method_registry", "SELECT * FROM (VALUES ('regular', CAST(15 AS BIGINT)), ('terra', 17), ('zemlya', 17)) t(method_name, n)")
def _(spark, sf):
    return quality.plan_sweep(spark, ["a"]).groupBy("method_name").agg(F.count("*").alias("n"))


@query("sweep_plan_resume", "SELECT i AS input_file, CAST(k AS BIGINT) AS k FROM (VALUES ('a'), ('b')) t(i), (VALUES (1), (2), (3)) u(k) WHERE NOT (i = 'a' AND k = 2)")
def _(spark, sf):
    done = spark.createDataFrame([("a", "regular", None, 2)], "input_file string, method_name string, param_max_error double, param_step int")
    return longs(quality.plan_sweep(spark, ["a", "b"], skip=["terra"], only=["regular", "terra"], parameters=[1, 2, 3], done=done).select("input_file", "k"), "k")


# Statistics made from a table with as many rows as events: a run a row
STATS = "st AS (SELECT event_type AS input_file, CASE user_id % 3 WHEN 0 THEN 'terra' WHEN 1 THEN 'zemlya' ELSE 'regular' END AS method_name, event_id % 17 AS param_max_error, 10000 AS input_num_points, value / 10 AS mean_error, value / 7 + 1 AS std_dev_error, event_id % 5000 + 10 AS num_faces, event_id AS t FROM events)"


def stats(spark, sf):
    name = F.when(F.col("user_id") % 3 == 0, "terra").when(F.col("user_id") % 3 == 1, "zemlya").otherwise("regular")
    return views.events(spark, sf).select(F.col("event_type").alias("input_file"), name.alias("method_name"), (F.col("event_id") % 17).alias("param_max_error"), F.lit(10000).alias("input_num_points"), (F.col("value") / 10).alias("mean_error"), (F.col("value") / 7 + 1).alias("std_dev_error"), (F.col("event_id") % 5000 + 10).alias("num_faces"), F.col("event_id").alias("t"))


@query("polygon_efficiency", f"WITH {STATS}, r AS (SELECT t, num_faces / 10000e0 AS f, sqrt(mean_error * mean_error + std_dev_error * std_dev_error) AS rms FROM st) SELECT t, round(rms, 6) AS rms, round(f * rms, 6) AS polygon_usage, round(1 / (f + f * rms), 5) AS polygon_efficiency FROM r")
def _(spark, sf):
    return quality.with_efficiency(stats(spark, sf)).select("t", F.round("rms", 6).alias("rms"), F.round("polygon_usage", 6).alias("polygon_usage"), F.round("polygon_efficiency", 5).alias("polygon_efficiency"))


@query("method_names", f"WITH {STATS} SELECT DISTINCT method_name FROM st")
def _(spark, sf):
    return quality.names(stats(spark, sf), "method_name")


@query("method_compare", f"WITH {STATS}, m AS (SELECT param_max_error, method_name, max(num_faces) AS n FROM st GROUP BY ALL) SELECT a.param_max_error, a.n AS terra, b.n AS zemlya FROM m a JOIN m b ON a.param_max_error = b.param_max_error AND a.method_name = 'terra' AND b.method_name = 'zemlya'")
def _(spark, sf):
    best = stats(spark, sf).groupBy("param_max_error", "method_name").agg(F.max("num_faces").alias("n"))
    return quality.compare_methods(best, "param_max_error", "n", "terra", "zemlya")


@query("series_sorted", f"WITH {STATS} SELECT t AS x, round(mean_error, 6) AS y FROM st WHERE method_name = 'terra'")
def _(spark, sf):
    return rounded(quality.series(stats(spark, sf), "terra", "t", "mean_error"), "y")


@query("series_by_method", f"WITH {STATS}, m AS (SELECT method_name, param_max_error AS x, max(num_faces) AS y FROM st GROUP BY ALL) SELECT method_name, array_to_string(list(x ORDER BY x DESC), ',') AS xs, array_to_string(list(y ORDER BY x DESC), ',') AS ys FROM m GROUP BY ALL")
def _(spark, sf):
    best = stats(spark, sf).groupBy("method_name", "param_max_error").agg(F.max("num_faces").alias("n"))
    s = quality.series_by_method(best, "param_max_error", "n")
    return s.select("method_name", *(F.array_join(c, ",").alias(c) for c in ("xs", "ys")))
