"""Queries of raster algebra, projection math and point sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from mesalith.functions import grid, mercator
from mesalith.operators import points, raster
from mesalith.plans import views
from mesalith.plans.registry import query
from mesalith.plans.views import DEM, EMB, PTS, X, Y


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def longs(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


BOX = "round(-13636677.018e0 + 0.5e0 * 3.91694e0, 6) AS min_x, round(4543905.659e0 + 0.5e0 * 3.91694e0, 6) AS min_y, {} round(-13636677.018e0 + 99.5e0 * 3.91694e0, 6) AS max_x, round(4543905.659e0 + (h - 0.5e0) * 3.91694e0, 6) AS max_y {}"


@query("raster_scan_meta", f"WITH {DEM} SELECT CAST(100 AS BIGINT) AS width, CAST(h AS BIGINT) AS height, -13636677.018e0 AS pos_x, 4543905.659e0 AS pos_y, 3.91694e0 AS cell_size FROM hh")
def _(spark, sf):
    m = views.meta(spark, sf)
    return spark.createDataFrame([(m.width, m.height, m.pos_x, m.pos_y, m.cell_size)], "width long, height long, pos_x double, pos_y double, cell_size double")


@query("raster_minmax", f"WITH {DEM} SELECT min(z) AS min_z, max(z) AS max_z FROM dem")
def _(spark, sf):
    return raster.min_max(views.dem(spark, sf)[0])


@query("raster_bbox2d", f"WITH {DEM} SELECT {BOX.format('', '')} FROM hh")
def _(spark, sf):
    return rounded(raster.bbox2d(*views.dem(spark, sf)), "min_x", "min_y", "max_x", "max_y")


@query("raster_bbox3d", f"WITH {DEM} SELECT {BOX.format('(SELECT min(z) FROM dem) AS min_z,', ', (SELECT max(z) FROM dem) AS max_z')} FROM hh")
def _(spark, sf):
    return rounded(raster.bbox3d(*views.dem(spark, sf)), "min_x", "min_y", "max_x", "max_y")


@query("raster_count_value", f"WITH {DEM} SELECT count(*) FILTER (z = 0) AS n FROM demz")
def _(spark, sf):
    return raster.count_value(views.dem(spark, sf, filled=True)[0], 0.0)


@query("raster_crop", f"WITH {DEM} SELECT CAST(row - 5 AS BIGINT) AS row, CAST(col - 7 AS BIGINT) AS col, z FROM dem WHERE row >= 5 AND col >= 7")
def _(spark, sf):
    return longs(raster.crop(*views.dem(spark, sf), 7, 5, 1 << 30, 1 << 30)[0], "row", "col")


@query("raster_crop_ll", f"WITH {DEM} SELECT CAST(row - greatest(h - 50, 0) AS BIGINT) AS row, CAST(col AS BIGINT) AS col, z FROM dem, hh WHERE row >= h - 50 AND col < 90")
def _(spark, sf):
    return longs(raster.crop_ll(*views.dem(spark, sf), 0, 0, 90, 50)[0], "row", "col")


@query("raster_flip_x", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(99 - col AS BIGINT) AS col, z FROM dem")
def _(spark, sf):
    return longs(raster.flip_x(*views.dem(spark, sf)), "row", "col")


@query("raster_flip_y", f"WITH {DEM} SELECT CAST(h - 1 - row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, z FROM dem, hh")
def _(spark, sf):
    return longs(raster.flip_y(*views.dem(spark, sf)), "row", "col")


@query("raster_to_points", f"WITH {DEM} SELECT round({X}, 6) AS x, round({Y}, 6) AS y, z FROM dem, hh")
def _(spark, sf):
    return rounded(raster.to_points(*views.dem(spark, sf)), "x", "y")


@query("raster_to_points_corner", f"WITH {DEM} SELECT round({X} - 0.5e0 * 3.91694e0, 6) AS x, round({Y} - 0.5e0 * 3.91694e0, 6) AS y, z FROM dem, hh")
def _(spark, sf):
    return rounded(raster.to_points(*views.dem(spark, sf), corner=True), "x", "y")


@query("nodata_mask", "SELECT CAST(event_id // 100 AS BIGINT) AS row, CAST(event_id % 100 AS BIGINT) AS col, (event_type = 'error' OR value = 0) AS no_data FROM events")
def _(spark, sf):
    z = grid.no_data_to_null(F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")), 0.0)
    return views.events(spark, sf).select(F.expr("event_id div 100").alias("row"), (F.col("event_id") % 100).alias("col"), z.isNull().alias("no_data"))


for n in (2, 4, 8):

    @query(f"downsample_mean_{n}", f"WITH {DEM} SELECT CAST(row // {n} AS BIGINT) AS row, CAST(col // {n} AS BIGINT) AS col, round(avg(z), 6) AS z FROM dem, hh WHERE row < h // {n} * {n} AND col < {100 // n * n} GROUP BY ALL")
    def _(spark, sf, n=n):
        return rounded(longs(raster.downsample(*views.dem(spark, sf), n)[0], "row", "col"), "z")


@query("downsample_compat", f"WITH {EMB} SELECT CAST(row // 4 AS BIGINT) AS row, CAST(col // 4 AS BIGINT) AS col, round(CASE WHEN round(sum(z), 9) > 0 THEN avg(z) END, 6) AS z FROM emb WHERE row < (SELECT count(*) FROM embeddings) // 4 * 4 GROUP BY ALL")
def _(spark, sf):
    return rounded(longs(raster.downsample(*views.embedded(spark, sf), 4, compat=True)[0], "row", "col"), "z")


@query("downsample_signed", f"WITH {EMB} SELECT CAST(row // 4 AS BIGINT) AS row, CAST(col // 4 AS BIGINT) AS col, round(avg(z), 6) AS z FROM emb WHERE row < (SELECT count(*) FROM embeddings) // 4 * 4 GROUP BY ALL")
def _(spark, sf):
    return rounded(longs(raster.downsample(*views.embedded(spark, sf), 4)[0], "row", "col"), "z")


ZOOMS = "zr AS (SELECT CAST(round(log2(156543.04e0 / 3.91694e0)) AS INTEGER) AS hi, CAST(greatest(0, floor(log2(128e0 * pow(2, round(log2(156543.04e0 / 3.91694e0))) / greatest(100, h)))) AS INTEGER) AS lo FROM hh)"


@query("overview_pyramid", f"WITH {DEM}, {ZOOMS}, lv AS (SELECT unnest(range(lo, hi + 1)) AS zoom, hi FROM zr), w AS (SELECT zoom, CAST(pow(2, hi - zoom) AS INTEGER) AS n FROM lv) SELECT CAST(zoom AS BIGINT) AS zoom, CAST(row // n AS BIGINT) AS row, CAST(col // n AS BIGINT) AS col, round(avg(z), 6) AS z FROM dem, hh, w WHERE row < h // n * n AND col < 100 // n * n GROUP BY ALL")
def _(spark, sf):
    return rounded(longs(raster.pyramid(*views.dem(spark, sf))[0], "zoom", "row", "col"), "z")


@query("zoom_levels", f"WITH {DEM}, {ZOOMS} SELECT CAST(lo AS BIGINT) AS min_zoom, CAST(hi AS BIGINT) AS max_zoom FROM zr")
def _(spark, sf):
    m = views.meta(spark, sf)
    return spark.createDataFrame([mercator.zoom_range(m.cell_size, m.width, m.height)], "min_zoom long, max_zoom long")


KERNEL = [[0.0, 1.0, 2.0], [-1.0, 4.0, 1.0], [0.5, -2.0, 0.25]]


@query("convolve_3x3", f"""WITH {DEM}, k(dr, dc, w) AS (VALUES {', '.join(f'({i - 1}, {j - 1}, {v}e0)' for i, r in enumerate(KERNEL) for j, v in enumerate(r))}),
s AS (SELECT d.row - dr AS row, d.col - dc AS col, sum(z * w) AS s FROM dem d, k WHERE z IS NOT NULL GROUP BY ALL)
SELECT CAST(d.row AS BIGINT) AS row, CAST(d.col AS BIGINT) AS col, CASE WHEN d.row BETWEEN 1 AND h - 2 AND d.col BETWEEN 1 AND 98 THEN round(coalesce(s, 0), 6) END AS z FROM dem d CROSS JOIN hh LEFT JOIN s USING (row, col)""")
def _(spark, sf):
    return rounded(longs(raster.convolve(*views.dem(spark, sf), KERNEL), "row", "col"), "z")


@query("max_filter_5", f"""WITH {DEM}, m AS (SELECT a.row, a.col, max(b.z) AS m FROM dem a JOIN dem b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CASE WHEN z >= 0.9e0 * m THEN 1e0 END AS z FROM dem JOIN m USING (row, col)""")
def _(spark, sf):
    return longs(raster.local_max(*views.dem(spark, sf), 5, 0.9, 1.0), "row", "col")


@query("subsample_3x3", f"""WITH {DEM}, n AS (SELECT a.row, a.col, avg(b.z) FILTER (a.row = b.row AND a.col = b.col) AS c, avg(b.z) FILTER (abs(a.row - b.row) + abs(a.col - b.col) = 1) AS x, avg(b.z) FILTER (abs(a.row - b.row) + abs(a.col - b.col) = 2) AS d
 FROM dem a JOIN dem b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round((coalesce(3 * c, 0) + coalesce(2 * x, 0) + coalesce(d, 0)) / nullif((c IS NOT NULL)::INT * 3 + (x IS NOT NULL)::INT * 2 + (d IS NOT NULL)::INT, 0), 6) AS z FROM n""")
def _(spark, sf):
    return rounded(longs(raster.subsample3(*views.dem(spark, sf)), "row", "col"), "z")


@query("cell_xy", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round({X}, 6) AS x, round({Y}, 6) AS y FROM dem, hh")
def _(spark, sf):
    cells, m = views.dem(spark, sf)
    return cells.select(F.col("row").cast("long"), F.col("col").cast("long"), F.round(grid.col_to_x(F.col("col"), m), 6).alias("x"), F.round(grid.row_to_y(F.col("row"), m), 6).alias("y"))


@query("xy_cell", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(row AS BIGINT) AS back_row, CAST(col AS BIGINT) AS back_col, CAST(h - 1 - row AS BIGINT) AS ll_row FROM dem, hh")
def _(spark, sf):
    cells, m = views.dem(spark, sf)
    x, y = grid.col_to_x(F.col("col"), m) + 0.3 * m.cell_size, grid.row_to_y(F.col("row"), m) - 0.3 * m.cell_size
    return longs(cells.select("row", "col", grid.y_to_row(y, m).alias("back_row"), grid.x_to_col(x, m).alias("back_col"), grid.ll_row(F.col("row"), m).alias("ll_row")), "row", "col", "back_row", "back_col", "ll_row")


@query("cell_lookup", f"WITH {DEM} SELECT o.o_orderkey AS key, d.z FROM orders o JOIN dem d ON d.row = o.o_orderkey % (SELECT h FROM hh) AND d.col = o.o_orderkey % 100")
def _(spark, sf):
    cells, m = views.dem(spark, sf)
    keys = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % m.height).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"))
    return keys.join(cells, ["row", "col"]).select("key", "z")


@query("constant_raster", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, 7.5e0 AS z FROM dem")
def _(spark, sf):
    return longs(raster.constant(spark, views.meta(spark, sf), 7.5), "row", "col")


# Projection -----------------------------------------------------------------------------------------------------------

LL = "(SELECT event_id, (event_id % 3600) / 10e0 - 180 AS lon, (event_id % 1700) / 10e0 - 85 AS lat FROM events)"


def lonlat(spark, sf):
    return views.events(spark, sf).select("event_id", ((F.col("event_id") % 3600) / 10.0 - 180).alias("lon"), ((F.col("event_id") % 1700) / 10.0 - 85).alias("lat"))


@query("mercator_forward", f"SELECT event_id, round(lon * 20037508.342789243e0 / 180, 5) AS x, round(ln(tan(pi() / 4 + lat * (pi() / 360))) * 6378137e0, 5) + 0e0 AS y FROM {LL}")
def _(spark, sf):
    x, y = mercator.lonlat_to_meters(F.col("lon"), F.col("lat"))
    return lonlat(spark, sf).select("event_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("mercator_inverse", f"SELECT event_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {LL}")
def _(spark, sf):
    lon, lat = mercator.meters_to_lonlat(*mercator.lonlat_to_meters(F.col("lon"), F.col("lat")))
    return lonlat(spark, sf).select("event_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


RES = "(2 * 20037508.342789243e0 / 256 / 65536)"


@query("pixel_tile", f"""WITH {PTS}, p AS (SELECT id, (x + 20037508.342789243e0) / {RES} AS px, (y + 20037508.342789243e0) / {RES} AS py FROM pts)
SELECT id, round(px, 3) AS px, round(py, 3) AS py, round(256e0 * 65536 - py, 3) AS image_row, CAST(ceil(px / 256) - 1 AS BIGINT) AS tx, CAST(ceil(py / 256) - 1 AS BIGINT) AS ty, round(px * {RES} - 20037508.342789243e0, 5) AS back_x FROM p""")
def _(spark, sf):
    px, py = (mercator.meters_to_pixels(F.col(c), 16) for c in ("x", "y"))
    return views.points(spark, sf).select("id", F.round(px, 3).alias("px"), F.round(py, 3).alias("py"), F.round(mercator.image_row(py, 16), 3).alias("image_row"), mercator.meters_to_tile(F.col("x"), 16).cast("long").alias("tx"), mercator.pixels_to_tile(py).cast("long").alias("ty"), F.round(mercator.pixels_to_meters(px, 16), 5).alias("back_x"))


TB = "(SELECT event_id, event_id % 22 AS z, event_id % CAST(pow(2, event_id % 22) AS BIGINT) AS t FROM events)"


@query("tile_bounds", f"SELECT event_id, round(t * 256e0 * (2 * 20037508.342789243e0 / 256 / pow(2, z)) - 20037508.342789243e0, 4) AS low, round((t + 1) * 256e0 * (2 * 20037508.342789243e0 / 256 / pow(2, z)) - 20037508.342789243e0, 4) AS high, round(2 * 20037508.342789243e0 / pow(2, z), 4) AS size FROM {TB}")
def _(spark, sf):
    t = views.events(spark, sf).select("event_id", (F.col("event_id") % 22).alias("z")).withColumn("t", F.col("event_id") % F.pow(F.lit(2.0), F.col("z")).cast("long"))
    x0, _, x1, _ = mercator.tile_bounds(F.col("t"), F.col("t"), F.col("z"))
    return t.select("event_id", F.round(x0, 4).alias("low"), F.round(x1, 4).alias("high"), F.round(mercator.tile_meters(F.col("z")), 4).alias("size"))


@query("ecef_center", f"""WITH q AS (SELECT event_id, value, radians(lon) AS o, radians(lat) AS a FROM {LL} JOIN (SELECT event_id, value FROM events) USING (event_id)), n AS (SELECT *, 6378137e0 / sqrt(1 - 0.00669437999014e0 * sin(a) * sin(a)) AS n FROM q)
SELECT event_id, round((n + value) * cos(a) * cos(o), 3) + 0e0 AS x, round((n + value) * cos(a) * sin(o), 3) + 0e0 AS y, round((n * (1 - 0.00669437999014e0) + value) * sin(a), 3) + 0e0 AS z FROM n""")
def _(spark, sf):
    df = lonlat(spark, sf).join(views.events(spark, sf).select("event_id", "value"), "event_id")
    xyz = mercator.ecef(*mercator.lonlat_to_meters(F.col("lon"), F.col("lat")), F.col("value"))
    return df.select("event_id", *(F.round(v, 3).alias(n) for n, v in zip("xyz", xyz, strict=True)))


# Points ---------------------------------------------------------------------------------------------------------------


@query("point_bbox", f"WITH {PTS} SELECT round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, min(z) AS min_z, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, max(z) AS max_z FROM pts WHERE z IS NOT NULL")
def _(spark, sf):
    return rounded(points.bbox(points.from_raster(views.points(spark, sf))), "min_x", "min_y", "max_x", "max_y")


@query("raster_points_join", f"WITH {PTS} SELECT round(x, 6) AS x, round(y, 6) AS y, z FROM pts WHERE z IS NOT NULL")
def _(spark, sf):
    return rounded(points.from_raster(views.points(spark, sf)), "x", "y")


@query("axis_values", f"WITH {PTS} SELECT 'x' AS axis, round(x, 6) AS v, row_number() OVER (ORDER BY x) - 1 AS k FROM (SELECT DISTINCT x FROM pts) UNION ALL SELECT 'y', round(y, 6), row_number() OVER (ORDER BY y DESC) - 1 FROM (SELECT DISTINCT y FROM pts)")
def _(spark, sf):
    p = views.points(spark, sf)
    one = lambda c: points.axis(p, c).select(F.lit(c).alias("axis"), F.round("v", 6).alias("v"), F.col("k").cast("long").alias("k"))
    return one("x").unionByName(one("y"))


@query("axis_gap", f"WITH {PTS}, d AS (SELECT DISTINCT y AS v FROM pts), g AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS d FROM d) SELECT round(min(d) FILTER (d > 0), 6) AS gap, round(min(v), 6) AS low, round(max(v), 6) AS high FROM g")
def _(spark, sf):
    return rounded(points.axis_gap(views.points(spark, sf), "y"), "gap", "low", "high")


@query("points_to_raster", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, z FROM dem WHERE z IS NOT NULL")
def _(spark, sf):
    p = views.points(spark, sf)
    return longs(points.to_raster(p, points.infer_grid(p))[0], "row", "col")


@query("vxraster", f"WITH {PTS} SELECT id // 100 AS row, id % 100 AS col, round(x, 6) AS x, round(y, 6) AS y, z FROM pts")
def _(spark, sf):
    return rounded(longs(points.to_vertex_raster(views.points(spark, sf).drop("id")), "row", "col"), "x", "y")


JITTER = f"{PTS}, q AS (SELECT id, x + (id * 7 % 13) / 10e0 AS x, y + (id * 5 % 11) / 10e0 AS y FROM pts)"


@query("close_pairs", f"WITH {JITTER} SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.id < b.id AND b.id - a.id < 400 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 12.96e0")
def _(spark, sf):
    p = views.points(spark, sf)
    return points.close_pairs(p.select("id", (F.col("x") + (F.col("id") * 7 % 13) / 10.0).alias("x"), (F.col("y") + (F.col("id") * 5 % 11) / 10.0).alias("y")), 3.6)


@query("anti_duplicates", f"WITH {JITTER}, g AS (SELECT DISTINCT b.id FROM q a JOIN q b ON a.id < b.id AND b.id - a.id < 400 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 12.96e0) SELECT id FROM q WHERE id NOT IN (SELECT id FROM g)")
def _(spark, sf):
    p = views.points(spark, sf).select("id", (F.col("x") + (F.col("id") * 7 % 13) / 10.0).alias("x"), (F.col("y") + (F.col("id") * 5 % 11) / 10.0).alias("y"))
    return points.remove(p, points.close_pairs(p, 3.6).select("b")).select("id")
