"""Queries of text formats: lines as they are written, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mesalith.functions import text
from mesalith.plans import views
from mesalith.plans.mesh_queries import STATS
from mesalith.plans.raster_queries import longs, rounded
from mesalith.plans.registry import query
from mesalith.plans.views import DEM, PTS, mesh_sql
from mesalith.sources import text as files


def scratch(spark, name: str) -> str:
    """A new path in the warehouse, which all executors share; it goes when the application ends."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    fs.deleteOnExit(top)
    return f"{top.toString()}/data"


@query("tokenize", "SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t[1] AS first, t[-1] AS last FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '') AS t FROM documents)")
def _(spark, sf):
    t = text.tokens(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"))


@query("number_format", "SELECT event_id, printf('%.9f', value) AS long, printf('%.3f', value) AS short FROM events")
def _(spark, sf):
    return views.events(spark, sf).select("event_id", text.fixed(F.col("value"), 9).alias("long"), text.fixed(F.col("value"), 3).alias("short"))


@query("format_parse", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'obj' WHEN 1 THEN 'off' WHEN 2 THEN 'terrain' WHEN 3 THEN NULL WHEN 4 THEN 'geojson' ELSE 'xyz' END AS format FROM events")
def _(spark, sf):
    names = F.array(*map(F.lit, (".OBJ", "off", ".Terrain", "tiff", "GeoJSON", "xyz")))
    return views.events(spark, sf).select("event_id", text.parse_format(F.get(names, (F.col("event_id") % 6).cast("int"))).alias("format"))


@query("strip_home", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '~' || substr(url, 9) ELSE url END AS path FROM pages")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.strip_home(F.col("url"), "https://").alias("path"))


def unit_mesh(spark, sf):
    """The dense mesh in whole cells: its numbers print alike everywhere."""
    v, f, m = views.dense_mesh(spark, sf, 3)
    return v.select("vid", *(F.round((F.col(c) - p) / m.cell_size * 2).alias(c) for c, p in (("x", m.pos_x), ("y", m.pos_y))), F.floor("z").cast("double").alias("z")), f


UNIT = f"{mesh_sql(3)}, uv AS (SELECT vid, CAST(round((x + 13636677.018e0) / 3.91694e0 * 2) AS BIGINT) AS x, CAST(round((y - 4543905.659e0) / 3.91694e0 * 2) AS BIGINT) AS y, CAST(floor(z) AS BIGINT) AS z FROM dv)"
ZEROS = "'.000000000000000000'"


@query("obj_lines", f"WITH {UNIT} SELECT CAST(0 AS BIGINT) AS kind, vid AS id, 'v ' || x || {ZEROS} || ' ' || y || {ZEROS} || ' ' || z || {ZEROS} AS line FROM uv UNION ALL SELECT 1, fid, 'f ' || (v0 + 1) || ' ' || (v1 + 1) || ' ' || (v2 + 1) FROM df")
def _(spark, sf):
    return longs(files.obj_lines(*unit_mesh(spark, sf)), "kind")


@query("off_header", f"WITH {UNIT}, e AS (SELECT v0 AS p, v1 AS q FROM df UNION ALL SELECT v1, v2 FROM df UNION ALL SELECT v2, v0 FROM df) SELECT (SELECT count(*) FROM uv) || ' ' || (SELECT count(*) FROM df) || ' ' || (SELECT count(*) FROM (SELECT DISTINCT least(p, q), greatest(p, q) FROM e)) AS line")
def _(spark, sf):
    return files.off_header(*unit_mesh(spark, sf))


POINT = '{"type":"Feature","geometry":{"type":"Point","coordinates":['


@query("geojson_lines", f"WITH {UNIT} SELECT vid AS id, '{POINT}' || x || '.0,' || y || '.0,' || z || '.0]}},\"properties\":{{\"id\":' || vid || '}}}}' AS feature FROM uv")
def _(spark, sf):
    return files.geojson_features(*unit_mesh(spark, sf)).where("kind = 0").select("id", "feature")


PLACE = " || ',' || ".join(f"'[' || {c}.x || '.0,' || {c}.y || '.0,' || {c}.z || '.0]'" for c in "abca")


@query("geojson_linestrings", f"WITH {UNIT} SELECT fid AS id, '{POINT.replace('Point', 'LineString')}' || {PLACE} || ']}},\"properties\":{{\"id\":' || fid || '}}}}' AS feature FROM df JOIN uv a ON v0 = a.vid JOIN uv b ON v1 = b.vid JOIN uv c ON v2 = c.vid")
def _(spark, sf):
    return files.geojson_features(*unit_mesh(spark, sf)).where("kind = 1").select("id", "feature")


@query("asc_roundtrip", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(z, 6) AS z FROM dem")
def _(spark, sf):
    path = scratch(spark, "asc")
    files.save_lines(files.asc_lines(*views.dem(spark, sf)), path, "n")
    return rounded(longs(files.read_asc(spark, path)[0], "row", "col"), "z")


@query("geotiff_scan", f"WITH {DEM} SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(z, 6) AS z FROM dem")
def _(spark, sf):
    """A GeoTIFF for each hundred rows, read back; rows come from the rasters' positions."""
    import pandas as pd

    from mesalith.functions.grid import Meta
    from mesalith.operators import kernels
    from mesalith.sources import binary

    cells, m = views.dem(spark, sf)

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, first, _ = kernels.as_grid(pdf)
        own = Meta(z.shape[1], z.shape[0], m.pos_x, m.pos_y + (m.height - first - z.shape[0]) * m.cell_size, m.cell_size, 3857)
        return pd.DataFrame({"path": [str(key[0])], "content": [binary.encode_tiff(z, own)]})

    files_ = cells.withColumn("strip", F.expr("row div 100")).groupBy("strip").applyInPandas(encode, "path string, content binary")
    back, metas = binary.decode_rasters(files_, 3857)
    top = F.round(F.lit(m.height) - (F.col("pos_y") - m.pos_y) / m.cell_size - F.col("height"))
    joined = back.join(metas.select("raster_id", top.cast("long").alias("top")), "raster_id")
    return rounded(joined.select((F.col("row") + F.col("top")).alias("row"), F.col("col").cast("long").alias("col"), "z"), "z")


@query("xyz_scan", f"WITH {PTS} SELECT round(x, 3) AS x, round(y, 3) AS y, round(z, 6) AS z FROM pts WHERE z IS NOT NULL AND z <= 10000")
def _(spark, sf):
    path = scratch(spark, "xyz")
    p = views.points(spark, sf)
    p.select(F.concat_ws(" ", *(F.format_string("%.6f", c) for c in "xy"), F.coalesce(F.format_string("%.6f", "z"), F.lit("nan"))).alias("line")).write.text(path)
    return rounded(rounded(files.read_xyz(spark, path), "x", "y", digits=3), "z")


@query("obj_roundtrip", f"WITH {UNIT} SELECT vid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM uv")
def _(spark, sf):
    path = scratch(spark, "obj")
    files.write_mesh(*unit_mesh(spark, sf), path, "obj")
    return files.read_obj(spark, path)[0]


@query("off_roundtrip", f"WITH {UNIT} SELECT fid, v0, v1, v2 FROM df")
def _(spark, sf):
    path = scratch(spark, "off")
    files.write_mesh(*unit_mesh(spark, sf), path, "off")
    return files.read_off(spark, path)[1]


@query("csv_stats_scan", f"WITH {STATS} SELECT input_file, method_name, CAST(param_max_error AS DOUBLE) AS param_max_error, round(mean_error, 6) AS mean_error, CAST(num_faces AS BIGINT) AS num_faces FROM st")
def _(spark, sf):
    from mesalith.operators import quality
    from mesalith.plans.mesh_queries import stats

    path = scratch(spark, "csv")
    s = stats(spark, sf)
    have = {"input_file", "method_name", "input_num_points", "param_max_error", "mean_error", "std_dev_error", "num_faces"}
    kinds = [c.split() for c in quality.STATS.split(", ")]
    files.write_stats(s.select(*((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds)), path)
    return rounded(longs(files.read_stats(spark, path).select("input_file", "method_name", "param_max_error", "mean_error", "num_faces"), "num_faces"), "mean_error")
