"""Text formats: ESRI ASCII grid, XYZ points, OBJ, OFF, GeoJSON, statistics CSV. Files are read in parallel, one row a line where the format allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesalith.functions import grid, text
from mesalith.functions.grid import Meta
from mesalith.operators import mesh, quality


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, at, line): lines of one file, which is read in splits; within a split (block: its first byte) `at` rises with the line."""
    return spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _ranked(lines: DataFrame, name: str) -> DataFrame:
    """lines with their number from 0 in file order: ranks within a split, and counts of the splits before it (a row each)."""
    counts = lines.groupBy("block").agg(F.count("*").alias("n"))
    before = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    return lines.join(before, "block").withColumn(name, (F.col("before") + rank).cast("long")).drop("before")


def numbers(line: Column) -> Column:
    return F.transform(text.tokens(line), lambda t: t.try_cast("double"))


# ASCII grid -----------------------------------------------------------------------------------------------------------

#: Header names of an ASCII grid; fixed values.
ASC_HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def read_asc(spark: SparkSession, path: str) -> tuple[DataFrame, Meta]:
    """Cells (row, col, z) and Meta of an ASCII grid. The header is read by name, in any order; the lines after it are rows from the top."""
    lines = _lines(spark, path).withColumn("t", text.tokens(F.col("line"))).where(F.size("t") > 0)
    named = F.lower(F.element_at("t", 1)).isin(*ASC_HEADER) & (F.size("t") == 2)
    head = {r.k: float(r.v) for r in lines.where(named).limit(len(ASC_HEADER)).select(F.lower(F.element_at("t", 1)).alias("k"), F.element_at("t", 2).alias("v")).collect()}
    if not {"ncols", "nrows", "cellsize"} <= set(head):
        raise ValueError(f"no ASCII grid: {path}")
    cell = head["cellsize"]
    x = head.get("xllcorner", head.get("xllcenter", 0.0) - (cell / 2 if "xllcenter" in head else 0.0))
    y = head.get("yllcorner", head.get("yllcenter", 0.0) - (cell / 2 if "yllcenter" in head else 0.0))
    m = Meta(int(head["ncols"]), int(head["nrows"]), x, y, cell)
    body = _ranked(lines.where(~named), "n").withColumn("row", F.col("n").cast("int"))
    cells = body.where(F.col("row") < m.height).select("row", F.posexplode(F.slice("t", 1, m.width)).alias("col", "v"))
    return cells.select("row", "col", grid.no_data_to_null(F.col("v").try_cast("double"), head.get("nodata_value")).alias("z")), m


def asc_lines(cells: DataFrame, m: Meta, ndv: float = -9999.0, digits: int = 9) -> DataFrame:
    """(n, line) of an ASCII grid: header, then rows from the top. `cells` has all cells."""
    values = [m.pos_x, m.pos_y, m.cell_size, ndv]
    head = [f"NCOLS {m.width}", f"NROWS {m.height}", *(f"{k} {v:.9f}" for k, v in zip(("XLLCORNER", "YLLCORNER", "CELLSIZE", "NODATA_VALUE"), values, strict=True))]
    first = cells.sparkSession.createDataFrame(list(enumerate(head)), "n int, line string")
    z = F.format_string(f"%.{digits}f", F.coalesce("z", F.lit(ndv)))
    rows = cells.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", z.alias("s")))), lambda c: c.s), " ").alias("line"))
    return first.unionByName(rows.select((F.col("row") + len(head)).alias("n"), "line"))


# XYZ ------------------------------------------------------------------------------------------------------------------


def read_xyz(spark: SparkSession, path: str, limit: float = 10000.0) -> DataFrame:
    """Points of lines with three numbers; heights that are no number or beyond the limit are left out."""
    v = spark.read.text(path).select(numbers(F.col("value")).alias("v")).where(F.size("v") >= 3)
    return v.select(*(F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xyz"))).where("x is not null and y is not null and z is not null and not isnan(z)").where(F.abs("z") <= limit)


# OBJ ------------------------------------------------------------------------------------------------------------------


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of an OBJ file: its `v x y z` and `f i j k` lines in order; indices count from 0 here."""
    t = _lines(spark, path).select("block", "at", text.tokens(F.col("line")).alias("t"))
    at = lambda i, kind: F.get("t", F.lit(i)).try_cast(kind)
    vertices = _ranked(t.where("get(t, 0) = 'v'"), "vid").select("vid", *(at(i + 1, "double").alias(c) for i, c in enumerate("xyz")))
    index = lambda i: (F.regexp_extract(F.get("t", F.lit(i)), r"^\d+", 0).try_cast("long") - 1).alias(f"v{i - 1}")
    return vertices, _ranked(t.where("get(t, 0) = 'f'"), "fid").select("fid", *(index(i) for i in (1, 2, 3)))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(kind, id, line), in the order of kind and id: vertices with 18 decimals, faces with indices from 1."""
    v = vertices.select(F.lit(0).alias("kind"), F.col("vid").alias("id"), F.format_string("v %.18f %.18f %.18f", "x", "y", "z").alias("line"))
    f = faces.select(F.lit(1).alias("kind"), F.col("fid").alias("id"), F.format_string("f %d %d %d", *(F.col(f"v{k}") + 1 for k in range(3))).alias("line"))
    return v.unionByName(f)


# OFF ------------------------------------------------------------------------------------------------------------------


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangular faces of an OFF file; what follows # and blank lines are left out."""
    t = _lines(spark, path).select("block", "at", text.tokens(F.regexp_replace("line", "#.*", "")).alias("t")).where("size(t) > 0")
    t = _ranked(t, "k")
    head = t.where("k = 1").select(F.get("t", F.lit(0)).cast("long").alias("nv")).first()
    if head is None or t.where("k = 0").first().t[0] != "OFF":
        raise ValueError(f"no OFF file: {path}")
    at = lambda i, kind: F.get("t", F.lit(i)).try_cast(kind)
    body = t.where("k > 1").withColumn("k", F.col("k") - 2)
    vertices = body.where(F.col("k") < head.nv).select(F.col("k").alias("vid"), *(at(i, "double").alias(c) for i, c in enumerate("xyz")))
    return vertices, body.where((F.col("k") >= head.nv) & (F.get("t", F.lit(0)) == "3")).select((F.col("k") - head.nv).alias("fid"), *(at(i + 1, "long").alias(f"v{i}") for i in range(3)))


def off_header(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row (line): numbers of vertices, faces and distinct undirected edges."""
    one = vertices.agg(F.count("*").alias("v")).crossJoin(F.broadcast(faces.agg(F.count("*").alias("f")))).crossJoin(F.broadcast(mesh.edges(faces).agg(F.count("*").alias("e"))))  # one row each
    return one.select(F.format_string("%d %d %d", "v", "f", "e").alias("line"))


def off_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    spark = vertices.sparkSession
    out = spark.createDataFrame([(0, 0, "OFF")], "kind int, id long, line string").unionByName(off_header(vertices, faces).select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), "line"))
    v = vertices.select(F.lit(2).alias("kind"), F.col("vid").alias("id"), F.format_string("%.18f %.18f %.18f", "x", "y", "z").alias("line"))
    f = faces.select(F.lit(3).alias("kind"), F.col("fid").alias("id"), F.format_string("3 %d %d %d", "v0", "v1", "v2").alias("line"))
    return out.unionByName(v).unionByName(f)


# GeoJSON --------------------------------------------------------------------------------------------------------------


def geojson_features(vertices: DataFrame, faces: DataFrame, with_z: bool = True) -> DataFrame:
    """(kind, id, feature): a Point per vertex, then a closed LineString per face."""
    place = lambda p: F.array(p.x, p.y, p.z) if with_z else F.array(p.x, p.y)
    make = lambda kind, coords: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry"), F.struct(F.col("id").alias("id")).alias("properties")))
    v = vertices.select(F.lit(0).alias("kind"), F.col("vid").alias("id"), F.struct("x", "y", "z").alias("p")).select("kind", "id", make("Point", place(F.col("p"))).alias("feature"))
    a, b, c = (F.col(k) for k in mesh.CORNERS)
    f = mesh.compose(vertices, faces).select(F.lit(1).alias("kind"), F.col("tid").alias("id"), "a", "b", "c")
    return v.unionByName(f.select("kind", "id", make("LineString", F.array(place(a), place(b), place(c), place(a))).alias("feature")))


def geojson_lines(vertices: DataFrame, faces: DataFrame, srid: int = 3857, with_z: bool = True) -> DataFrame:
    """(kind, id, line) of a FeatureCollection that names the true reference system."""
    spark = vertices.sparkSession
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{srid}"}}}},"features":['
    feats = geojson_features(vertices, faces, with_z)
    last = F.max(F.struct("kind", "id")).alias("last")
    comma = F.when(F.struct("kind", "id") == F.col("last"), F.lit("")).otherwise(F.lit(","))
    body = feats.crossJoin(F.broadcast(feats.agg(last))).select("kind", "id", F.concat("feature", comma).alias("line"))
    return spark.createDataFrame([(-1, 0, head), (9, 0, "]}")], "kind int, id long, line string").unionByName(body)


# Writing --------------------------------------------------------------------------------------------------------------


def save_lines(lines: DataFrame, path: str, *order: str) -> None:
    """One text file, lines in order. Range-partitioned and sorted by Spark; parts are put together by a single writer, as a file is one object."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, kind: str) -> None:
    """Write in the format `kind` (obj, off, json or geojson)."""
    made = {"obj": obj_lines, "off": off_lines, "json": geojson_lines, "geojson": geojson_lines}[kind](vertices, faces)
    save_lines(made, path, "kind", "id")


# Statistics -----------------------------------------------------------------------------------------------------------


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics CSV with or without a header and # comments; nan and -1 stand for null."""
    raw = spark.read.schema(", ".join(f"{p.split()[0]} string" for p in quality.STATS.split(", "))).csv(path, comment="#").where("input_file <> 'input_file'")
    kinds = [p.split() for p in quality.STATS.split(", ")]
    clean = lambda c, kind: F.col(c) if kind == "string" else F.when(~F.lower(F.trim(c)).isin("nan", "-1", ""), F.trim(c)).cast(kind).alias(c)
    return raw.select(*(clean(c, kind) for c, kind in kinds))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.fillna({"param_max_error": float("nan"), "param_threshold": float("nan"), "param_step": -1}).write.mode("append").option("header", True).csv(path)
