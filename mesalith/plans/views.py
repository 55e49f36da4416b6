"""Rasters, points and meshes made from the driver's tables, for the registered queries, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesalith.functions.grid import Meta
from mesalith.operators import dense, mesh

POS_X, POS_Y, CELL, WIDTH = -13636677.018, 4543905.659, 3.91694, 100
ZOOM = 17


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def meta(spark: SparkSession, sf: str) -> Meta:
    """The raster's header: the row count comes from the files' footers."""
    return Meta(WIDTH, events(spark, sf).count() // WIDTH, POS_X, POS_Y, CELL)


def dem(spark: SparkSession, sf: str, filled: bool = False) -> tuple[DataFrame, Meta]:
    """events as a raster of 100 columns; errors are no data (filled: 0)."""
    z = F.when(F.col("event_type") != "error", F.col("value"))
    cells = events(spark, sf).select(F.expr(f"cast(event_id div {WIDTH} as int)").alias("row"), (F.col("event_id") % WIDTH).cast("int").alias("col"), (F.coalesce(z, F.lit(0.0)) if filled else z).alias("z"))
    return cells, meta(spark, sf)


def embedded(spark: SparkSession, sf: str) -> tuple[DataFrame, Meta]:
    """embeddings as a raster of signed values."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    return df.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "z")).withColumn("z", F.col("z").cast("double")), Meta(64, df.count())


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of all cells, with event_id as id; null heights too."""
    cells, m = dem(spark, sf)
    return cells.select((F.col("row").cast("long") * WIDTH + F.col("col")).alias("id"), (F.lit(m.pos_x) + (F.col("col") + 0.5) * m.cell_size).alias("x"), (F.lit(m.pos_y) + ((m.height - 1 - F.col("row")) + 0.5) * m.cell_size).alias("y"), "z")


def dense_mesh(spark: SparkSession, sf: str, step: int) -> tuple[DataFrame, DataFrame, Meta]:
    cells, m = dem(spark, sf, filled=True)
    return *dense.dense_mesh(cells, m, step), m


def triangles(spark: SparkSession, sf: str, step: int) -> DataFrame:
    v, f, _ = dense_mesh(spark, sf, step)
    return mesh.compose(v, f)


# The same as SQL ------------------------------------------------------------------------------------------------------

DEM = """hh AS (SELECT CAST(count(*) // 100 AS INTEGER) AS h FROM events),
dem AS (SELECT CAST(event_id // 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col, CASE WHEN event_type <> 'error' THEN value END AS z FROM events),
demz AS (SELECT row, col, coalesce(z, 0) AS z FROM dem)"""
EMB = """emb AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(unnest(range(len(embedding))) AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)"""
X, Y = "(-13636677.018e0 + (col + 0.5e0) * 3.91694e0)", "(4543905.659e0 + ((h - 1 - row) + 0.5e0) * 3.91694e0)"
PTS = f"{DEM}, pts AS (SELECT CAST(row AS BIGINT) * 100 + col AS id, {X} AS x, {Y} AS y, z FROM dem, hh)"


def mesh_sql(step: int) -> str:
    """CTEs dv (vertices), df (faces), tri (triangles with corners ax .. cz) of the dense mesh."""
    across = -(-(WIDTH - 1) // step) + 1
    return f"""{DEM}, dv AS (SELECT CAST(((row + {step - 1}) // {step}) * {across} + (col + {step - 1}) // {step} AS BIGINT) AS vid, {X} AS x, {Y} AS y, z FROM demz, hh
 WHERE (row % {step} = 0 OR row = h - 1) AND (col % {step} = 0 OR col = 99)),
rs AS (SELECT unnest(range((h - 1 + {step - 1}) // {step})) AS r FROM hh), cs AS (SELECT unnest(range({across - 1})) AS c),
sq AS (SELECT r * {across - 1} + c AS s, (r + 1) * {across} + c + 1 AS v FROM rs, cs),
df AS (SELECT s * 2 AS fid, v AS v0, v - {across} AS v1, v - {across + 1} AS v2 FROM sq UNION ALL SELECT s * 2 + 1, v, v - {across + 1}, v - 1 FROM sq),
tri AS (SELECT fid AS tid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM df JOIN dv a ON v0 = a.vid JOIN dv b ON v1 = b.vid JOIN dv c ON v2 = c.vid)"""


#: Drawn dense mesh: its triangles' corners are cells, so a cell's height is a plane over the square it lies in.
SIZE = "(2 * 20037508.342789243e0 / 131072)"
