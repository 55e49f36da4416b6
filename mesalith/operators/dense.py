"""Dense meshes: a vertex every `step` cells, two faces per square, as pure plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesalith.functions import grid
from mesalith.functions.grid import Meta
from mesalith.operators import raster


def shape(m: Meta, step: int) -> tuple[int, int]:
    """Vertices per column and per row: every step-th cell and the last one."""
    return tuple(-(-(n - 1) // step) + 1 for n in (m.height, m.width))


def dense_mesh(cells: DataFrame, m: Meta, step: int = 1, fill=None) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, v0, v1, v2). Rasters below 2 x 2 give none; step < 1 is an error.

    fill(cells, m) gives heights for no-data cells (row, col, z), for instance kernels.ring_fill; else they are null.
    """
    if step < 1:
        raise ValueError("the step is at least 1")
    spark = cells.sparkSession
    if m.width < 2 or m.height < 2:
        return spark.createDataFrame([], "vid long, x double, y double, z double"), spark.createDataFrame([], "fid long, v0 long, v1 long, v2 long")
    down, across = shape(m, step)
    # the vertex of a cell follows from its own row and column: no join
    on = lambda c, n: (F.col(c) % step == 0) | (F.col(c) == n - 1)
    at = lambda c: F.expr(f"({c} + {step - 1}) div {step}")
    source = cells
    if fill is not None:
        filled = fill(cells, m).select("row", "col", F.col("z").alias("f"))
        source = cells.join(filled, ["row", "col"], "left").withColumn("z", F.coalesce("z", "f"))
    vertices = source.where(on("row", m.height) & on("col", m.width)).select((at("row") * across + at("col")).cast("long").alias("vid"), grid.col_to_x(F.col("col"), m).alias("x"), grid.row_to_y(F.col("row"), m).alias("y"), "z")
    return vertices, faces(spark, down, across)


def faces(spark, down: int, across: int) -> DataFrame:
    """Two faces per square of a grid of vertices, split from the upper left to the lower right."""
    squares = raster.grid_cells(spark, Meta(across - 1, down - 1)).select(((F.col("row") + 1) * across + F.col("col") + 1).cast("long").alias("v"), (F.col("row").cast("long") * (across - 1) + F.col("col")).alias("s"))
    face = lambda k, *v: F.struct((F.col("s") * 2 + k).alias("fid"), *(x.alias(f"v{i}") for i, x in enumerate(v)))
    v = F.col("v")
    both = F.array(face(0, v, v - across, v - across - 1), face(1, v, v - across - 1, v - 1))
    return squares.select(F.explode(both).alias("f")).select("f.*")
