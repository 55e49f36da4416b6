"""Structured Streaming over files of cells: the stateless raster operators, and running per-block means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "raster_id string, row int, col int, z double, at timestamp"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of cells as they arrive."""
    return spark.readStream.schema(CELLS).parquet(path)


def block_means(cells: DataFrame, window: int, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Mean of each raster's blocks of window x window cells per time span; cells later than `late` are left out."""
    blocks = cells.withWatermark("at", late).groupBy(F.window("at", every).alias("span"), "raster_id", F.expr(f"cast(row div {window} as int)").alias("row"), F.expr(f"cast(col div {window} as int)").alias("col"))
    return blocks.agg(F.avg("z").alias("z"), F.count("z").alias("n"))
