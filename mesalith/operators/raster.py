"""Raster algebra on cells (row, col, z); null is no data, row 0 is the top. Each function returns a DataFrame, and the new Meta where it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesalith.functions import grid, mercator
from mesalith.functions.grid import Meta


def grid_cells(spark: SparkSession, m: Meta) -> DataFrame:
    """All cells (row, col) of a raster."""
    return spark.range(m.width * m.height).select(F.expr(f"cast(id div {m.width} as int)").alias("row"), (F.col("id") % m.width).cast("int").alias("col"))


def constant(spark: SparkSession, m: Meta, value: float) -> DataFrame:
    return grid_cells(spark, m).withColumn("z", F.lit(float(value)))


def crop(cells: DataFrame, m: Meta, col: int, row: int, width: int, height: int) -> tuple[DataFrame, Meta]:
    """The part of the box that lies on the raster (empty if none does), its rows and columns counted anew."""
    c0, r0 = max(0, min(col, m.width)), max(0, min(row, m.height))
    c1, r1 = max(c0, min(col + width, m.width)), max(r0, min(row + height, m.height))
    out = cells.where(F.col("col").between(c0, c1 - 1) & F.col("row").between(r0, r1 - 1)).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
    return out, m.moved(width=c1 - c0, height=r1 - r0, pos_x=m.pos_x + c0 * m.cell_size, pos_y=m.pos_y + (m.height - r1) * m.cell_size)


def crop_ll(cells: DataFrame, m: Meta, col: int, row: int, width: int, height: int) -> tuple[DataFrame, Meta]:
    """crop() with the box's row counted from the bottom."""
    return crop(cells, m, col, m.height - (row + height), width, height)


def flip_x(cells: DataFrame, m: Meta) -> DataFrame:
    return cells.withColumn("col", m.width - 1 - F.col("col"))


def flip_y(cells: DataFrame, m: Meta) -> DataFrame:
    return cells.withColumn("row", m.height - 1 - F.col("row"))


def count_value(cells: DataFrame, value: float) -> DataFrame:
    return cells.agg(F.count_if(F.col("z") == value).alias("n"))


def min_max(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def bbox2d(cells: DataFrame, m: Meta) -> DataFrame:
    """Extents of the cell centres, in one row."""
    x0, y0, x1, y1 = m.bbox
    return cells.sparkSession.range(1).select(F.lit(x0).alias("min_x"), F.lit(y0).alias("min_y"), F.lit(x1).alias("max_x"), F.lit(y1).alias("max_y"))


def bbox3d(cells: DataFrame, m: Meta) -> DataFrame:
    x0, y0, x1, y1 = m.bbox
    return min_max(cells).select(F.lit(x0).alias("min_x"), F.lit(y0).alias("min_y"), "min_z", F.lit(x1).alias("max_x"), F.lit(y1).alias("max_y"), "max_z")


def to_points(cells: DataFrame, m: Meta, corner: bool = False) -> DataFrame:
    """(x, y, z) of all cells, null heights too; corner: of the lower-left corners instead of the centres."""
    half = 0.5 * m.cell_size if corner else 0.0
    return cells.select((grid.col_to_x(F.col("col"), m) - half).alias("x"), (grid.row_to_y(F.col("row"), m) - half).alias("y"), "z")


def downsample(cells: DataFrame, m: Meta, window: int, compat: bool = False, keys: tuple[str, ...] = ()) -> tuple[DataFrame, Meta]:
    """Mean of the valid cells of each window x window block; what doesn't fill a block at the right or bottom is left out.

    compat: blocks whose sum isn't positive become no data, and the lower-left corner isn't moved up by the rows left
    out.
    """
    w, h = m.width // window, m.height // window
    part = cells.where((F.col("col") < w * window) & (F.col("row") < h * window))
    mean = F.avg("z")
    out = (part.groupBy(*keys, F.expr(f"cast(row div {window} as int)").alias("row"), F.expr(f"cast(col div {window} as int)").alias("col"))
           .agg((F.when(F.sum("z") > 0, mean) if compat else mean).alias("z")))
    lost = 0 if compat else m.height - h * window
    return out, m.moved(width=w, height=h, cell_size=m.cell_size * window, pos_y=m.pos_y + lost * m.cell_size)


def pyramid(cells: DataFrame, m: Meta, lowest: int | None = None, highest: int | None = None) -> tuple[DataFrame, dict[int, Meta]]:
    """(zoom, row, col, z) of all overview levels in one plan: cells are dealt to the zooms, one aggregation makes all means."""
    top = mercator.max_zoom(m.cell_size)
    lo, hi = mercator.zoom_range(m.cell_size, m.width, m.height, lowest, highest)
    zooms = {z: 2 ** (top - z) for z in range(lo, hi + 1)}
    metas = {z: m.moved(width=m.width // n, height=m.height // n, cell_size=m.cell_size * n, pos_y=m.pos_y + (m.height % n) * m.cell_size) for z, n in zooms.items()}
    size = F.expr(f"cast(pow(2, {top} - zoom) as int)")
    dealt = cells.select("row", "col", "z", F.explode(F.array(*(F.lit(z) for z in zooms))).alias("zoom")).withColumn("n", size)
    whole = (F.col("col") < F.expr(f"({m.width} div n) * n")) & (F.col("row") < F.expr(f"({m.height} div n) * n"))
    return dealt.where(whole).groupBy("zoom", F.expr("cast(row div n as int)").alias("row"), F.expr("cast(col div n as int)").alias("col")).agg(F.avg("z").alias("z")), metas


def _inner(m: Meta, border: int) -> Column:
    return F.col("row").between(border, m.height - 1 - border) & F.col("col").between(border, m.width - 1 - border)


def spread(cells: DataFrame, m: Meta, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """Each valid cell at each offset (rows, columns, weight): rows (row, col, z, weight) for a stencil's aggregation."""
    table = F.array(*(F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float(k)).alias("weight")) for dr, dc, k in offsets))
    moved = cells.where("z is not null").select("row", "col", "z", F.explode(table).alias("o"))
    return moved.select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "z", F.col("o.weight").alias("weight"))


def convolve(cells: DataFrame, m: Meta, kernel: list[list[float]]) -> DataFrame:
    """Sum of the weighted neighbours; no-data neighbours add nothing, cells whose window leaves the raster are no data. The kernel is square and odd."""
    s = len(kernel) // 2
    if len(kernel) % 2 == 0 or any(len(r) != len(kernel) for r in kernel):
        raise ValueError("the kernel isn't square and odd")
    offsets = [(i - s, j - s, k) for i, r in enumerate(kernel) for j, k in enumerate(r)]
    sums = spread(cells, m, offsets).groupBy("row", "col").agg(F.sum(F.col("z") * F.col("weight")).alias("s"))
    inner = _inner(m, s)
    return cells.select("row", "col").join(sums, ["row", "col"], "left").select("row", "col", F.when(inner, F.coalesce("s", F.lit(0.0))).alias("z"))


def local_max(cells: DataFrame, m: Meta, window: int, factor: float, mark: float) -> DataFrame:
    """`mark` where a cell is at least factor times the largest of its window, else no data. Two passes of one-dimensional frames; borders compare with what there is."""
    s = window // 2
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-s, s)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-s, s)
    high = cells.withColumn("m", F.max("z").over(across)).withColumn("m", F.max("m").over(down))
    return high.select("row", "col", F.when(F.col("z") >= factor * F.col("m"), F.lit(float(mark))).alias("z"))


def subsample3(cells: DataFrame, m: Meta) -> DataFrame:
    """Mean of the cell, the mean of its four neighbours and the mean of the four diagonal ones, weighted 3:2:1; missing ones carry no weight."""
    offsets = [(i, j, 3 - (abs(i) + abs(j))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spot = lambda w: F.avg(F.when(F.col("weight") == w, F.col("z")))
    means = spread(cells, m, offsets).groupBy("row", "col").agg(spot(3).alias("c"), spot(2).alias("x"), spot(1).alias("d"))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in (("c", 3), ("x", 2), ("d", 1))), F.lit(0))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in (("c", 3), ("x", 2), ("d", 1))), F.lit(0.0))
    return cells.select("row", "col").join(means, ["row", "col"], "left").select("row", "col", F.try_divide(total, weight).alias("z"))


def chips(cells: DataFrame, m: Meta, size: int, halo: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells with the chips (chip_row, chip_col) they belong to, the halo around a chip included: the unit for grouped kernels."""
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)), F.least(F.lit((n - 1) // size), F.floor((F.col(c) + halo) / size)))
    return cells.withColumn("chip_row", F.explode(span("row", m.height))).withColumn("chip_col", F.explode(span("col", m.width)))
