"""Point sets (x, y, z): axes, grid inference, close pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesalith.functions.grid import Meta


def bbox(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")))


def from_raster(points: DataFrame) -> DataFrame:
    """Valid points only."""
    return points.where("z is not null").select("x", "y", "z")


#: Ranges of about equal size that distinct coordinates are ordered in.
RANGES = 64


def _ranged(points: DataFrame, name: str) -> DataFrame:
    """(v, part): distinct coordinates and the range of values they fall in; the cuts are one row."""
    v = points.select(F.col(name).alias("v")).where("v is not null").distinct()
    cuts = v.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)]).alias("cuts"))
    return v.crossJoin(F.broadcast(cuts)).select("v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))  # one row


def axis(points: DataFrame, name: str) -> DataFrame:
    """(v, k): distinct coordinates with their rank, x rising, y falling. They are ranked within ranges, whose counts give the first rank of each; no task orders them all."""
    v = _ranged(points, name)
    down = name == "y"
    counts = v.groupBy("part").agg(F.count("*").alias("n"))
    order = lambda c: F.col(c).desc() if down else F.col(c).asc()
    before = counts.select("part", (F.sum("n").over(Window.orderBy(order("part"))) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order("v"))) - 1
    return v.join(F.broadcast(before), "part").select("v", (F.col("before") + rank).cast("int").alias("k"))  # a row for each range


def axis_gap(points: DataFrame, name: str) -> DataFrame:
    """(gap, low, high): smallest non-zero difference of neighbouring coordinates (null if there is one only), and the ends. Neighbours are found within ranges, then between the ends of ranges."""
    v = _ranged(points, name).withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("part").orderBy("v")))
    parts = v.groupBy("part").agg(F.min(F.when(F.col("d") > 0, F.col("d"))).alias("d"), F.min("v").alias("low"), F.max("v").alias("high"))
    steps = parts.withColumn("e", F.col("low") - F.lag("high").over(Window.orderBy("part")))
    return steps.agg(F.min(F.least("d", F.when(F.col("e") > 0, F.col("e")))).alias("gap"), F.min("low").alias("low"), F.max("high").alias("high"))


def infer_grid(points: DataFrame, most_cells: int = 1 << 40) -> Meta:
    """The raster that points lie on: spacing is the smallest gap of each axis, the cell size their mean. One row comes to the driver."""
    x, y = (axis_gap(points, c).first() for c in ("x", "y"))
    if x.low is None:
        return Meta(0, 0)
    dx, dy = x.gap or y.gap or 1.0, y.gap or x.gap or 1.0
    w, h = (int(1 + round((a.high - a.low) / d, 6)) for a, d in ((x, dx), (y, dy)))
    if w * h > most_cells:
        raise ValueError(f"points don't lie on a grid: {w} x {h} cells")
    cell = (dx + dy) / 2
    return Meta(w, h, x.low - dx / 2, y.low - dy / 2, cell)


def to_raster(points: DataFrame, m: Meta | None = None, order: str | None = None, compat: bool = False) -> tuple[DataFrame, Meta]:
    """(row, col, z) of the cells that have a point; of several in a cell the one that comes last by `order` (else the highest).

    compat: positions are truncated instead of rounded to the nearest cell.
    """
    m = m or infer_grid(points)
    if not m.width:
        return points.limit(0).select(F.lit(0).alias("row"), F.lit(0).alias("col"), "z"), m
    low_x, low_y = m.bbox[:2]
    near = (lambda v: v.cast("int")) if compat else (lambda v: F.round(v).cast("int"))
    placed = points.where("z is not null").select(near((F.col("x") - low_x) / m.cell_size).alias("col"), (m.height - 1 - near((F.col("y") - low_y) / m.cell_size)).alias("row"), "z", (F.col(order) if order else F.col("z")).alias("o"))
    return placed.groupBy("row", "col").agg(F.max_by("z", "o").alias("z")), m


def to_vertex_raster(points: DataFrame) -> DataFrame:
    """(row, col, x, y, z): each point at the ranks of its coordinates."""
    xs, ys = axis(points, "x"), axis(points, "y")
    return points.join(xs.select(F.col("v").alias("x"), F.col("k").alias("col")), "x").join(ys.select(F.col("v").alias("y"), F.col("k").alias("row")), "y").select("row", "col", "x", "y", "z")


def close_pairs(points: DataFrame, distance: float, id_col: str = "id") -> DataFrame:
    """(a, b) with a < b: pairs nearer than `distance` in the plane. Points meet those of the same and the neighbouring grid squares only."""
    at = lambda c: F.floor(F.col(c) / distance)
    own = points.select(F.col(id_col).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), at("x").alias("bx"), at("y").alias("by"))
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    other = (points.select(F.col(id_col).alias("b"), "x", "y", F.explode(near).alias("n")).select("b", "x", "y", (at("x") + F.col("n.i")).alias("bx"), (at("y") + F.col("n.j")).alias("by")))
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    return own.join(other, ["bx", "by"]).where((F.col("a") < F.col("b")) & (dx * dx + dy * dy < distance * distance)).select("a", "b")


def remove(points: DataFrame, gone: DataFrame, id_col: str = "id") -> DataFrame:
    """Points whose id isn't in `gone`."""
    return points.join(gone.select(F.col(gone.columns[0]).alias(id_col)), id_col, "left_anti")
