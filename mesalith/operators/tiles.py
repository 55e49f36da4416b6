"""Map tiles: partition plan, assignment of cells and triangles, heights, clipping, tile meshes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesalith.functions import geom, mercator
from mesalith.functions.grid import Meta
from mesalith.operators import mesh

#: Cells around a partition that are meshed with it; cells that a partition's side has about.
BUFFER, SPAN = 100, 800


def _tile_of(v: float, zoom: int) -> int:
    return math.ceil((v + mercator.HALF) / mercator.resolution(zoom) / mercator.TILE) - 1


def plan(spark: SparkSession, metas: dict[int, Meta], buffer: int = BUFFER) -> DataFrame:
    """(zoom, part_id, min_x .. max_y, tmin_x .. tmax_y): meshing units of each zoom, a box with its buffer and an inclusive range of tiles."""
    rows = []
    for zoom, m in sorted(metas.items()):
        x0, y0, x1, y1 = m.bbox
        tx0, ty0, tx1, ty1 = (_tile_of(v, zoom) for v in (x0, y0, x1, y1))
        rows.append((zoom, max(1, int(m.cell_size * SPAN / mercator.tile_meters(zoom))), tx0, ty0, tx1, ty1, x1, y1, buffer * m.cell_size))
    one = spark.createDataFrame(rows, "zoom int, nt int, tx0 int, ty0 int, tx1 int, ty1 int, x1 double, y1 double, grow double")
    parts = one.withColumn("tx", F.explode(F.sequence("tx0", "tx1", "nt"))).withColumn("ty", F.explode(F.sequence("ty0", "ty1", "nt")))
    low = lambda t: mercator.pixels_to_meters(F.col(t) * float(mercator.TILE), F.col("zoom"))
    high = lambda t: mercator.pixels_to_meters((F.col(t) + F.col("nt")) * float(mercator.TILE), F.col("zoom"))
    upto = lambda t, c: F.when(high(t) > F.col(f"{c}1"), F.col(f"{t}1")).otherwise(F.col(t) + F.col("nt") - 1)
    part_id = (F.expr("(tx - tx0) div nt") * (F.expr("(ty1 - ty0) div nt") + 1) + F.expr("(ty - ty0) div nt")).cast("long")
    return parts.select("zoom", part_id.alias("part_id"), (low("tx") - F.col("grow")).alias("min_x"), (low("ty") - F.col("grow")).alias("min_y"), (F.least(high("tx"), "x1") + F.col("grow")).alias("max_x"),
                        (F.least(high("ty"), "y1") + F.col("grow")).alias("max_y"), F.col("tx").alias("tmin_x"), F.col("ty").alias("tmin_y"), upto("tx", "x").cast("int").alias("tmax_x"), upto("ty", "y").cast("int").alias("tmax_y"))


def cells_to_partitions(cells: DataFrame, metas: dict[int, Meta], parts: DataFrame, chip: int = 256) -> DataFrame:
    """(zoom, part_id, row, col, z): cells (zoom, row, col, z) in every partition whose box has their centre. Partitions are taken apart into chips, and joined on zoom and chip."""
    frame = cells.sparkSession.createDataFrame([(z, m.width, m.height, m.pos_x, m.pos_y, m.cell_size) for z, m in metas.items()], "zoom int, w int, h int, px double, py double, cs double")
    p = parts.join(F.broadcast(frame), "zoom")  # a row for each zoom, at most 22
    c = lambda v: ((F.col(v) - F.col("px")) / F.col("cs") - 0.5)
    r = lambda v: F.col("h") - 1 - ((F.col(v) - F.col("py")) / F.col("cs") - 0.5)
    p = p.select("zoom", "part_id", F.greatest(F.lit(0), F.ceil(c("min_x") - 1e-9)).alias("c0"), F.least(F.col("w") - 1, F.floor(c("max_x") + 1e-9)).alias("c1"),
                 F.greatest(F.lit(0), F.ceil(r("max_y") - 1e-9)).alias("r0"), F.least(F.col("h") - 1, F.floor(r("min_y") + 1e-9)).alias("r1")).where("c0 <= c1 and r0 <= r1")
    over = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {chip}"), F.expr(f"{b} div {chip}")))
    p = p.withColumn("chip_row", over("r0", "r1")).withColumn("chip_col", over("c0", "c1"))
    own = cells.withColumns({"chip_row": F.expr(f"cast(row div {chip} as bigint)"), "chip_col": F.expr(f"cast(col div {chip} as bigint)")})
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    return own.join(p, ["zoom", "chip_row", "chip_col"]).where(inside).select("zoom", "part_id", "row", "col", "z")


def triangles_to_tiles(triangles: DataFrame, zoom: int, margin: float = 0.25) -> DataFrame:
    """Each triangle with the tiles (tx, ty) whose box, grown by `margin` of its width, its own box meets. No join: tiles follow from the box."""
    size = mercator.tile_meters(zoom)
    x0, y0, x1, y1 = geom.bbox(F.col("a"), F.col("b"), F.col("c"))
    eps = 2 * geom.EPS
    first = lambda v: F.ceil((v + mercator.HALF - eps) / size - 1 - margin).cast("int")
    last = lambda v: F.floor((v + mercator.HALF + eps) / size + margin).cast("int")
    return triangles.withColumn("tx", F.explode(F.sequence(first(x0), last(x1)))).withColumn("ty", F.explode(F.sequence(first(y0), last(y1)))).withColumn("zoom", F.lit(zoom))


def z_ranges(tiled: DataFrame) -> DataFrame:
    """Lowest and highest corner of the triangles of each tile, before clipping."""
    z = [F.col(f"{c}.z") for c in mesh.CORNERS]
    return tiled.groupBy("zoom", "tx", "ty").agg(F.min(F.least(*z)).alias("min_z"), F.max(F.greatest(*z)).alias("max_z"))


def normalise(tiled: DataFrame, ranges: DataFrame) -> DataFrame:
    """Corners in the unit cube of their tile; height 0 where the tile is flat. Adds min_z and max_z."""
    size = mercator.tile_meters(F.col("zoom"))
    x0, y0, _, _ = mercator.tile_bounds(F.col("tx"), F.col("ty"), F.col("zoom"))

    def unit(c):
        p = F.col(c)
        return F.struct(((p.x - x0) / size).alias("x"), ((p.y - y0) / size).alias("y"), F.coalesce(F.try_divide(p.z - F.col("min_z"), F.col("max_z") - F.col("min_z")), F.lit(0.0)).alias("z")).alias(c)

    return tiled.join(ranges, ["zoom", "tx", "ty"]).select("zoom", "tx", "ty", "tid", *(unit(c) for c in mesh.CORNERS), "min_z", "max_z")


def clip_arrays(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (n x 3 corners x 3) clipped at the unit square, and the row that each comes from. All triangles of a batch go through each edge together."""
    source = np.arange(len(t))
    for (ox, oy), (dx, dy) in geom.UNIT_EDGES:
        left = dx * (t[:, :, 1] - oy) - dy * (t[:, :, 0] - ox)  # > 0: inside
        inside = left > 1e-15
        n = inside.sum(1)
        whole = (n == 3) | ((n == 2) & (np.abs(np.where(inside, 0.0, left)).max(1) <= 1e-15))
        out, kept = [t[whole]], [source[whole]]
        for k in (1, 2):
            at = np.flatnonzero((n == k) & ~whole)
            if not len(at):
                continue
            odd = (inside[at] if k == 1 else ~inside[at]).argmax(1)  # the corner that is alone on its side comes first
            turn = (odd[:, None] + np.arange(3)) % 3
            p, q, r = (np.take_along_axis(t[at], turn[:, :, None], 1)[:, i] for i in range(3))
            lp, lq, lr = (np.take_along_axis(left[at], turn, 1)[:, i: i + 1] for i in range(3))
            u, w = p + lp / (lp - lq) * (q - p), p + lp / (lp - lr) * (r - p)
            if k == 1:
                on = lambda v, e: np.abs(e) <= 1e-15
                out.append(np.stack([p, np.where(on(q, lq), q, u), np.where(on(r, lr), r, w)], 1))
                kept.append(source[at])
            else:  # what is left is the quadrilateral u, q, r, w
                short = (((u - r) ** 2).sum(1) <= ((w - q) ** 2).sum(1))[:, None, None]
                out += [np.where(short, np.stack([u, q, r], 1), np.stack([u, q, w], 1)), np.where(short, np.stack([u, r, w], 1), np.stack([q, r, w], 1))]
                kept += [source[at], source[at]]
        t, source = np.concatenate(out), np.concatenate(kept)
    order = np.argsort(source, kind="stable")
    return t[order], source[order]


def clip(unit: DataFrame) -> DataFrame:
    """Triangles clipped at the tile; numbered by the triangle they come from. Arrow batches, whole batches at a time: higher-order expressions are evaluated one by one and are far slower (geom.clip_to_unit_square has them)."""
    struct = "struct<x:double,y:double,z:double>"
    keys = ["zoom", "tx", "ty", "tid", "min_z", "max_z"]
    flat = unit.select(*keys, *(F.col(f"{c}.{d}").alias(f"{c}{d}") for c in mesh.CORNERS for d in "xyz"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t, source = clip_arrays(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keys):]], 1).reshape(-1, 3, 3))
            k = np.arange(len(source)) - np.searchsorted(source, source)
            head = [b.column(i).take(pa.array(source)) for i in range(len(keys))]
            head[3] = pa.array(head[3].to_numpy() * 128 + k)
            corner = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(t[:, i, j])) for j in range(3)], list("xyz")) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*head, *corner], names=[*keys, *mesh.CORNERS])

    return flat.mapInArrow(run, f"zoom int, tx int, ty int, tid long, min_z double, max_z double, a {struct}, b {struct}, c {struct}").select("zoom", "tx", "ty", "tid", *mesh.CORNERS, "min_z", "max_z")


def tile_triangles(triangles: DataFrame, zoom: int) -> DataFrame:
    """From triangles in world coordinates to clipped triangles in unit cubes. Tiles that nothing of is left in don't appear."""
    tiled = triangles_to_tiles(triangles, zoom)
    return clip(normalise(tiled, z_ranges(tiled)))


def tile_meshes(clipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of each tile, vertices in the order of first appearance."""
    return mesh.decompose(clipped, ("zoom", "tx", "ty"))


def catalog(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(zoom, tx, ty, n_vertices, n_faces)."""
    keys = ["zoom", "tx", "ty"]
    return vertices.groupBy(*keys).agg(F.count("*").alias("n_vertices")).join(faces.groupBy(*keys).agg(F.count("*").alias("n_faces")), keys)


def header(tiles: DataFrame) -> DataFrame:
    """(zoom, tx, ty, center_x, center_y, center_z, radius, min_z, max_z) from rows with zoom, tx, ty, min_z, max_z: geocentric centre, half the diagonal in Mercator metres."""
    x0, y0, x1, y1 = mercator.tile_bounds(F.col("tx"), F.col("ty"), F.col("zoom"))
    cx, cy, cz = mercator.ecef((x0 + x1) / 2, (y0 + y1) / 2, (F.col("min_z") + F.col("max_z")) / 2)
    size = mercator.tile_meters(F.col("zoom"))
    radius = F.sqrt(2 * size * size + F.pow(F.col("max_z") - F.col("min_z"), F.lit(2.0))) / 2
    return tiles.select("zoom", "tx", "ty", cx.alias("center_x"), cy.alias("center_y"), cz.alias("center_z"), radius.alias("radius"), "min_z", "max_z")
