"""How well a mesh fits its raster: rasterising, error statistics, parameter sweeps, and analytics of their results."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesalith.functions import geom, grid
from mesalith.functions.grid import Meta
from mesalith.operators import kernels, mesh, raster

#: Columns of a statistics row.
STATS = ("input_file string, method_name string, input_num_points int, input_width int, input_height int, param_max_error double, param_threshold double, param_step int, "
         "meshing_time_seconds double, mean_error double, std_dev_error double, max_error double, num_vertices int, num_faces int")


def to_pixels(triangles: DataFrame, m: Meta, half: bool = False) -> DataFrame:
    """Corners in pixels (x: column, y: row): snapped to whole cells, or half: exact positions with cell centres at .5."""
    def move(c):
        p = F.col(c)
        if half:
            return geom.point((p.x - m.pos_x) / m.cell_size, m.height - (p.y - m.pos_y) / m.cell_size, p.z).alias(c)
        return geom.point(grid.x_to_col(p.x, m), grid.y_to_row(p.y, m), p.z).alias(c)

    return triangles.select("tid", *(move(c) for c in mesh.CORNERS))


def rasterise(triangles: DataFrame, m: Meta, half: bool = False) -> DataFrame:
    """(row, col, z) of the cells that a triangle covers; where several do, the one with the highest tid counts. half: sample cell centres of unsnapped triangles.

    Triangles go to the pieces of the raster that their boxes reach, not one row per cell: a piece is drawn in one task,
    which takes its triangles batch by batch in the order of tid, so only the piece itself is in memory.
    """
    shift, size = 0.5 if half else 0.0, kernels.PIECE
    p = to_pixels(triangles, m, half)
    x0, y0, x1, y1 = geom.bbox(F.col("a"), F.col("b"), F.col("c"))
    first = lambda v: F.greatest(F.ceil(v - shift).cast("int"), F.lit(0))
    last = lambda v, n: F.least(F.floor(v - shift).cast("int"), F.lit(n - 1))
    span = lambda a, b, n: F.when(first(a) <= last(b, n), F.sequence(F.floor(first(a) / size).cast("int"), F.floor(last(b, n) / size).cast("int")))
    flat = [f"{c}{d}" for c in mesh.CORNERS for d in "xyz"]
    spread = p.withColumn("piece_row", F.explode(span(y0, y1, m.height))).withColumn("piece_col", F.explode(span(x0, x1, m.width))).select("piece_row", "piece_col", "tid", *(F.col(f"{c[0]}.{c[1]}").alias(c) for c in flat))
    return kernels.dealt(spread, "piece_row", "piece_col").sortWithinPartitions("piece_row", "piece_col", "tid").mapInPandas(functools.partial(_draw_pieces, m=m, size=size, shift=shift), "row int, col int, z double")


def _draw_pieces(batches: Iterator[pd.DataFrame], m: Meta, size: int, shift: float) -> Iterator[pd.DataFrame]:
    """Cells of the pieces, whose triangles come one piece after another."""
    at, out = None, None

    def cells() -> pd.DataFrame:
        row, col = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"row": row + at[0] * size, "col": col + at[1] * size, "z": out[row, col]})

    for pdf in batches:
        keys, t = pdf[["piece_row", "piece_col"]].to_numpy(), pdf.iloc[:, 3:].to_numpy(float).reshape(-1, 3, 3)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
            piece = (int(keys[i, 0]), int(keys[i, 1]))
            if piece != at:
                if at is not None:
                    yield cells()
                at, out = piece, np.full((min(size, m.height - piece[0] * size), min(size, m.width - piece[1] * size)), np.nan)
            kernels.draw(out, t[i:j], shift, (at[0] * size, at[1] * size))
    if at is not None:
        yield cells()


def mesh_meta(box, width: int, height: int, original_width: int | None = None) -> Meta:
    """The raster that a mesh with this box (min_x, min_y, max_x, max_y) is drawn on; the cell size follows from the width."""
    w = box[2] - box[0]
    first = w / ((original_width or width) - 1)
    return Meta(width, height, box[0] - first / 2, box[1] - first / 2, (w + first) / width)


def oversampled(triangles: DataFrame, m: Meta, factor: int) -> tuple[DataFrame, Meta]:
    """Drawn on cells `factor` times smaller, then the means of these."""
    fine = m.moved(width=m.width * factor, height=m.height * factor, cell_size=m.cell_size / factor)
    return raster.downsample(rasterise(triangles, fine), fine, factor)


def differences(cells: DataFrame, drawn: DataFrame, m: Meta, border: int = 2) -> DataFrame:
    """(row, col, d): raster less mesh where both are valid, away from the border."""
    inner = F.col("row").between(border, m.height - 1 - border) & F.col("col").between(border, m.width - 1 - border)
    return cells.where("z is not null").where(inner).join(drawn.where("z is not null").withColumnRenamed("z", "drawn"), ["row", "col"]).select("row", "col", (F.col("z") - F.col("drawn")).alias("d"))


def measure_error(cells: DataFrame, drawn: DataFrame, m: Meta) -> DataFrame:
    """Mean, population deviation and largest absolute difference, in one row; nulls if nothing can be compared."""
    return differences(cells, drawn, m).agg(F.avg("d").alias("mean_error"), F.stddev_pop("d").alias("std_dev_error"), F.max(F.abs("d")).alias("max_error"))


def rms_error(cells: DataFrame, drawn: DataFrame, m: Meta) -> DataFrame:
    d = differences(cells, drawn, m)
    return d.agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.max(F.abs("d")).alias("max_error"))


# Methods and sweeps ---------------------------------------------------------------------------------------------------


#: Method: its mesher of a piece, the statistics column of its parameter, and the default parameters (fixed values).
METHODS: dict[str, tuple[Callable, str, tuple]] = {
    "regular": (kernels.regular_piece, "param_step", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20)),
    "terra": (functools.partial(kernels.greedy_piece, "terra"), "param_max_error", (0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.5, 2.0, 2.5, 3.0, 5.0, 8.0, 10.0)),
    "zemlya": (functools.partial(kernels.greedy_piece, "zemlya"), "param_max_error", (0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.5, 2.0, 2.5, 3.0, 5.0, 8.0, 10.0)),
}


def plan_sweep(spark: SparkSession, inputs: Iterable[str], skip: Iterable[str] = (), only: Iterable[str] = (), parameters: Iterable[int] = (), done: DataFrame | None = None) -> DataFrame:
    """(input_file, method_name, k, parameter): inputs x methods x parameters (k from 1), but for skipped methods, and without the runs that `done` has already."""
    methods = [(n, k, float(p)) for n, (_, _, ps) in METHODS.items() for k, p in enumerate(ps, 1) if n not in set(skip) and (not set(only) or n in set(only)) and (not set(parameters) or k in set(parameters))]
    runs = spark.createDataFrame([(i,) for i in inputs], "input_file string").crossJoin(spark.createDataFrame(methods, "method_name string, k int, parameter double"))  # both sides are parameters of the call
    return runs if done is None else runs.join(done.select("input_file", "method_name", F.coalesce("param_max_error", F.col("param_step").cast("double")).alias("parameter")), ["input_file", "method_name", "parameter"], "left_anti").select("input_file", "method_name", "k", "parameter")


def stats_row(cells: DataFrame, m: Meta, name: str, method: str, parameter: float, timed: bool = True) -> DataFrame:
    """Mesh, draw and measure: one row of STATS. Parameters that the method doesn't have are null, and so is the time unless timed."""
    return sweep(cells, m, name, [(method, parameter)], timed)


#: What each piece tells of each run: sizes, and count, mean, sum of squares about the mean and largest of its errors.
PART = "run int, seconds double, points long, n long, mean double, squares double, worst double, vertices long, faces long"


def _measure_piece(grids: np.ndarray, first: tuple[int, int], own: tuple, m: Meta, method: str, parameter: float, border: int = 2) -> tuple:
    """(seconds, n, mean, squares, worst, vertices, faces) of a run over the piece `own` of the raster. grids, from the cell `first` on: heights, heights with repaired corners for greedy meshes, 1 where there is a cell."""
    r0, c0 = first
    mesher, column, _ = METHODS[method]
    regular = column == "param_step"
    began = time.perf_counter()
    p, f = mesher(grids[0 if regular else 1], r0, c0, own, m, parameter)
    took = time.perf_counter() - began
    top, left, bottom, right = own
    here = kernels.counts_here(p[:, 1], p[:, 0], own, m)
    if regular:  # a cell that the raster doesn't have is no vertex
        x, y = p[here, 0].astype(int) - left, p[here, 1].astype(int) - top
        here[here] = kernels.window(grids[2], r0, c0, own)[y, x] == 1
    t = p[f]
    faces = int(((t[:, :, 1].min(1) >= top) & (t[:, :, 1].min(1) < bottom) & (t[:, :, 0].min(1) >= left) & (t[:, :, 0].min(1) < right)).sum())
    drawn = np.full((bottom - top + 1, right - left + 1), np.nan)
    kernels.draw(drawn, t, first=(top, left))
    d = kernels.window(grids[0], r0, c0, own) - drawn
    y, x = np.arange(top, bottom + 1)[:, None], np.arange(left, right + 1)[None]
    inner = (y >= border) & (y <= m.height - 1 - border) & (x >= border) & (x <= m.width - 1 - border)
    d = d[inner & kernels.counts_here(y, x, own, m) & ~np.isnan(d)]
    if not len(d):
        return took, 0, 0.0, 0.0, None, int(here.sum()), faces
    return took, len(d), float(d.mean()), float(((d - d.mean()) ** 2).sum()), float(np.abs(d).max()), int(here.sum()), faces


def sweep(cells: DataFrame, m: Meta, name: str, runs: Iterable[tuple[str, float]], timed: bool = True, size: int = kernels.PIECE) -> DataFrame:
    """A row of STATS for each (method, parameter), in one plan; the runs are parameters of the call.

    Each piece of size x size squares is meshed, drawn and measured in one task, so neither a mesh nor a drawn raster is
    ever whole anywhere. Pieces have the lines between them in common, with the same vertices on both sides: together
    they are one mesh. The meshing time is the sum over the pieces, with nothing else in it.
    """
    runs = [(method, float(m.cell_size if p is None else p)) for method, p in runs]
    for method, p in runs:
        if METHODS[method][1] == "param_step" and p < 1:
            raise ValueError("the step is at least 1")
        if METHODS[method][1] == "param_max_error" and p < 0:
            raise ValueError("max_error is negative")
    # dense meshes are made fast, so a piece's task makes them all; each run of a kernel is a task of its own
    dense_runs = [k for k, (method, _) in enumerate(runs) if METHODS[method][1] == "param_step"]
    groups = ([dense_runs] if dense_runs else []) + [[k] for k in range(len(runs)) if k not in dense_runs]
    runs = [(method, int(p) if k in dense_runs else p) for k, (method, p) in enumerate(runs)]
    halo = max([1, *(runs[k][1] for k in dense_runs)])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, piece_row, piece_col = (int(k) for k in key)
        r, c, repair = (pdf[k].to_numpy() for k in ("row", "col", "repair"))
        r0, c0, plain = int(r.min()), int(c.min()), np.isnan(repair)
        grids = np.full((3, int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)  # heights, heights with repaired corners, 1 where there is a cell
        grids[0, r[plain] - r0, c[plain] - c0] = pdf["z"].to_numpy(float)[plain]
        grids[1] = grids[0]
        grids[1, r[~plain] - r0, c[~plain] - c0] = repair[~plain]
        grids[2, r[plain] - r0, c[plain] - c0] = 1
        points = int((plain & ~np.isnan(pdf["z"].to_numpy(float)) & (r // size == piece_row) & (c // size == piece_col)).sum())
        own = kernels.piece_box(piece_row, piece_col, m, size)
        out = []
        for k in groups[g]:
            took, *told = (0.0, 0, 0.0, 0.0, None, 0, 0) if own is None else _measure_piece(grids, (r0, c0), own, m, *runs[k])
            out.append((k, took, points, *told))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PART.split(", ")]).astype({"worst": float})

    source = kernels.with_corners(cells, m, size) if len(dense_runs) < len(runs) else cells.select("row", "col", "z", F.lit(None).cast("double").alias("repair"))
    spread = raster.chips(source, m, size, halo).withColumn("g", F.explode(F.array(*(F.lit(g) for g in range(len(groups))))))
    keys = ("g", "chip_row", "chip_col")
    parts = kernels.dealt(spread, *keys).groupBy(*keys).applyInPandas(run, PART)
    none = cells.sparkSession.range(len(runs)).select(F.col("id").cast("int").alias("run"), *(F.lit(None if c == "worst" else 0).cast(kind).alias(c) for c, kind in (x.split() for x in PART.split(", ")[1:])))  # for rasters without cells
    w = Window.partitionBy("run")  # sees a row per piece
    parts = parts.unionByName(none).withColumn("total", F.sum("n").over(w)).withColumn("centre", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(w), F.col("total")))
    gap = F.col("mean") - F.col("centre")
    whole = parts.groupBy("run").agg(F.sum("points").alias("points"), F.sum("seconds").alias("seconds"), F.max("centre").alias("mean_error"),
                                     F.sqrt(F.try_divide(F.sum(F.col("squares") + F.col("n") * gap * gap), F.max("total"))).alias("std_dev_error"), F.max(F.when(F.col("n") > 0, F.col("worst"))).alias("max_error"), F.sum("vertices").alias("vertices"), F.sum("faces").alias("faces"))
    of = lambda values: F.get(F.array(*values), F.col("run"))
    value = lambda c, kind: of([F.lit(p if METHODS[method][1] == c else None).cast(kind) for method, p in runs]).alias(c)
    return whole.select(F.lit(name).alias("input_file"), of([F.lit(method) for method, _ in runs]).alias("method_name"), F.col("points").cast("int").alias("input_num_points"), F.lit(m.width).alias("input_width"), F.lit(m.height).alias("input_height"),
                        value("param_max_error", "double"), value("param_threshold", "double"), value("param_step", "int"), (F.col("seconds") if timed else F.lit(None).cast("double")).alias("meshing_time_seconds"),
                        "mean_error", "std_dev_error", "max_error", F.col("vertices").cast("int").alias("num_vertices"), F.col("faces").cast("int").alias("num_faces"))


# Analytics of statistics ----------------------------------------------------------------------------------------------


def rms(stats: DataFrame) -> Column:
    return F.sqrt(F.col("mean_error") * F.col("mean_error") + F.col("std_dev_error") * F.col("std_dev_error"))


def with_efficiency(stats: DataFrame) -> DataFrame:
    """Adds rms, polygon_usage (faces x rms a point) and polygon_efficiency."""
    per = F.try_divide(F.col("num_faces").cast("double"), F.col("input_num_points"))
    out = stats.withColumn("rms", rms(stats)).withColumn("polygon_usage", per * F.col("rms"))
    return out.withColumn("polygon_efficiency", F.try_divide(F.lit(1.0), per + F.col("polygon_usage")))


def names(stats: DataFrame, column: str) -> DataFrame:
    return stats.select(column).distinct()


def series(stats: DataFrame, method: str, x: str, y: str) -> DataFrame:
    """(x, y) of a method, x falling."""
    return stats.where(F.col("method_name") == method).select(F.col(x).alias("x"), F.col(y).alias("y")).orderBy(F.col("x").desc())


def series_by_method(stats: DataFrame, x: str, y: str) -> DataFrame:
    """(method_name, xs, ys): a sorted series per method; a method has as many points as parameters."""
    points = stats.groupBy("method_name").agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), asc=False).alias("s"))
    return points.select("method_name", F.transform("s", lambda p: p.x).alias("xs"), F.transform("s", lambda p: p.y).alias("ys"))


def compare_methods(stats: DataFrame, by: str, value: str, first: str, second: str) -> DataFrame:
    """(by, first, second): the value of two methods side by side, where both have a row."""
    return stats.groupBy(by).pivot("method_name", [first, second]).agg(F.first(value)).where(F.col(first).isNotNull() & F.col(second).isNotNull())
