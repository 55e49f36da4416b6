"""Command line: dem2tin, dem2tintiles, benchmark, version."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesalith import __version__
from mesalith.functions.grid import Meta
from mesalith.functions.text import output_format, parsed_format
from mesalith.operators import dense, kernels, mesh, points, quality, raster, tiles
from mesalith.sources import binary
from mesalith.sources import text as files

LOG = logging.getLogger("mesalith")


def load(spark: SparkSession, path: str, kind: str = "auto", check_srid: int | None = None) -> tuple[DataFrame, Meta]:
    """Cells and Meta of an ASCII grid, XYZ points or a GeoTIFF; the format follows the option, else the extension."""
    found = parsed_format(kind) if kind != "auto" else parsed_format(path.rpartition(".")[2])
    if found == "asc":
        return files.read_asc(spark, path)
    if found == "xyz":
        return points.to_raster(files.read_xyz(spark, path))
    cells, metas = binary.read_geotiff(spark, path, check_srid)
    m = metas.limit(2).collect()
    if len(m) != 1:
        raise ValueError(f"not one raster: {path}")
    return cells.drop("raster_id"), Meta(*(m[0][k] for k in ("width", "height", "pos_x", "pos_y", "cell_size", "srid")))


def mesh_of(cells: DataFrame, m: Meta, method: str, max_error: float | None, step: int) -> tuple[DataFrame, DataFrame]:
    if method == "dense":
        return dense.dense_mesh(cells, m, step, kernels.ring_fill)
    v, f = kernels.mesh_groups(cells.withColumn("g", F.lit(0)), m, ("g",), method, max_error, keep=True)  # one mesh is one group by definition
    return v.drop("g"), f.drop("g")


def dem2tin(spark: SparkSession, a: argparse.Namespace) -> int:
    kind = output_format(a.output_format, a.output)
    cells, m = load(spark, a.input, a.input_format)
    v, f = mesh_of(cells, m, a.method, a.max_error, a.step)
    if f.isEmpty():
        raise ValueError("the mesh is empty")
    if kind == "terrain":
        box = mesh.bbox(v).first()
        span = [max(box[f"max_{c}"] - box[f"min_{c}"], 1e-9) for c in "xyz"]
        unit = v.select(F.lit(0).alias("zoom"), F.lit(0).alias("tx"), F.lit(0).alias("ty"), "vid", *(((F.col(c) - box[f"min_{c}"]) / s).alias(c) for c, s in zip("xyz", span, strict=True)))
        head = spark.range(1).select(*(F.lit(0).alias(k) for k in ("zoom", "tx", "ty")), *(F.lit((box[f"min_{c}"] + box[f"max_{c}"]) / 2).alias(f"center_{c}") for c in "xyz"), F.lit(sum(s * s for s in span) ** 0.5 / 2).alias("radius"), F.lit(box.min_z).alias("min_z"), F.lit(box.max_z).alias("max_z"))
        keyed = f.select(F.lit(0).alias("zoom"), F.lit(0).alias("tx"), F.lit(0).alias("ty"), "fid", "v0", "v1", "v2")
        binary.write_tiles(binary.encode_tiles(unit, keyed, head), a.output)
    else:
        files.write_mesh(v, f, a.output, kind)
    LOG.info("%s written", a.output)
    return 0


def tile_set(cells: DataFrame, m: Meta, method: str, max_error: float | None, step: int, lowest: int | None, highest: int | None, kind: str = "terrain") -> DataFrame:
    """The tiles of all zooms. Each partition of each zoom is meshed on its own, all in one job a zoom; a tile comes from the partition that has it in its range."""
    spark = cells.sparkSession
    levels, metas = raster.pyramid(cells, m, lowest, highest)
    plan = tiles.plan(spark, metas)
    out = None
    for zoom, zm in metas.items():
        if method == "dense":
            v, f = dense.dense_mesh(levels.where(F.col("zoom") == zoom), zm, step, kernels.ring_fill)
            tri = mesh.compose(v, f)
            clipped = tiles.tile_triangles(tri, zoom)
        else:
            own = plan.where(F.col("zoom") == zoom)
            parts = tiles.cells_to_partitions(levels.where(F.col("zoom") == zoom), {zoom: zm}, own)
            v, f = kernels.mesh_groups(parts, zm, ("part_id",), method, zm.cell_size if max_error is None else max_error, keep=True)
            tri = mesh.compose(v, f, ("part_id",))
            spread = tiles.triangles_to_tiles(tri, zoom).join(F.broadcast(own.select("part_id", "tmin_x", "tmin_y", "tmax_x", "tmax_y")), "part_id")  # metadata: a row per meshing unit
            mine = spread.where(F.col("tx").between(F.col("tmin_x"), F.col("tmax_x")) & F.col("ty").between(F.col("tmin_y"), F.col("tmax_y")))
            clipped = tiles.clip(tiles.normalise(mine, tiles.z_ranges(mine)))
        tv, tf = tiles.tile_meshes(clipped)
        heads = tiles.header(clipped.groupBy("zoom", "tx", "ty").agg(F.first("min_z").alias("min_z"), F.first("max_z").alias("max_z")))
        made = binary.obj_tiles(tv, tf, heads) if kind == "obj" else binary.encode_tiles(tv, tf, heads)
        out = made if out is None else out.unionByName(made)
    return out


def dem2tintiles(spark: SparkSession, a: argparse.Namespace) -> int:
    cells, m = load(spark, a.input, a.input_format, None if a.input.endswith((".asc", ".xyz")) else 3857)
    made = tile_set(cells, m, a.method, a.max_error, a.step, a.min_zoom, a.max_zoom, a.output_format)
    if a.tree:
        binary.write_tile_tree(made, a.output_dir)
    else:
        binary.write_tiles(made, a.output_dir)
    return 0


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    """A statistics row per input, method and parameter; runs that the output has already are left out."""
    path = a.output_dir.rstrip("/") + "/stats"
    try:
        done = files.read_stats(spark, path)
        done.limit(1).collect()
    except Exception as e:  # noqa: BLE001  nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    for name in a.input:
        cells, m = load(spark, name, a.input_format)
        for run in quality.plan_sweep(spark, [name], a.skip_method or (), a.method or (), a.parameter or (), done).orderBy("method_name", "k").collect():  # the plan: methods x parameters
            files.write_stats(quality.stats_row(cells, m, name, run.method_name, run.parameter), path)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mesalith")
    p.add_argument("-v", "--verbose", action="count", default=0)
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("dem2tin", dem2tin), ("dem2tintiles", dem2tintiles), ("benchmark", benchmark)):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--input", required=True, nargs="+" if name == "benchmark" else None)
        c.add_argument("--input-format", default="auto")
        if name == "benchmark":
            c.add_argument("--output-dir", required=True)
            c.add_argument("--method", action="append", choices=list(quality.METHODS))
            c.add_argument("--skip-method", action="append", choices=list(quality.METHODS))
            c.add_argument("--parameter", action="append", type=int)
            continue
        c.add_argument("--method", default="terra", choices=["terra", "zemlya", "dense"])
        c.add_argument("--max-error", type=float)
        c.add_argument("--step", type=int, default=1)
        if name == "dem2tin":
            c.add_argument("--output", required=True)
            c.add_argument("--output-format", default="auto")
        else:
            c.add_argument("--output-dir", required=True)
            c.add_argument("--output-format", default="terrain", choices=["terrain", "obj"])
            c.add_argument("--min-zoom", type=int)
            c.add_argument("--max-zoom", type=int)
            c.add_argument("--tree", action="store_true", help="files zoom/x/y.terrain instead of a table")
    sub.add_parser("version").set_defaults(run=None)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    if a.run is None:
        print(__version__)
        return 0
    if a.command != "benchmark" and a.max_error is not None and a.max_error < 0:
        raise ValueError("max-error is negative")
    spark = spark or SparkSession.builder.appName("mesalith").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    raise SystemExit(main())
