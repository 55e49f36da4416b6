"""Meshes in two forms: vertices (vid, x, y, z) with faces (fid, v0, v1, v2), and triangles (tid, a, b, c). `keys` group several meshes in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesalith.functions import geom
from mesalith.operators import spatial

CORNERS = ("a", "b", "c")


def _xyz():
    return F.struct("x", "y", "z")


def compose(vertices: DataFrame, faces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Triangles; faces with an index that no vertex has are left out. One join on the corners, put together by face."""
    corners = faces.select(*keys, "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))
    placed = corners.join(vertices.select(*keys, "vid", "x", "y", "z"), [*keys, "vid"])
    # plain numbers, as structs would be sorted to be aggregated
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{CORNERS[k]}{c}")
    flat = placed.groupBy(*keys, F.col("fid").alias("tid")).agg(*(pick(k, c) for k in range(3) for c in "xyz"), F.count("*").alias("n")).where("n = 3")
    return flat.select(*keys, "tid", *(F.struct(*(F.col(f"{p}{c}").alias(c) for c in "xyz")).alias(p) for p in CORNERS))


def decompose(triangles: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces; equal corners are one vertex, numbered by first appearance (triangle, then corner) within `keys`.

    With keys, each mesh is numbered on its own. Without, positions are numbered within ranges of the first
    appearance, which are counted first; no window goes over the whole table.
    """
    corners = triangles.select(*keys, "tid", F.posexplode(F.array(*CORNERS)).alias("k", "p")).withColumn("ord", F.col("tid") * 3 + F.col("k"))
    first = corners.groupBy(*keys, "p").agg(F.min("ord").alias("ord"))
    if keys:
        numbered = first.withColumn("vid", (F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1).cast("long"))
    else:
        size = 100_000
        ranged = first.withColumn("range", F.expr(f"ord div {size}"))
        counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
        before = counts.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "before")
        numbered = ranged.join(before, "range").withColumn("vid", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("ord")) - 1).cast("long"))
    faces = corners.join(numbered.select(*keys, "p", "vid"), [*keys, "p"]).groupBy(*keys, F.col("tid").alias("fid")).agg(*(F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)))
    return numbered.select(*keys, "vid", "p.x", "p.y", "p.z"), faces


def add_triangles(triangles: DataFrame, more: DataFrame) -> DataFrame:
    """Both, the added ones numbered after the others."""
    last = triangles.agg(F.coalesce(F.max("tid") + 1, F.lit(0)).alias("last"))
    return triangles.unionByName(more.crossJoin(F.broadcast(last)).withColumn("tid", F.col("tid") + F.col("last")).drop("last"))


def canonical(triangles: DataFrame) -> DataFrame:
    """Triangles turned so that the smallest corner (x, y, z) comes first; the winding stays."""
    a, b, c = (F.col(k) for k in CORNERS)
    low = F.least(a, b, c)
    turn = lambda p, q, r: F.struct(p.alias("a"), q.alias("b"), r.alias("c"))
    return triangles.select(F.when(a == low, turn(a, b, c)).when(b == low, turn(b, c, a)).otherwise(turn(c, a, b)).alias("t")).select("t.*")


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (equal): the same triangles as often, whatever their order and first corners."""
    count = lambda df, n: canonical(df).groupBy("a", "b", "c").agg(F.count("*").alias(n))
    both = count(left, "n").join(count(right, "m"), ["a", "b", "c"], "full")
    return both.agg((F.count_if(~F.col("n").eqNullSafe(F.col("m"))) == 0).alias("equal"))


def bbox(vertices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return vertices.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")))


def is_square(vertices: DataFrame) -> DataFrame:
    """One row (is_square): each corner of the box has a vertex within a 20,000th of width and height together."""
    box = bbox(vertices)
    eps = (F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y")) / 20000
    at = lambda x, y: F.count_if((F.abs(F.col("x") - F.col(x)) <= eps) & (F.abs(F.col("y") - F.col(y)) <= eps)) > 0
    return vertices.crossJoin(F.broadcast(box.drop("min_z", "max_z"))).agg((at("min_x", "min_y") & at("min_x", "max_y") & at("max_x", "min_y") & at("max_x", "max_y")).alias("is_square"))


def has_hole(vertices: DataFrame, faces: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row (has_hole): a square mesh whose triangles don't cover the area of its box (relative eps). Other meshes: false."""
    area = compose(vertices, faces).agg(F.coalesce(F.sum(0.5 * F.abs(geom.cross(F.col("a"), F.col("b"), F.col("c")))), F.lit(0.0)).alias("area"))
    box = bbox(vertices).select(((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))).alias("full"))
    one = is_square(vertices).crossJoin(F.broadcast(area)).crossJoin(F.broadcast(box))
    return one.select(F.coalesce(F.col("is_square") & (F.abs(F.col("area") - F.col("full")) > eps * F.col("full")), F.lit(False)).alias("has_hole"))


def edges(faces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(lo, hi): the distinct undirected edges."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
    return faces.select(*keys, F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).select(*keys, "e.lo", "e.hi").distinct()


# Checks of a triangulated irregular network: each returns the offenders -----------------------------------------------


def bad_index(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    corners = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return corners.join(vertices.select("vid"), "vid", "left_anti").select("fid").distinct()


def unused_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.select("vid").join(faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")), "vid", "left_anti")


def collapsed_faces(faces: DataFrame) -> DataFrame:
    return faces.where("v0 = v1 or v1 = v2 or v2 = v0").select("fid")


def facing_down(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return compose(vertices, faces).where(~geom.facing_up(F.col("a"), F.col("b"), F.col("c"))).select(F.col("tid").alias("fid"))


def duplicate_vertices(vertices: DataFrame) -> DataFrame:
    """Positions that more than one vertex has, with their number."""
    return vertices.groupBy("x", "y", "z").agg(F.count("*").alias("n")).where("n > 1")


def crossing_edges(vertices: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """(a_lo, a_hi, b_lo, b_hi): pairs of edges that share no vertex and have a point in common. Edges meet in grid buckets of the given size."""
    v = vertices.select("vid", _xyz().alias("p"))
    e = edges(faces).join(v.select(F.col("vid").alias("lo"), F.col("p").alias("p")), "lo").join(v.select(F.col("vid").alias("hi"), F.col("p").alias("q")), "hi")
    box = geom.bbox(F.col("p"), F.col("q"))
    e = e.select("lo", "hi", "p", "q", *(b.alias(n) for b, n in zip(box, ("min_x", "min_y", "max_x", "max_y"), strict=True)))
    apart = (F.col("lo") != F.col("r_lo")) & (F.col("lo") != F.col("r_hi")) & (F.col("hi") != F.col("r_lo")) & (F.col("hi") != F.col("r_hi"))
    once = (F.col("lo") < F.col("r_lo")) | ((F.col("lo") == F.col("r_lo")) & (F.col("hi") < F.col("r_hi")))
    pairs = spatial.box_join(e, e, size).where(once & apart & geom.segments_cross(F.col("p"), F.col("q"), F.col("r_p"), F.col("r_q")))
    return pairs.select(F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("r_lo").alias("b_lo"), F.col("r_hi").alias("b_hi"))


def tin_report(vertices: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """One row: the number of offenders of each check, and whether the mesh is valid."""
    checks = {
        "bad_index": bad_index(vertices, faces), "unused": unused_vertices(vertices, faces), "collapsed": collapsed_faces(faces), "down": facing_down(vertices, faces),
        "duplicates": duplicate_vertices(vertices), "crossing": crossing_edges(vertices, faces, size), "hole": has_hole(vertices, faces).where("has_hole"),
    }
    found = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"))
        found = one if found is None else found.unionByName(one)
    out = found.agg(*(F.count_if(F.col("check") == n).alias(n) for n in checks))
    return out.withColumn("valid", sum((F.col(n) for n in checks), F.lit(0)) == 0)
