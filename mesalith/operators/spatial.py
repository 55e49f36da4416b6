"""Box joins without nested loops: boxes go to grid buckets, equal buckets are joined, each pair is taken once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesalith.functions import geom


def buckets(df: DataFrame, box: tuple[Column, ...], size: float, eps: float = geom.EPS) -> DataFrame:
    """One row per grid bucket that the box (min_x, min_y, max_x, max_y), grown by eps, reaches: columns bx, by. Empty for null boxes."""
    at = lambda v: F.floor(v / size)
    return (df.withColumn("bx", F.explode(F.sequence(at(box[0] - eps), at(box[2] + eps)))).withColumn("by", F.explode(F.sequence(at(box[1] - eps), at(box[3] + eps)))))


def box_join(left: DataFrame, right: DataFrame, size: float, keys: tuple[str, ...] = (), eps: float = geom.EPS) -> DataFrame:
    """Pairs of rows whose boxes meet and whose `keys` are equal.

    Both sides have columns min_x, min_y, max_x, max_y; those of the right come back with the prefix r_. A pair that
    shares several buckets is taken in the one with the lower-left corner of the common part, so nothing is made
    distinct afterwards. Pick `size` near the larger box's side: a box reaches few buckets then, and a bucket few boxes.
    """
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("min_x", "min_y", "max_x", "max_y"))
    r = right.select(*(F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns))
    a, b = buckets(left, box(""), size, eps), buckets(r, box("r_"), size, eps)
    joined = a.join(b, [*keys, "bx", "by"])
    first = lambda v, w: F.floor((F.greatest(v, w) - eps) / size)
    meets = geom.boxes_meet(box(""), box("r_"), eps)
    return joined.where(meets & (F.col("bx") == first(F.col("min_x"), F.col("r_min_x"))) & (F.col("by") == first(F.col("min_y"), F.col("r_min_y")))).drop("bx", "by")
