"""Planar and 2.5-D geometry as expressions over point structs (x, y, z). Where a divisor is zero the result is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def point(x, y, z) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), (y if isinstance(y, Column) else F.lit(y)).cast("double").alias("y"), (z if isinstance(z, Column) else F.lit(z)).cast("double").alias("z"))


def cross(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area of a, b, c; positive when they turn left."""
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def orientation(a: Column, b: Column, c: Column, eps: float = 0.0) -> Column:
    """1: left turn, -1: right turn, 0: collinear within eps."""
    d = cross(a, b, c)
    return F.when(d > eps, 1).when(d < -eps, -1).otherwise(0)


def facing_up(a: Column, b: Column, c: Column) -> Column:
    """Whether the normal doesn't point down; a degenerate triangle counts as facing up."""
    return cross(a, b, c) >= 0


def front_facing(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The corners, the first two swapped where the triangle faces down."""
    down = ~facing_up(a, b, c)
    return F.when(down, b).otherwise(a), F.when(down, a).otherwise(b), c


def in_circle(a: Column, b: Column, c: Column, p: Column, eps: float = 1e-6) -> Column:
    """Whether p lies inside the circle through a, b, c (left turn)."""
    sq = lambda q: q.x * q.x + q.y * q.y
    return sq(a) * cross(b, c, p) - sq(b) * cross(a, c, p) + sq(c) * cross(a, b, p) - sq(p) * cross(a, b, c) > eps


def bbox(*points: Column) -> tuple[Column, ...]:
    """(min_x, min_y, max_x, max_y) of two or more points."""
    xs, ys = [p.x for p in points], [p.y for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def boxes_meet(a, b, eps: float = EPS) -> Column:
    """Whether boxes (min_x, min_y, max_x, max_y), both grown by eps, have a point in common."""
    return (a[0] - eps <= b[2] + eps) & (b[0] - eps <= a[2] + eps) & (a[1] - eps <= b[3] + eps) & (b[1] - eps <= a[3] + eps)


def box_contains(box, p: Column, with_z: bool = False) -> Column:
    """Whether a point lies in the box or on its border; with_z: a box (min_x, min_y, min_z, max_x, max_y, max_z)."""
    if with_z:
        return p.x.between(box[0], box[3]) & p.y.between(box[1], box[4]) & p.z.between(box[2], box[5])
    return p.x.between(box[0], box[2]) & p.y.between(box[1], box[3])


def boxes_equal(a, b, eps: float = EPS) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (F.abs(x - y) <= eps)
    return out


def on_border(box, p: Column, eps: float = EPS) -> Column:
    near = lambda v, w: F.abs(v - w) <= eps
    return box_contains(box, p) & (near(p.x, box[0]) | near(p.x, box[2]) | near(p.y, box[1]) | near(p.y, box[3]))


def segment_on_line(p: Column, q: Column, origin: tuple, direction: tuple) -> tuple[Column, Column]:
    """Where the line meets the segment p-q: share of the way from p (null when parallel), and whether it is on the segment."""
    (ox, oy), (dx, dy) = origin, direction
    div = (q.x - p.x) * dy - (q.y - p.y) * dx
    t = F.try_divide((ox - p.x) * dy - (oy - p.y) * dx, div)
    return t, t.between(0, 1)


def clip_point(p: Column, q: Column, origin: tuple, direction: tuple) -> Column:
    """Point of the segment on the line, with height interpolated."""
    t, _ = segment_on_line(p, q, origin, direction)
    return F.struct((p.x + t * (q.x - p.x)).alias("x"), (p.y + t * (q.y - p.y)).alias("y"), (p.z + t * (q.z - p.z)).alias("z"))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments have a point in common (end points included)."""
    s1, s2, s3, s4 = (F.signum(cross(*p)) for p in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))
    flat = (s1 == 0) & (s2 == 0)
    return F.when(flat, boxes_meet(bbox(a, b), bbox(c, d), 0.0)).otherwise((s1 * s2 <= 0) & (s3 * s4 <= 0))


def side_of_line(p: Column, origin: tuple, direction: tuple, eps: float = 1e-15) -> Column:
    """-1: left of the line, 1: right of it, 0: on it."""
    d = direction[0] * (p.y - origin[1]) - direction[1] * (p.x - origin[0])
    return F.when(F.abs(d) <= eps, 0).when(d > 0, -1).otherwise(1)


def squared_length(a: Column, b: Column, with_z: bool = False) -> Column:
    out = (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
    return out + (a.z - b.z) * (a.z - b.z) if with_z else out


def compare_lengths(a: Column, b: Column, c: Column, d: Column, with_z: bool = True) -> Column:
    """-1, 0 or 1: a-b is shorter than, as long as, or longer than c-d."""
    return F.signum(squared_length(a, b, with_z) - squared_length(c, d, with_z)).cast("int")


def barycentric(a: Column, b: Column, c: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Weights of the corners at (x, y); null for a degenerate triangle."""
    den = (b.y - c.y) * (a.x - c.x) + (c.x - b.x) * (a.y - c.y)
    w0 = F.try_divide((b.y - c.y) * (x - c.x) + (c.x - b.x) * (y - c.y), den)
    w1 = F.try_divide((c.y - a.y) * (x - c.x) + (a.x - c.x) * (y - c.y), den)
    w2 = F.try_divide((a.y - b.y) * (x - b.x) + (b.x - a.x) * (y - b.y), den)  # its own zero on the far edge, not a rest
    return w0, w1, w2


def interpolate(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    """Height at (x, y); null outside the triangle. The border is inside."""
    w = barycentric(a, b, c, x, y)
    inside = w[0].between(0, 1) & w[1].between(0, 1) & w[2].between(0, 1)
    return F.when(inside, w[0] * a.z + w[1] * b.z + w[2] * c.z)


def plane(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """(p, q, r) of z = p x + q y + r through three points; null for a degenerate triangle."""
    den = cross(a, b, c)
    p = F.try_divide((b.z - a.z) * (c.y - a.y) - (c.z - a.z) * (b.y - a.y), den)
    q = F.try_divide((b.x - a.x) * (c.z - a.z) - (c.x - a.x) * (b.z - a.z), den)
    return p, q, a.z - p * a.x - q * a.y


# Clipping ------------------------------------------------------------------------------------------------------------

#: Edges of the unit square with the inside on the left: bottom, right, top, left.
UNIT_EDGES = (((0.0, 0.0), (1.0, 0.0)), ((1.0, 0.0), (0.0, 1.0)), ((1.0, 1.0), (-1.0, 0.0)), ((0.0, 1.0), (0.0, -1.0)))


def clip_triangle(tri: Column, origin: tuple, direction: tuple) -> Column:
    """Array of the triangles (structs a, b, c) of `tri` left of the line: none, one, or two split at the shorter diagonal.

    Corners are turned so that the odd one out comes first; winding is kept, so results face as the input does.
    """
    corners = (tri.a, tri.b, tri.c)
    side = [side_of_line(p, origin, direction) for p in corners]
    inside = [s == -1 for s in side]
    n = sum((i.cast("int") for i in inside[1:]), inside[0].cast("int"))
    make = lambda p, q, r: F.struct(p.alias("a"), q.alias("b"), r.alias("c"))
    cut = lambda p, q, on: F.when(on == 0, q).otherwise(clip_point(p, q, origin, direction))
    ones, twos = [], []
    for k in range(3):
        p, q, r = (corners[(k + j) % 3] for j in range(3))
        sq, sr = side[(k + 1) % 3], side[(k + 2) % 3]
        ones.append(F.array(make(p, cut(p, q, sq), cut(p, r, sr))))
        # p alone outside: the quadrilateral u, q, r, w
        u, w = clip_point(p, q, origin, direction), clip_point(p, r, origin, direction)
        split = F.when(compare_lengths(u, r, w, q) <= 0, F.array(make(u, q, r), make(u, r, w))).otherwise(F.array(make(u, q, w), make(q, r, w)))
        twos.append(F.when(side[k] == 0, F.array(make(*corners))).otherwise(split))
    pick = lambda options, flags: F.when(flags[0], options[0]).when(flags[1], options[1]).otherwise(options[2])
    none = F.expr("array()").cast("array<struct<a:struct<x:double,y:double,z:double>,b:struct<x:double,y:double,z:double>,c:struct<x:double,y:double,z:double>>>")
    return F.when(n == 3, F.array(make(*corners))).when(n == 1, pick(ones, inside)).when(n == 2, pick(twos, [~i for i in inside])).otherwise(none)


def clip_to_unit_square(tris: Column) -> Column:
    """Array of triangles clipped at the four edges of the unit square, one after another."""

    def clipper(origin, direction):
        return lambda t: clip_triangle(t, origin, direction)

    for edge in UNIT_EDGES:
        tris = F.flatten(F.transform(tris, clipper(*edge)))
    return tris
