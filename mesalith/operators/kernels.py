"""Sequential kernels on one bounded group of cells or points at a time: Delaunay triangulation, greedy and hierarchical refinement, hole filling.

They run as grouped functions over chips or tile partitions; everything else in the package is a plan.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesalith.functions.grid import Meta


class Triangulation:
    """Incremental Delaunay triangulation inside a convex start polygon. Triangles turn left in (x, y).

    tri[t] has the corners, near[t] the triangle across from each corner (-1: none). Integer coordinates are exact.
    """

    def __init__(self, corners):
        self.pts = [tuple(p) for p in corners]
        n = len(self.pts)
        self.tri = [[0, i, i + 1] for i in range(1, n - 1)]
        self.near = [[-1, t + 1 if t + 1 < n - 2 else -1, t - 1] for t in range(n - 2)]
        self.touched: set[int] = set(range(n - 2))
        self.hint = 0

    def cross(self, i, j, p) -> float:
        (ax, ay), (bx, by), (px, py) = self.pts[i], self.pts[j], p
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def locate(self, p, start=None) -> int:
        """A triangle that has p inside or on its border: walks towards p."""
        t = self.hint if start is None else start
        for k in range(4 * len(self.tri) + 16):
            a, b, c = self.tri[t]
            for turn in range(3):
                side = (turn + k) % 3
                i, j = ((b, c), (c, a), (a, b))[side]
                if self.cross(i, j, p) < 0 and self.near[t][side] >= 0:
                    t = self.near[t][side]
                    break
            else:
                return t
        raise RuntimeError("the walk doesn't end")

    def _link(self, t, side, other, back):
        """near[t][side] = other, and in `other`, what pointed to `back` points to t."""
        self.near[t][side] = other
        if other >= 0:
            self.near[other][self.near[other].index(back)] = t

    def insert(self, p, start=None) -> int:
        """Add a point and restore the Delaunay property; the number of the vertex (an equal one if there is). `touched` gets the triangles that changed."""
        t = self.locate(p, start)
        for v in self.tri[t]:
            if self.pts[v] == tuple(p):
                return v
        new = len(self.pts)
        self.pts.append(tuple(p))
        a, b, c = self.tri[t]
        flat = [self.cross(i, j, p) == 0 for i, j in ((b, c), (c, a), (a, b))]
        stack = self._split_edge(t, flat.index(True), new) if any(flat) else self._split_inside(t, new)
        self.hint = t
        while stack:
            stack += self._legalise(stack.pop(), new)
        return new

    def _split_inside(self, t, v):
        a, b, c = self.tri[t]
        na, nb, nc = self.near[t]
        u, w = len(self.tri), len(self.tri) + 1
        self.tri[t] = [v, b, c]
        self.tri += [[v, c, a], [v, a, b]]
        self.near += [[-1] * 3, [-1] * 3]
        self.near[t] = [na, u, w]
        self._link(u, 0, nb, t)
        self._link(w, 0, nc, t)
        self.near[u][1:], self.near[w][1:] = [w, t], [t, u]
        self.touched |= {t, u, w}
        return [t, u, w]

    def _split_edge(self, t, side, v):
        a, b, c = (self.tri[t][(side + k) % 3] for k in range(3))
        na, nb, nc = (self.near[t][(side + k) % 3] for k in range(3))
        u = len(self.tri)
        self.tri[t] = [v, a, b]
        self.tri.append([v, c, a])
        self.near[t] = [nc, -1, u]
        self.near.append([-1, t, -1])
        self._link(u, 0, nb, t)
        made = [t, u]
        if na >= 0:  # the triangle beyond the edge b-c is split as well
            s = self.near[na].index(t)
            d, e = self.tri[na][s], len(self.tri)
            n1, n2 = self.near[na][(s + 1) % 3], self.near[na][(s + 2) % 3]  # across from c, across from b
            self.tri[na] = [v, b, d]
            self.tri.append([v, d, c])
            self.near[na] = [n1, e, t]
            self.near.append([-1, u, na])
            self._link(e, 0, n2, na)
            self.near[t][1], self.near[u][2] = na, e
            made += [na, e]
        self.touched |= set(made)
        return made

    def _legalise(self, t, v):
        """Flip the edge across from v where the neighbour's far corner lies in the circle; the two triangles to look at next."""
        s = self.tri[t].index(v)
        o = self.near[t][s]
        if o < 0:
            return []
        a, b = self.tri[t][(s + 1) % 3], self.tri[t][(s + 2) % 3]
        k = self.near[o].index(t)
        d = self.tri[o][k]
        (ax, ay), (bx, by), (dx, dy), (vx, vy) = self.pts[a], self.pts[b], self.pts[d], self.pts[v]
        ax, ay, bx, by, vx, vy = ax - dx, ay - dy, bx - dx, by - dy, vx - dx, vy - dy
        if (vx * vx + vy * vy) * (ax * by - ay * bx) - (ax * ax + ay * ay) * (vx * by - vy * bx) + (bx * bx + by * by) * (vx * ay - vy * ax) <= 1e-12:
            return []
        t_a, t_b = self.near[t][(s + 1) % 3], self.near[t][(s + 2) % 3]  # across from a, across from b
        o_a, o_b = self.near[o][self.tri[o].index(a)], self.near[o][self.tri[o].index(b)]
        self.tri[t], self.tri[o] = [v, a, d], [v, d, b]
        self.near[t] = [-1, o, t_b]
        self.near[o] = [-1, -1, t]
        self._link(t, 0, o_b, o)
        self._link(o, 0, o_a, o)
        self._link(o, 1, t_a, t)
        self.touched |= {t, o}
        return [t, o]

    def around(self, v, t) -> set[int]:
        """Triangles that have the vertex, from one of them."""
        seen, todo = {t}, [t]
        while todo:
            for n in self.near[todo.pop()]:
                if n >= 0 and n not in seen and v in self.tri[n]:
                    seen.add(n)
                    todo.append(n)
        return seen


def delaunay(points: np.ndarray) -> np.ndarray:
    """Faces (n x 3) of scattered points (n x 2), turned left; none for fewer than three or collinear ones. Of equal points the first counts."""
    if len(points) < 3:
        return np.zeros((0, 3), np.int64)
    low, high = points.min(0), points.max(0)
    mid, r = (low + high) / 2, max(1e-9, float((high - low).max())) * 1e4
    tin = Triangulation([(mid[0] - r, mid[1] - r), (mid[0] + r, mid[1] - r), (mid[0], mid[1] + r)])
    of: dict[int, int] = {}
    for i in np.lexsort((points[:, 1], points[:, 0])):
        v = tin.insert((float(points[i, 0]), float(points[i, 1])))
        of[v] = min(of.get(v, int(i)), int(i))
    faces = [[of[v] for v in t] for t in tin.tri if all(v in of for v in t)]
    p = points[np.array(faces, int).reshape(-1, 3)]
    d1, d2 = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    area = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
    return np.array(faces, np.int64).reshape(-1, 3)[area > 1e-12 * max(1.0, float(np.abs(area).max(initial=0)))]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by group over all shuffle partitions: groups are small in bytes but long in time, so they must not be coalesced into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Nearest valid average ------------------------------------------------------------------------------------------------


def subsample(z: np.ndarray, r: int, c: int) -> float:
    """Weighted 3:2:1 mean around a cell, which may lie outside; NaN if nothing is valid."""
    h, w = z.shape
    parts: list[list[float]] = [[], [], []]
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if 0 <= r + i < h and 0 <= c + j < w and not math.isnan(v := z[r + i, c + j]):
                parts[abs(i) + abs(j)].append(v)
    total, weight = 0.0, 0
    for k, p in enumerate(parts):
        if p:
            total, weight = total + (3 - k) * sum(p) / len(p), weight + 3 - k
    return total / weight if weight else math.nan


def ring(radius: int) -> Iterator[tuple[int, int]]:
    """(column, row) offsets of a midpoint circle of radius - 1, eight octants at a time; seams come twice."""
    x, y, up, over = radius - 1, 0, 1, 1
    balance = over - radius // 2
    while x >= y:
        for a, b in ((x, y), (y, x)):
            yield from ((a, b), (-a, b), (a, -b), (-a, -b))
        if balance <= 0:
            y += 1
            balance += up
            up += 2
        else:
            x -= 1
            over += 2
            balance += over - radius // 2


def nearest_average(z: np.ndarray, row: int, col: int, samples: int = 1) -> float:
    """The cell's own value, else the mean of all samples of the first rings that have `samples` of them; NaN if there are none."""
    return ring_search(z, row, col, samples, 2, int(math.hypot(*z.shape)))[0]


def ring_search(z: np.ndarray, row: int, col: int, samples: int, first: int, last: int) -> tuple[float, bool]:
    """nearest_average over the rings first..last, and whether it ended with enough samples."""
    if not math.isnan(z[row, col]):
        return float(z[row, col]), True
    found: list[float] = []
    for radius in range(first, last + 1):
        found += [v for dx, dy in ring(radius) if not math.isnan(v := subsample(z, row + dy, col + dx))]
        if len(found) >= samples:
            break
    return sum(found) / len(found) if found else math.nan, len(found) >= samples


def as_grid(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """Dense array of a group's cells (NaN: none), and its first row and column."""
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    z = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
    z[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf["z"].to_numpy(dtype=float)
    return z, r0, c0


def ring_fill(cells: DataFrame, m: Meta, chip: int = 512, halo: int = 64, samples: int = 1, only: Column | None = None) -> DataFrame:
    """(row, col, z) of the no-data cells (only: of those it is true for), from their nearest valid neighbours; null only where the raster has no valid cell.

    A ring of a radius up to the halo lies within the chip and its halo. Cells that need a wider one are searched for
    again with a halo four times as wide, in their chips only, until none is left or the halo covers the raster.
    """
    from mesalith.operators.raster import chips

    limit = int(math.hypot(m.height, m.width))

    def fill(halo: int, whole: bool):
        reach = limit if whole else min(halo, limit)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            z, r0, c0 = as_grid(pdf)
            own = pdf[pdf["z"].isna() & pdf["open"] & (pdf["row"] // chip == pdf["chip_row"]) & (pdf["col"] // chip == pdf["chip_col"])]
            rows, cols = np.nonzero(~np.isnan(z))
            values, done = [], []
            for r, c in zip(own["row"] - r0, own["col"] - c0, strict=True):
                # smaller rings have no valid cell
                least = int(np.maximum(np.abs(rows - r), np.abs(cols - c)).min()) if len(rows) else reach + 1
                v, enough = ring_search(z, r, c, samples, max(2, least), reach)
                values.append(v)
                done.append(enough or whole)
            return pd.DataFrame({"row": own["row"], "col": own["col"], "z": values, "done": np.array(done, bool)})

        return run

    found, chosen = None, chips(cells.select("row", "col", "z").withColumn("open", F.lit(True) if only is None else only), m, chip, halo)
    while True:
        whole = halo >= max(m.height, m.width)
        told = dealt(chosen, "chip_row", "chip_col").groupBy("chip_row", "chip_col").applyInPandas(fill(halo, whole), "row int, col int, z double, done boolean")
        if not whole:
            told = told.persist()
        part = told.where("done").select("row", "col", F.when(~F.isnan("z"), F.col("z")).alias("z"))
        found = part if found is None else found.unionByName(part)
        left = told.where("not done").select("row", "col")
        if whole or left.isEmpty():
            return found
        halo *= 4
        now = cells.select("row", "col", "z").join(left.withColumn("open", F.lit(True)), ["row", "col"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        at = left.select(F.floor(F.col("row") / chip).alias("chip_row"), F.floor(F.col("col") / chip).alias("chip_col")).distinct()
        chosen = chips(now, m, chip, halo).join(at, ["chip_row", "chip_col"], "left_semi")


# Greedy refinement ----------------------------------------------------------------------------------------------------


#: Boxes of up to this many cells are searched cell by cell.
FEW = 96


class GreedyTin:
    """Refines two triangles over a raster: always inserts the cell that is farthest from its triangle's plane.

    Candidates wait in a heap with the version of their triangle; one whose triangle changed since is stale.
    `shared` are the sides (of top, bottom, left, right) where another piece's mesh goes on: see share().
    """

    def __init__(self, z: np.ndarray, max_error: float = 0.0, shared: tuple[str, ...] = ()):
        self.raster = z.copy()
        h, w = z.shape
        for r, c in ((0, 0), (0, w - 1), (h - 1, w - 1), (h - 1, 0)):
            v = nearest_average(z, r, c)
            self.raster[r, c] = 0.0 if math.isnan(v) else v
        corners = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
        self.tin = Triangulation(corners)
        self.height = [float(self.raster[y, x]) for x, y in corners]
        self.version: dict[int, int] = {}
        #: Heights of the cells that are neither used nor without data (else NaN), as an array and as lists.
        self.free, self.rows = np.full((h, w), np.nan), []
        self.heap: list[tuple] = []
        self.count = 0
        #: Cells of shared sides.
        self.closed = np.zeros((h, w), bool)
        for side in shared:
            self.share(side, max_error)

    def share(self, side: str, max_error: float) -> None:
        """Insert what a side needs to be nearer than max_error to its cells, and nothing later: from the side's cells alone, so the piece beyond has the same vertices."""
        h, w = self.raster.shape
        at = {"top": (0, slice(None)), "bottom": (h - 1, slice(None)), "left": (slice(None), 0), "right": (slice(None), w - 1)}[side]
        for i in profile(self.raster[at], max_error):
            x, y = {"top": (i, 0), "bottom": (i, h - 1), "left": (0, i), "right": (w - 1, i)}[side]
            self.tin.insert((x, y))
            self.height.append(float(self.raster[y, x]))
        self.closed[at] = True

    def scan(self, t: int, least: float) -> None:
        """Push the farthest unused valid cell of a triangle, if it is at least `least` away; of equally far ones the first by row and column."""
        self.version[t] = version = self.version.get(t, 0) + 1
        i, j, k = self.tin.tri[t]
        (ax, ay), (bx, by), (cx, cy) = self.tin.pts[i], self.tin.pts[j], self.tin.pts[k]
        x0, x1, y0, y1 = min(ax, bx, cx), max(ax, bx, cx), min(ay, by, cy), max(ay, by, cy)
        search = self._farthest_few if (x1 - x0 + 1) * (y1 - y0 + 1) <= FEW else self._farthest
        value, x, y = search((ax, ay, bx - ax, by - ay, cx - ax, cy - ay), (x0, x1, y0, y1), (self.height[i], self.height[j], self.height[k]))
        if value >= least and value >= 0:
            self.count += 1
            heapq.heappush(self.heap, (-value, self.count, t, version, x, y))

    def _farthest(self, sides, box, heights) -> tuple[float, int, int]:
        """(distance, column, row) of the farthest free cell inside; -1 if there is none."""
        (ax, ay, ux, uy, vx, vy), (x0, x1, y0, y1), (hi, hj, hk) = sides, box, heights
        part = self.free[y0: y1 + 1, x0: x1 + 1]
        xs, ys = np.arange(x0 - ax, x1 - ax + 1)[None], np.arange(y0 - ay, y1 - ay + 1)[:, None]
        w0, w1, full = ux * ys - uy * xs, vy * xs - vx * ys, ux * vy - uy * vx
        w2 = full - w0 - w1
        off = np.abs(part - (w1 * hj + w2 * hi + w0 * hk) / full)
        off[(w0 < 0) | (w1 < 0) | (w2 < 0) | np.isnan(off)] = -1.0
        y, x = divmod(int(off.argmax()), off.shape[1])
        return float(off[y, x]), x + x0, y + y0

    def _farthest_few(self, sides, box, heights) -> tuple[float, int, int]:
        """The same, cell by cell: faster than arrays for boxes of a few cells, of which fine meshes mostly consist."""
        (ax, ay, ux, uy, vx, vy), (x0, x1, y0, y1), (hi, hj, hk) = sides, box, heights
        full, best, at_x, at_y = ux * vy - uy * vx, -1.0, x0, y0
        for y in range(y0, y1 + 1):
            dy, row = y - ay, self.rows[y]
            for x in range(x0, x1 + 1):
                z = row[x]
                if z == z:  # neither used nor without data
                    dx = x - ax
                    w0, w1 = ux * dy - uy * dx, vy * dx - vx * dy
                    w2 = full - w0 - w1
                    if w0 >= 0 and w1 >= 0 and w2 >= 0 and (off := abs(z - (w1 * hj + w2 * hi + w0 * hk) / full)) > best:
                        best, at_x, at_y = off, x, y
        return best, at_x, at_y

    def _use(self, x: int, y: int) -> None:
        self.free[y, x] = self.rows[y][x] = math.nan

    def refine(self, target: np.ndarray, least: float) -> None:
        """Insert until no valid cell of `target` (NaN: none) is `least` or more away from the surface."""
        self.heap, self.free, self.rows = [], target.copy(), target.tolist()
        if target is self.raster:
            for v, (x, y) in enumerate(self.tin.pts):
                if self.height[v] == self.raster[y, x]:  # vertices that carry the raster's own value
                    self._use(x, y)
        for y, x in np.argwhere(self.closed).tolist():
            self._use(x, y)
        for t in range(len(self.tin.tri)):
            self.scan(t, least)
        while self.heap:
            _, _, t, version, x, y = heapq.heappop(self.heap)
            if self.version[t] != version:
                continue
            self._use(x, y)
            self.tin.touched = set()
            v = self.tin.insert((x, y), t)
            if v == len(self.height):
                self.height.append(float(target[y, x]))
            else:
                self.height[v] = float(target[y, x])
                self.tin.touched = self.tin.around(v, t)
            for t in self.tin.touched:
                self.scan(t, least)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Vertices (column, row, height) in row-major order, and faces that face up where y grows upwards."""
        p = np.array([(x, y, z) for (x, y), z in zip(self.tin.pts, self.height, strict=True)])
        order = np.lexsort((p[:, 0], p[:, 1]))
        rank = np.empty(len(p), np.int64)
        rank[order] = np.arange(len(p))
        return p[order], rank[np.array(self.tin.tri)][:, ::-1]


def profile(z: np.ndarray, max_error: float) -> list[int]:
    """Positions between the ends, in rising order, that a line through cells needs to be nearer than max_error to the valid ones; the ends are valid."""
    found, todo = [], [(0, len(z) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        off = np.abs(z[i + 1: j] - (z[i] + (z[j] - z[i]) * (np.arange(1, j - i) / (j - i))))
        off[np.isnan(off)] = -1.0
        k = int(off.argmax())
        if off[k] >= max(max_error, 0.0):
            found.append(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return sorted(found)


def terra(z: np.ndarray, max_error: float, shared: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Greedy insertion: afterwards every valid cell is nearer than max_error to the surface."""
    tin = GreedyTin(z, max_error, shared)
    tin.refine(tin.raster, max_error)
    return tin.result()


def average_pyramid(z: np.ndarray) -> np.ndarray:
    """Means of squares of 2, 4, 8, ... cells at the squares' centres, each of the four means within (NaN: none valid)."""
    h, w = z.shape
    out = np.full((h, w), np.nan)
    top = math.ceil(math.log2(max(h, w)))
    at = lambda a, ys, xs: np.where((ys < h) & (xs < w), a[np.minimum(ys, h - 1), np.minimum(xs, w - 1)], np.nan)
    for step in range(1, top):
        size = 1 << step
        ys, xs = np.arange(size // 2, h, size)[:, None], np.arange(size // 2, w, size)[None]
        near, far, source = (1, 0, z) if step == 1 else (size // 4, size // 4, out)
        four = np.stack([at(source, ys + i, xs + j) for i in (-near, far) for j in (-near, far)])
        n = (~np.isnan(four)).sum(0)
        out[ys, xs] = np.where(n > 0, np.nansum(four, 0) / np.maximum(n, 1), np.nan)
    return out


def zemlya(z: np.ndarray, max_error: float, shared: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hierarchical greedy insertion: means of large squares first, then of smaller ones, cells of the raster from the fifth level on, all cells at last."""
    tin = GreedyTin(z, max_error, shared)
    h, w = z.shape
    means, top = average_pyramid(z), math.ceil(math.log2(max(h, w)))
    target = np.full((h, w), np.nan)
    for level in range(1, top + 1):
        if level == top:
            tin.refine(tin.raster, max_error)
            break
        size = 1 << (top - level)
        ys, xs = np.arange(size // 2, h, size)[:, None], np.arange(size // 2, w, size)[None]
        source, (py, px) = tin.raster if level >= 5 else means, np.nonzero(~np.isnan(target))
        if level >= 5:
            target[py, px] = tin.raster[py, px]
        elif size >= 8:  # older means give way to those of smaller squares around the same place
            d = size // 8
            four = np.stack([np.where((0 <= py + i) & (py + i < h) & (0 <= px + j) & (px + j < w), means[np.clip(py + i, 0, h - 1), np.clip(px + j, 0, w - 1)], np.nan) for i in (-d, d) for j in (-d, d)])
            n = (~np.isnan(four)).sum(0)
            target[py, px] = np.where(n > 0, np.nansum(four, 0) / np.maximum(n, 1), target[py, px])
        target[ys, xs] = source[ys, xs]
        tin.refine(target, max_error)
    return tin.result()


METHODS = {"terra": terra, "zemlya": zemlya}


# Pieces of one mesh ---------------------------------------------------------------------------------------------------


#: Squares along a side of a piece. A raster of more is meshed and drawn piece by piece.
PIECE = 256
#: Cells looked at in one go when triangles are drawn.
DRAWN = 1 << 20


def window(z: np.ndarray, r0: int, c0: int, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part (first row, first column, last row, last column) of an array whose upper left cell is (r0, c0); NaN beyond it."""
    top, left, bottom, right = box
    out = np.full((bottom - top + 1, right - left + 1), np.nan)
    a, b, c, d = max(top, r0), max(left, c0), min(bottom, r0 + z.shape[0] - 1), min(right, c0 + z.shape[1] - 1)
    if a <= c and b <= d:
        out[a - top: c - top + 1, b - left: d - left + 1] = z[a - r0: c - r0 + 1, b - c0: d - c0 + 1]
    return out


def draw(out: np.ndarray, t: np.ndarray, shift: float = 0.0, first: tuple[int, int] = (0, 0)) -> None:
    """Put the heights of triangles (n x 3 corners x column, row, height) at the cells that they cover; a later triangle goes before.

    shift: where in a cell it is sampled. first: row and column of out's upper left cell.
    """
    (h, w), (r0, c0) = out.shape, first
    t = t[~np.isnan(t).any((1, 2))]
    low = np.maximum(np.ceil(t[:, :, :2].min(1) - shift), (c0, r0)).astype(np.int64)
    high = np.minimum(np.floor(t[:, :, :2].max(1) - shift), (c0 + w - 1, r0 + h - 1)).astype(np.int64)
    size = np.maximum(high - low + 1, 0)
    n = size[:, 0] * size[:, 1]
    t, low, wide, n = t[n > 0], low[n > 0], size[n > 0, 0], n[n > 0]
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        before = ends[start] - n[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + DRAWN, "right")))
        part = slice(start, stop)
        k = np.arange(ends[stop - 1] - before) - np.repeat(ends[part] - n[part] - before, n[part])
        per = lambda v: np.repeat(v, n[part])  # noqa: B023, E731
        across = per(wide[part])
        row, col = per(low[part, 1]) + k // across, per(low[part, 0]) + k % across
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([per(t[part, i, j]) for j in range(3)] for i in range(3))
        x, y = col + shift, row + shift
        with np.errstate(divide="ignore", invalid="ignore"):  # degenerate triangles cover nothing
            den = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
            w0 = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / den
            w1 = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / den
            w2 = ((ay - by) * (x - bx) + (bx - ax) * (y - by)) / den
        inside = (w0 >= 0) & (w0 <= 1) & (w1 >= 0) & (w1 <= 1) & (w2 >= 0) & (w2 <= 1)
        i = np.flatnonzero(inside)
        out[row[i] - r0, col[i] - c0] = w0[i] * az[i] + w1[i] * bz[i] + w2[i] * cz[i]  # of equal places the last counts
        start = stop


def greedy_piece(method: str, z: np.ndarray, r0: int, c0: int, own: tuple[int, int, int, int], m: Meta, max_error: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (column, row, height) and faces of the piece `own` of one mesh. Sides with a neighbour have the same vertices as the neighbour's."""
    top, left, bottom, right = own
    sides = {"top": top > 0, "bottom": bottom < m.height - 1, "left": left > 0, "right": right < m.width - 1}
    p, f = METHODS[method](window(z, r0, c0, own), max_error, tuple(k for k, v in sides.items() if v))
    return p + (left, top, 0.0), f


def regular_piece(z: np.ndarray, r0: int, c0: int, own: tuple[int, int, int, int], m: Meta, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (column, row, height; NaN: no data) and faces of the dense mesh over the squares that touch `own`, in the order of the whole mesh."""
    lines = lambda first, last, n: np.unique(np.minimum(np.arange(max(first - 1, 0) // step * step, last + step, step), n - 1))
    rows, cols = lines(own[0], own[2], m.height), lines(own[1], own[3], m.width)
    box = (int(rows[0]), int(cols[0]), int(rows[-1]), int(cols[-1]))
    x, y = np.meshgrid(cols, rows)
    p = np.stack([x, y, window(z, r0, c0, box)[y - box[0], x - box[1]]], -1).reshape(-1, 3)
    v = (np.arange(1, len(rows))[:, None] * len(cols) + np.arange(1, len(cols))[None]).ravel()
    return p, np.stack([v, v - len(cols), v - len(cols) - 1, v, v - len(cols) - 1, v - 1], -1).reshape(-1, 3)


def piece_box(piece_row: int, piece_col: int, m: Meta, size: int) -> tuple[int, int, int, int] | None:
    """(first row, first column, last row, last column) of a piece's squares; the last lines are the next pieces' first. None: no square begins here."""
    top, left = piece_row * size, piece_col * size
    return None if top >= m.height - 1 or left >= m.width - 1 else (top, left, min(top + size, m.height - 1), min(left + size, m.width - 1))


def counts_here(row: np.ndarray, col: np.ndarray, own: tuple[int, int, int, int], m: Meta) -> np.ndarray:
    """Whether cells or vertices count in this piece: those of lower and right sides count in the next one, if there is one."""
    top, left, bottom, right = own
    below, beyond = (bottom if bottom < m.height - 1 else m.height), (right if right < m.width - 1 else m.width)
    return (row >= top) & (row < below) & (col >= left) & (col < beyond)


def with_corners(cells: DataFrame, m: Meta, size: int) -> DataFrame:
    """cells with a column repair (null) and, for corners of pieces without data, rows whose repair is the height that all pieces around take there."""
    spark = cells.sparkSession
    plain = cells.select("row", "col", "z").withColumn("repair", F.lit(None).cast("double"))
    if m.height - 1 <= size and m.width - 1 <= size:
        return plain  # one piece repairs its own corners
    line = lambda c, n: ((F.col(c) % size == 0) & (F.col(c) < n - 1)) | (F.col(c) == n - 1)
    at = line("row", m.height) & line("col", m.width)
    down, across = -(-(m.height - 1) // size) + 1, -(-(m.width - 1) // size) + 1
    corners = spark.range(down * across).select(F.least(F.expr(f"id div {across}") * size, F.lit(m.height - 1)).cast("int").alias("row"), F.least((F.col("id") % across) * size, F.lit(m.width - 1)).cast("int").alias("col"))
    there = cells.where(at).select("row", "col", "z", F.lit(True).alias("known"))
    broken = corners.join(there, ["row", "col"], "left").where("z is null").persist()
    if broken.isEmpty():
        return plain
    absent = broken.where("known is null").select("row", "col", "z")
    fixed = ring_fill(cells.select("row", "col", "z").unionByName(absent), m, only=at)
    return plain.unionByName(fixed.select("row", "col", F.lit(None).cast("double").alias("z"), F.coalesce("z", F.lit(0.0)).alias("repair")))


def mesh_groups(cells: DataFrame, m: Meta, keys: tuple[str, ...], method: str = "terra", max_error: float | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mesh each group of cells on its own: vertices (keys, vid, x, y, z) and faces (keys, fid, v0, v1, v2) in world coordinates.

    A group must be a chip or partition of bounded size. max_error defaults to the cell size and must not be negative;
    a column max_error in `cells` (one value a group) goes before. Groups of fewer than 2 x 2 cells have no mesh.
    keep: persist the meshes, as each use of vertices or faces would mesh anew; Spark meshes a lost part again.
    """
    if max_error is not None and max_error < 0:
        raise ValueError("max_error is negative")
    limit, kernel = m.cell_size if max_error is None else max_error, METHODS[method]
    types = {f.name: f.dataType.simpleString() for f in cells.schema if f.name in keys}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, r0, c0 = as_grid(pdf)
        own = float(pdf["max_error"].iloc[0]) if "max_error" in pdf else limit
        p, f = kernel(z, own) if min(z.shape) >= 2 else (np.zeros((0, 3)), np.zeros((0, 3), np.int64))
        n = len(p) + len(f)
        out = pd.DataFrame(dict(zip(keys, key, strict=True)), index=range(n))
        pad = lambda a, first: np.concatenate([a, np.zeros(len(f), a.dtype)] if first else [np.zeros(len(p), np.int64), a])
        out["is_face"] = np.arange(n) >= len(p)
        out["id"] = np.concatenate([np.arange(len(p)), np.arange(len(f))])
        out["x"], out["y"], out["z"] = pad(m.pos_x + (p[:, 0] + c0 + 0.5) * m.cell_size, True), pad(m.pos_y + (m.height - 1 - (p[:, 1] + r0) + 0.5) * m.cell_size, True), pad(p[:, 2], True)
        for k in range(3):
            out[f"v{k}"] = pad(f[:, k], False)
        return out

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "is_face boolean, id long, x double, y double, z double, v0 long, v1 long, v2 long"])
    both = dealt(cells, *keys).groupBy(*keys).applyInPandas(run, schema)
    both = both.persist() if keep else both
    return both.where("not is_face").select(*keys, F.col("id").alias("vid"), "x", "y", "z"), both.where("is_face").select(*keys, F.col("id").alias("fid"), "v0", "v1", "v2")


def triangulate_groups(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Delaunay faces (keys, fid, v0, v1, v2) of each group of points (keys, id, x, y)."""
    types = {f.name: f.dataType.simpleString() for f in points.schema if f.name in keys}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        faces = delaunay(pdf[["x", "y"]].to_numpy(float))
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame(dict(zip(keys, key, strict=True)), index=range(len(faces)))
        out["fid"] = np.arange(len(faces))
        for k in range(3):
            out[f"v{k}"] = ids[faces[:, k]]
        return out

    return dealt(points, *keys).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "fid long, v0 long, v1 long, v2 long"]))
