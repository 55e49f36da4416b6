"""Kernels by invariants and hand-derived values."""

import math

import numpy as np
import pytest

from mesalith.operators import kernels as k


def surface(p, f, shape):
    """Heights of a mesh in pixel coordinates at all cells."""
    z = np.full(shape, np.nan)
    for a, b, c in f:
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = p[a], p[b], p[c]
        ys, xs = np.mgrid[int(min(ay, by, cy)): int(max(ay, by, cy)) + 1, int(min(ax, bx, cx)): int(max(ax, bx, cx)) + 1]
        den = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        w0 = ((by - cy) * (xs - cx) + (cx - bx) * (ys - cy)) / den
        w1 = ((cy - ay) * (xs - cx) + (ax - cx) * (ys - cy)) / den
        inside = (w0 >= -1e-12) & (w1 >= -1e-12) & (1 - w0 - w1 >= -1e-12)
        z[ys[inside], xs[inside]] = (w0 * az + w1 * bz + (1 - w0 - w1) * cz)[inside]
    return z


def check(p, f, shape):
    h, w = shape
    a, b, c = (p[f[:, i]] for i in range(3))
    area = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    assert (area < 0).all()  # up where y grows upwards
    assert math.isclose(-area.sum(), (w - 1) * (h - 1))
    assert set(f.ravel()) == set(range(len(p))) and len({tuple(q[:2]) for q in p}) == len(p)


@pytest.mark.parametrize("method", [k.terra, k.zemlya])
@pytest.mark.parametrize("seed,holes", [(0, 0.0), (1, 0.3), (2, 0.93)])
def test_error_bound_and_validity(method, seed, holes):
    rng = np.random.default_rng(seed)
    ys, xs = np.mgrid[0:33, 0:41]
    z = 10 * np.sin(0.3 * xs) * np.sin(0.2 * ys) + rng.normal(0, 0.2, xs.shape)
    z[rng.random(z.shape) < holes] = np.nan
    p, f = method(z, 0.5)
    check(p, f, z.shape)
    off = np.abs(surface(p, f, z.shape) - z)
    off[np.isnan(off)] = 0
    for r, c in ((0, 0), (0, -1), (-1, 0), (-1, -1)):
        off[r, c] = 0 if np.isnan(z[r, c]) else off[r, c]
    assert off.max() < 0.5 + 1e-9
    assert len(p) < z.size


def test_zero_error_takes_every_cell():
    z = np.arange(35.0).reshape(5, 7) ** 2 % 11
    p, f = k.terra(z, 0.0)
    assert len(p) == 35 and len(f) == 2 * 4 * 6
    check(p, f, z.shape)


def test_corner_repair():
    z = np.ones((5, 5))
    z[0, 0] = z[4, 4] = np.nan
    check(*k.terra(z, 0.001), z.shape)
    check(*k.terra(np.full((3, 3), np.nan), 0.001), (3, 3))


@pytest.mark.parametrize("points,n", [([(0, 0), (0, 1), (1, 0), (1, 1)], 2), ([(x, y) for x in range(20) for y in range(10)], 342), ([(0, 0), (1, 1), (1, 0)], 1), ([(0, 0), (1, 1), (2, 2)], 0), ([(0, 0)], 0)])
def test_delaunay_counts(points, n):
    f = k.delaunay(np.array(points, float))
    assert len(f) == n
    if n == 1:
        assert set(f[0]) == {0, 1, 2}


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(4).random((60, 2))
    for a, b, c in k.delaunay(p):
        m = np.array([p[b] - p[a], p[c] - p[a]])
        centre = p[a] + np.linalg.solve(2 * m, (m**2).sum(1))
        assert (((p - centre) ** 2).sum(1) >= ((p[a] - centre) ** 2).sum() - 1e-9).all()


def test_ring_average():
    z = np.full((11, 11), np.nan)
    z[0, 0], z[0, 10], z[10, 0], z[10, 10] = 3, 6, 12, 24
    assert k.nearest_average(z, 5, 5, 3) == 11.25
    z[5, 5] = 7
    assert k.nearest_average(z, 5, 5, 3) == 7
    assert math.isnan(k.nearest_average(np.full((3, 3), np.nan), 1, 1))


def test_average_pyramid():
    z = np.arange(16.0).reshape(4, 4)
    m = k.average_pyramid(z)
    assert m[1, 1] == (0 + 1 + 4 + 5) / 4 and m[3, 3] == (10 + 11 + 14 + 15) / 4 and np.isnan(m[0, 0])


@pytest.mark.parametrize("samples", [1, 3])
def test_ring_fill_beyond_the_halo(spark, samples):
    from mesalith.functions.grid import Meta

    z = np.full((20, 26), np.nan)
    z[0, 0], z[1, 3], z[19, 1] = 3, 6, 12
    cells = spark.createDataFrame([(r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(20) for c in range(26)], "row int, col int, z double")
    got = {(r.row, r.col): r.z for r in k.ring_fill(cells, Meta(26, 20), 8, 2, samples).collect()}
    want = {(r, c): k.nearest_average(z, r, c, samples) for r, c in np.argwhere(np.isnan(z)).tolist()}
    assert got == want
    assert {r.z for r in k.ring_fill(cells.withColumn("z", k.F.lit(None).cast("double")), Meta(26, 20), 8, 2).collect()} == {None}


@pytest.mark.parametrize("method", ["terra", "zemlya"])
def test_search_by_cells_or_by_arrays(monkeypatch, method):
    """Both ways of searching a triangle's cells find the same one, equally far ones and cells without data included."""
    rng = np.random.default_rng(4)
    for z in (rng.integers(0, 4, (23, 31)).astype(float), rng.normal(0, 5, (17, 18))):
        z[rng.random(z.shape) < 0.1] = np.nan
        made = []
        for few in (0, 1 << 20):
            monkeypatch.setattr(k, "FEW", few)
            made.append(k.METHODS[method](z, 1.0))
        for a, b in zip(*made, strict=True):
            assert np.array_equal(a, b)
