"""One mesh in pieces: the same vertices on both sides of a line between pieces, whatever the heights, no data included."""

import math

import numpy as np
import pytest

from mesalith.functions.grid import Meta
from mesalith.operators import dense, kernels, mesh, quality
from tests.test_kernels import check


def frame(spark, z):
    h, w = z.shape
    return spark.createDataFrame([(r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(h) for c in range(w)], "row int, col int, z double"), Meta(w, h)


def bumps(h, w, holes, seed=3):
    rng = np.random.default_rng(seed)
    ys, xs = np.mgrid[0:h, 0:w]
    z = 10 * np.sin(0.3 * xs) * np.cos(0.2 * ys) + rng.normal(0, 0.3, (h, w))
    z[rng.random((h, w)) < holes] = np.nan
    return z


def joined(z, method, max_error, size, corner):
    """The pieces' meshes as one: vertices (column, row, height) and faces."""
    m, at, points, faces = Meta(z.shape[1], z.shape[0]), {}, [], []
    for i in range(-(-m.height // size)):
        for j in range(-(-m.width // size)):
            own = kernels.piece_box(i, j, m, size)
            if own is not None:
                p, f = kernels.greedy_piece(method, corner, 0, 0, own, m, max_error)
                for q in p.tolist():
                    if tuple(q[:2]) in at:
                        assert points[at[tuple(q[:2])]] == q
                    else:
                        at[tuple(q[:2])] = len(points)
                        points.append(q)
                faces += [[at[tuple(p[v, :2])] for v in t] for t in f]
    return np.array(points), np.array(faces)


@pytest.mark.parametrize("method", ["terra", "zemlya"])
@pytest.mark.parametrize("shape,holes,max_error", [((33, 41), 0.0, 1.0), ((40, 35), 0.2, 0.5), ((25, 33), 0.1, 0.0)])
def test_pieces_are_one_mesh(method, shape, holes, max_error):
    z = bumps(*shape, holes)
    repaired = z.copy()
    for r in {*range(0, shape[0], 8), shape[0] - 1}:
        for c in {*range(0, shape[1], 8), shape[1] - 1}:
            repaired[r, c] = kernels.nearest_average(z, r, c)
    p, f = joined(z, method, max_error, 8, repaired)
    check(p, f, shape)
    # no edge but those of the raster's outline has one face only: the pieces fit
    edges = np.sort(f[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), 1)
    lone = [e for e, n in zip(*np.unique(edges, axis=0, return_counts=True), strict=True) if n == 1]
    for a, b in p[np.array(lone)]:
        assert any(a[k] == b[k] == v for k, v in ((0, 0), (0, shape[1] - 1), (1, 0), (1, shape[0] - 1)))
    drawn = np.full(shape, np.nan)
    kernels.draw(drawn, p[f])
    off = np.abs(drawn - z)[~np.isnan(z)]
    assert not np.isnan(off).any() and off.max() < max_error + 1e-9


@pytest.mark.parametrize("method", ["regular", "terra", "zemlya"])
def test_sweep_meshes_in_pieces(spark, method):
    """The exact mesh in pieces has all cells, like the one in one piece."""
    z = bumps(21, 30, 0.0)
    cells, m = frame(spark, z)
    got = quality.sweep(cells, m, "a", [(method, 1 if method == "regular" else 0.0)], timed=False, size=8).first()
    assert (got.input_num_points, got.num_vertices, got.num_faces) == (630, 630, 2 * 20 * 29) and got.max_error < 1e-9
    if method != "regular":
        whole = quality.sweep(cells, m, "a", [(method, 0.0)], timed=False).first()
        assert (whole.num_vertices, whole.num_faces) == (got.num_vertices, got.num_faces)


def test_kernels_get_pieces_only(spark):
    """No task of a sweep meshes more than a piece: the one mesh of a raster used to be one task's."""
    z = bumps(21, 30, 0.0)
    cells, m = frame(spark, z)
    seen = spark.sparkContext.accumulator(0)
    kernel = kernels.METHODS["terra"]

    def small(z, *args):
        if z.size > 81:
            raise MemoryError("more than a piece")
        seen.add(1)
        return kernel(z, *args)

    kernels.METHODS["terra"] = small
    try:
        own = [kernels.piece_box(i, j, m, 8) for i in range(3) for j in range(4)]
        for box in filter(None, own):
            kernels.greedy_piece("terra", z, 0, 0, box, m, 0.0)
    finally:
        kernels.METHODS["terra"] = kernel
    assert seen.value == 12 and quality.sweep(cells, m, "a", [("terra", 0.0)], size=8)._jdf.queryExecution().optimizedPlan().toString().count("chip_row") > 0


def test_sweep_without_data_at_corners(spark):
    """Corners without data between pieces get the height that the whole raster gives them."""
    z = bumps(21, 30, 0.15)
    z[8, 8] = z[16, 16] = z[0, 8] = math.nan
    cells, m = frame(spark, z)
    # of all cells, and where the raster has no rows for them
    for part in (cells, cells.where("not (row = 8 and col = 8)")):
        fixed = {(r.row, r.col): r.repair for r in kernels.with_corners(part, m, 8).where("repair is not null").collect()}
        assert fixed and all(math.isclose(v, kernels.nearest_average(z, *k)) for k, v in fixed.items())
        assert {(8, 8), (16, 16), (0, 8)} <= set(fixed)
        for row in quality.sweep(part, m, "a", [("terra", 0.5), ("zemlya", 0.5)], timed=False, size=8).collect():
            assert row.max_error < 0.5 + 1e-9 and row.input_num_points == int((~np.isnan(z)).sum())


@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_sweep_of_steps_equals_drawn_meshes(spark, holes):
    """Counts and errors of dense meshes in pieces are those of the whole mesh drawn as a table, no data included."""
    z = bumps(21, 30, holes)
    cells, m = frame(spark, z)
    got = {r.param_step: r for r in quality.sweep(cells, m, "a", [("regular", s) for s in (1, 3, 5, 20)], size=8).collect()}
    for step, row in got.items():
        v, f = dense.dense_mesh(cells, m, step)
        want = quality.measure_error(cells, quality.rasterise(mesh.compose(v, f), m), m).first()
        assert (row.num_vertices, row.num_faces) == (v.count(), f.count()) and row.meshing_time_seconds >= 0
        for k in ("mean_error", "std_dev_error", "max_error"):
            assert (row[k] is None) == (want[k] is None) and (want[k] is None or math.isclose(row[k], want[k], abs_tol=1e-9))


def test_sweep_is_one_pass(spark):
    """However many steps: the cells are dealt once."""
    cells, m = frame(spark, bumps(9, 9, 0.0))
    deals = lambda runs: quality.sweep(cells, m, "a", runs)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas")
    assert deals([("regular", 1)]) == deals([("regular", s) for s in (1, 2, 4, 5)]) == 1


def test_sweep_of_odd_rasters(spark):
    for h, w in ((1, 5), (2, 2), (5, 1)):
        cells, m = frame(spark, np.ones((h, w)))
        for row in quality.sweep(cells, m, "a", [("regular", 1), ("terra", 0.0)]).collect():
            assert (row.num_vertices, row.num_faces) == ((4, 2) if h == w else (0, 0)) and row.max_error is None
    empty = quality.sweep(cells.where("false"), Meta(0, 0), "a", [("regular", 1)]).first()
    assert (empty.input_num_points, empty.num_vertices, empty.mean_error) == (0, 0, None)
    for bad in (("regular", 0), ("terra", -1.0)):
        with pytest.raises(ValueError):
            quality.sweep(cells, m, "a", [bad])
