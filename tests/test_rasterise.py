"""Drawing triangles by pieces of the raster."""

import numpy as np
import pytest

from mesalith.functions.grid import Meta
from mesalith.operators import kernels, mesh, quality

M = Meta(21, 17)


def triangles(spark, n=60, seed=2):
    """Overlapping triangles in world coordinates, beyond the raster, degenerate and without heights too; tids in no order."""
    rng = np.random.default_rng(seed)
    t = np.round(rng.uniform(-6, 26, (n, 3, 3)) * 4) / 4
    t[3, 2] = t[3, 1]
    rows = [(int(tid), *(tuple(map(float, p)) for p in t[i])) for i, tid in enumerate(rng.permutation(n))]
    rows[5] = (rows[5][0], rows[5][1], rows[5][2], (*rows[5][3][:2], None))
    kind = "struct<x:double,y:double,z:double>"
    return rows, spark.createDataFrame(rows, f"tid long, a {kind}, b {kind}, c {kind}")


def by_cell(rows, half):
    """Every cell and triangle, in the order of tid."""
    out = {}
    for _, *t in sorted(rows):
        if any(p[2] is None for p in t):
            continue
        move = (lambda p: (p[0], M.height - p[1], p[2])) if half else (lambda p: (int(p[0]), M.height - int(p[1]) - 1, p[2]))
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = map(move, t)
        den = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        if den == 0:
            continue
        for row in range(M.height):
            for col in range(M.width):
                x, y = col + 0.5 * half, row + 0.5 * half
                w = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / den, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / den, ((ay - by) * (x - bx) + (bx - ax) * (y - by)) / den
                if all(0 <= v <= 1 for v in w):
                    out[row, col] = w[0] * az + w[1] * bz + w[2] * cz
    return out


@pytest.mark.parametrize("half", [False, True])
@pytest.mark.parametrize("size,batch", [(5, 7), (256, 10000)])
def test_pieces_equal_all_cells(spark, monkeypatch, half, size, batch):
    monkeypatch.setattr(kernels, "PIECE", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows, t = triangles(spark)
        got = {(r.row, r.col): r.z for r in quality.rasterise(t, M, half).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_cell(rows, half) and len(got) > 300


def test_drawn_in_parts(monkeypatch):
    """However many cells are looked at in one go."""
    rng = np.random.default_rng(1)
    t = rng.uniform(0, 30, (40, 3, 3)).round()
    made = []
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(kernels, "DRAWN", at_once)
        out = np.full((25, 28), np.nan)
        kernels.draw(out, t)
        made.append(out)
    assert np.array_equal(made[0], made[1], equal_nan=True) and np.array_equal(made[0], made[2], equal_nan=True)


def test_a_triangle_is_a_row_per_piece(spark):
    """What is dealt out are triangles, not the cells of their boxes (90,601 here)."""
    kind = "struct<x:double,y:double,z:double>"
    t = spark.createDataFrame([(0, (0.5, 0.5, 1.0), (300.5, 0.5, 2.0), (0.5, 300.5, 3.0))], f"tid long, a {kind}, b {kind}, c {kind}")
    drawn = quality.rasterise(t, Meta(301, 301))
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "max_by" not in plan
    assert drawn.count() == 301 * 302 // 2


def test_compose_is_not_sorted(spark):
    """Faces are put together by hashing, and heights without data stay null."""
    v = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, None), (2, 0.0, 1.0, -0.0), (3, 2.0, 2.0, float("nan"))], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 1, 3), (2, 0, 1, 9)], "fid long, v0 long, v1 long, v2 long")
    tri = mesh.compose(v, f)
    assert "SortAggregate" not in tri._jdf.queryExecution().executedPlan().toString()
    got = {r.tid: (r.a, r.b, r.c) for r in tri.collect()}
    assert set(got) == {0, 1} and tuple(got[0][1]) == (1.0, 0.0, None) and tuple(got[1][0]) == (0.0, 1.0, 0.0) and got[1][2].z != got[1][2].z


@pytest.mark.parametrize("broken,valid", [(None, True), ("down", False), ("collapsed", False), ("index", False)])
def test_bound_sees_bad_meshes(spark, monkeypatch, broken, valid):
    """One composed mesh is drawn and checked, and a mesh with a bad face is still found out."""
    from mesalith.plans import registry  # noqa: F401  registers the queries
    from mesalith.plans import mesh_queries
    from tests.conftest import SF

    whole, composed = kernels.mesh_groups, []

    def made(*args, **more):
        v, f = whole(*args, **more)
        at = quality.F.col("fid") == 0
        swap = {"down": ("v1", "v0", "v2"), "collapsed": ("v0", "v0", "v2"), "index": (None, "v1", "v2")}.get(broken)
        for k, c in enumerate(swap or ()):
            f = f.withColumn(f"w{k}", quality.F.when(at, quality.F.col(c) if c else quality.F.lit(999_999)).otherwise(quality.F.col(f"v{k}")))
        return v, f.select("chip_row", "chip_col", "fid", *(quality.F.col(f"w{k}").alias(f"v{k}") for k in range(3))) if swap else f

    compose = mesh.compose
    monkeypatch.setattr(kernels, "mesh_groups", made)
    monkeypatch.setattr(mesh, "compose", lambda *args: composed.append(1) or compose(*args))
    got = mesh_queries.bound(spark, SF, "zemlya", 40.0).first()
    assert got.valid == valid and got.fewer and len(composed) == 1
    assert broken or (got.within and got.whole)
