import numpy as np
import pytest

from mesalith import __version__, cli
from mesalith.functions.grid import Meta
from mesalith.sources import binary
from mesalith.sources import text as files


@pytest.fixture(scope="module")
def tif(tmp_path_factory):
    ys, xs = np.mgrid[0:40, 0:60]
    path = tmp_path_factory.mktemp("in") / "r.tif"
    path.write_bytes(binary.encode_tiff(50 * np.sin(xs / 9) * np.cos(ys / 7), Meta(60, 40, -13636677.018, 4543905.659, 19.1), -9999.0))
    return str(path)


def test_version(capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__


@pytest.mark.parametrize("method", ["terra", "zemlya", "dense"])
def test_dem2tin(spark, tif, tmp_path, method):
    out = str(tmp_path / "m.obj")
    assert cli.main(["dem2tin", "--input", tif, "--output", out, "--method", method, "--max-error", "2", "--step", "4"], spark) == 0
    v, f = files.read_obj(spark, out)
    assert 4 <= v.count() < 2400 and f.count() > 2
    with pytest.raises(ValueError):
        cli.main(["dem2tin", "--input", tif, "--output", out, "--max-error", "-1"], spark)


def test_dem2tin_terrain(spark, tif, tmp_path):
    assert cli.main(["dem2tin", "--input", tif, "--output", str(tmp_path / "m.terrain"), "--max-error", "2"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "m.terrain")).first().n_faces > 2


@pytest.mark.parametrize("method", ["terra", "dense"])
def test_dem2tintiles(spark, tif, tmp_path, method):
    assert cli.main(["dem2tintiles", "--input", tif, "--output-dir", str(tmp_path / "t"), "--method", method, "--min-zoom", "12", "--max-zoom", "13"], spark) == 0
    got = spark.read.parquet(str(tmp_path / "t"))
    assert {r.zoom for r in got.select("zoom").distinct().collect()} <= {12, 13} and got.count() > 0
    for r in got.collect():
        _, p, f, _ = binary.decode_tile(bytes(r.payload))
        assert len(f) == r.n_faces and p.min() >= 0 and p.max() <= 1
    binary.write_tile_tree(got, str(tmp_path / "tree"))
    assert len(list((tmp_path / "tree").glob("*/*/*.terrain"))) == got.count()


def test_obj_tiles(spark, tif, tmp_path):
    assert cli.main(["dem2tintiles", "--input", tif, "--output-dir", str(tmp_path / "t"), "--output-format", "obj", "--min-zoom", "13", "--max-zoom", "12"], spark) == 0
    for r in spark.read.parquet(str(tmp_path / "t")).collect():
        lines = bytes(r.payload).decode().splitlines()
        assert (sum(x.startswith("v ") for x in lines), sum(x.startswith("f ") for x in lines)) == (r.n_vertices, r.n_faces) and r.ext == "obj"


def test_benchmark_resumes(spark, tif, tmp_path):
    args = ["benchmark", "--input", tif, "--output-dir", str(tmp_path), "--method", "regular", "--parameter", "1", "--parameter", "3"]
    assert cli.main(args, spark) == 0 and cli.main([*args, "--parameter", "4"], spark) == 0
    rows = files.read_stats(spark, str(tmp_path / "stats")).collect()
    assert sorted(r.param_step for r in rows) == [1, 3, 4] and [r for r in rows if r.param_step == 1][0].max_error < 1e-9
