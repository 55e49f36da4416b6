"""Binary formats: quantized-mesh tiles, and single-band GeoTIFF rasters."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesalith.functions.codec import TOP
from mesalith.functions.grid import Meta, no_data_to_null

# Quantized mesh -------------------------------------------------------------------------------------------------------

#: Centre, heights, bounding sphere, occlusion point: 88 bytes, little endian.
HEADER = struct.Struct("<3d2f4d3d")


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int32)
    return (((v << 1) ^ (v >> 15)) & 0xFFFF).astype("<u2")


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int32)
    return (u >> 1) ^ -(u & 1)


def encode_tile(unit: np.ndarray, faces: np.ndarray, head: tuple[float, ...]) -> bytes:
    """A tile's bytes from vertices in the unit cube (n x 3) and faces. Vertices are numbered anew by first use; head: centre, lowest, highest, sphere, occlusion."""
    flat = faces.ravel()
    used, first = np.unique(flat, return_index=True)
    order = used[np.argsort(first)]
    rank = np.zeros(len(unit), np.int64)
    rank[order] = np.arange(len(order))
    q = np.clip((unit[order] * TOP).astype(np.int64), 0, TOP)
    out = [HEADER.pack(*head), struct.pack("<I", len(order))]
    out += [zigzag(np.diff(q[:, k], prepend=0)).tobytes() for k in range(3)]
    kind = "<u2" if len(order) <= 65536 else "<u4"
    size = sum(map(len, out))
    out.append(b"\xca" * (-size % np.dtype(kind).itemsize))
    index = rank[flat]
    high = np.concatenate([[0], np.maximum.accumulate(index)[:-1] + 1]) if len(index) else index
    out += [struct.pack("<I", len(faces)), (high - index).astype(kind).tobytes()]
    for axis, at in ((0, 0), (1, 0), (0, TOP), (1, TOP)):  # west, south, east, north
        edge = np.flatnonzero(q[:, axis] == at)
        out += [struct.pack("<I", len(edge)), edge.astype(kind).tobytes()]
    return b"".join(out)


def decode_tile(data: bytes) -> tuple[tuple, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(head, vertices in the unit cube, faces, edge lists) of a tile; nothing in it for empty data."""
    if not data:
        return (), np.zeros((0, 3)), np.zeros((0, 3), np.int64), []
    head, at = HEADER.unpack_from(data), HEADER.size
    (n,) = struct.unpack_from("<I", data, at)
    q = np.stack([np.cumsum(unzigzag(np.frombuffer(data, "<u2", n, at + 4 + 2 * n * k))) for k in range(3)], 1)
    at += 4 + 6 * n
    kind = np.dtype("<u2" if n <= 65536 else "<u4")
    at += -at % kind.itemsize
    lists = []
    for k in range(5):
        (m,) = struct.unpack_from("<I", data, at)
        m *= 3 if k == 0 else 1
        lists.append(np.frombuffer(data, kind, m, at + 4).astype(np.int64))
        at += 4 + m * kind.itemsize
    code = lists[0]
    index = np.concatenate([[0], np.cumsum(code == 0)[:-1]]) - code if len(code) else code
    return head, q / TOP, index.reshape(-1, 3), lists[1:]


def encode_tiles(vertices: DataFrame, faces: DataFrame, heads: DataFrame) -> DataFrame:
    """(zoom, tx, ty, ext, payload, n_vertices, n_faces, min_z, max_z): one blob a tile, from tables keyed by zoom, tx, ty and tiles.header(). A tile's mesh is one group."""
    keys = ["zoom", "tx", "ty"]
    rows = (vertices.select(*keys, F.lit(0).alias("kind"), F.col("vid").alias("id"), "x", "y", "z", *(F.lit(None).cast("long").alias(f"v{k}") for k in range(3)))
            .unionByName(faces.select(*keys, F.lit(1).alias("kind"), F.col("fid").alias("id"), *(F.lit(None).cast("double").alias(c) for c in "xyz"), "v0", "v1", "v2")))

    def run(key: tuple, pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        v, f = (pdf[pdf["kind"] == k].sort_values("id") for k in (0, 1))
        if not len(f) or not len(head):
            return pd.DataFrame()
        rank = dict(zip(v["id"], range(len(v)), strict=True))
        index = np.array([[rank[i] for i in t] for t in f[["v0", "v1", "v2"]].to_numpy(np.int64)])
        h = head.iloc[0]
        centre = (h["center_x"], h["center_y"], h["center_z"])
        data = encode_tile(v[["x", "y", "z"]].to_numpy(float), index, (*centre, h["min_z"], h["max_z"], *centre, h["radius"], *centre))
        return pd.DataFrame([(*key, "terrain", data, len(v), len(f), h["min_z"], h["max_z"])], columns=[*keys, "ext", "payload", "n_vertices", "n_faces", "min_z", "max_z"])

    heads = heads.select(*(F.col(c).alias(c) for c in heads.columns))  # both sides may come from one plan
    schema = "zoom int, tx int, ty int, ext string, payload binary, n_vertices long, n_faces long, min_z double, max_z double"
    return rows.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(run, schema)


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """(zoom, tx, ty, fid, corner, x, y, z): the corners of each tile's faces in its unit cube."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                _, p, f, _ = decode_tile(bytes(r.payload))
                n = 3 * len(f)
                xyz = p[f.ravel()]
                yield pd.DataFrame({"zoom": [r.zoom] * n, "tx": [r.tx] * n, "ty": [r.ty] * n, "fid": np.arange(n) // 3, "corner": np.arange(n) % 3, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return tiles.select("zoom", "tx", "ty", "payload").mapInPandas(run, "zoom int, tx int, ty int, fid long, corner int, x double, y double, z double")


def obj_tiles(vertices: DataFrame, faces: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same catalog with OBJ text as payload: unit-cube coordinates, indices from 1. `ranges` has zoom, tx, ty, min_z, max_z."""
    keys = ["zoom", "tx", "ty"]
    v = vertices.select(*keys, F.lit(0).alias("kind"), F.col("vid").alias("id"), F.format_string("v %.18f %.18f %.18f", "x", "y", "z").alias("line"))
    f = faces.select(*keys, F.lit(1).alias("kind"), F.col("fid").alias("id"), F.format_string("f %d %d %d", *(F.col(f"v{k}") + 1 for k in range(3))).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("kind", "id", "line")))  # a tile's lines, as many as its mesh has
    made = v.unionByName(f).groupBy(*keys).agg(F.concat(F.array_join(F.transform(lines, lambda r: r.line), "\n"), F.lit("\n")).cast("binary").alias("payload"), F.count_if(F.col("kind") == 0).alias("n_vertices"), F.count_if(F.col("kind") == 1).alias("n_faces"))
    ends = ranges.select(*(F.col(k).alias(k) for k in keys), F.col("min_z").alias("min_z"), F.col("max_z").alias("max_z"))
    return made.join(ends, keys).select(*keys, F.lit("obj").alias("ext"), "payload", "n_vertices", "n_faces", "min_z", "max_z")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """The tile catalog, by zoom."""
    tiles.write.mode("overwrite").partitionBy("zoom").parquet(path)


def write_tile_tree(tiles: DataFrame, directory: str) -> None:
    """Files directory/zoom/tx/ty.ext through Hadoop's file systems (local, HDFS, object stores), tile by tile on the driver's client; for exports of bounded size."""
    jvm = tiles.sparkSession._jvm
    conf = tiles.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for r in tiles.select("zoom", "tx", "ty", "ext", "payload").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(f"{directory}/{r.zoom}/{r.tx}/{r.ty}.{r.ext}")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytes(r.payload))
        out.close()


# GeoTIFF --------------------------------------------------------------------------------------------------------------

# Fixed values of the format: tags, and numpy codes of (sample format, bits).
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _STRIP_ROWS, _COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
_PREDICTOR, _TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _SCALE, _TIE, _GEO_KEYS, _NO_DATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def decode_tiff(data: bytes, check_srid: int | None = None, header: bool = False) -> tuple[np.ndarray | None, Meta, float | None]:
    """First band (float, row 0 on top; header: none), Meta and no-data value of a TIFF in strips or tiles, plain or deflated.

    Pixels must be square; with check_srid, the file's projected system must be that one.
    """
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(end + "H", data, 2)[0] != 42:
        raise ValueError("no classic TIFF")
    (at,) = struct.unpack_from(end + "I", data, 4)
    (n,), tags = struct.unpack_from(end + "H", data, at), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        code = f"{count}s" if kind == 2 else _TYPES[kind] * count
        size, spot = struct.calcsize(end + code), at + 10 + 12 * k
        if size > 4:
            (spot,) = struct.unpack_from(end + "I", data, spot)
        tags[tag] = struct.unpack_from(end + code, data, spot)
    w, h = tags[_WIDTH][0], tags[_HEIGHT][0]
    sx, sy = tags[_SCALE][:2]
    if abs(abs(sx) - abs(sy)) > 1e-9 * abs(sx):
        raise ValueError("pixels aren't square")
    col, row, _, x, y, _ = tags[_TIE][:6]
    keys = tags.get(_GEO_KEYS, ())
    srid = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] == 3072), 0)
    if check_srid and srid != check_srid:
        raise ValueError(f"reference system {srid}, not {check_srid}")
    ndv = float(tags[_NO_DATA][0].split(b"\0")[0]) if _NO_DATA in tags else None
    return None if header else _first_band(data, tags, end, w, h), Meta(w, h, x - col * sx, y + row * sx - h * sx, sx, srid), ndv


def _first_band(data: bytes, tags: dict, end: str, w: int, h: int) -> np.ndarray:
    bands = tags.get(_SAMPLES, (1,))[0]
    kind = np.dtype(end + _KINDS[tags.get(_FORMAT, (1,))[0], tags[_BITS][0]])
    tiled = _TILE_OFFSETS in tags
    bw, bh = (tags[_TILE_W][0], tags[_TILE_H][0]) if tiled else (w, tags.get(_STRIP_ROWS, (h,))[0])
    z, across = np.zeros((h, w)), -(-w // bw)
    for k, (offset, count) in enumerate(zip(tags[_TILE_OFFSETS if tiled else _OFFSETS], tags[_TILE_COUNTS if tiled else _COUNTS], strict=True)):
        if k // across * bh >= h:
            break  # further planes are other bands
        part = data[offset: offset + count]
        packing = tags.get(_COMPRESSION, (1,))[0]
        if packing in (8, 32946):
            part = zlib.decompress(part)
        elif packing != 1:
            raise ValueError(f"compression {packing} isn't supported")
        rows = bh if tiled else min(bh, h - k // across * bh)
        block = np.frombuffer(part, kind, rows * bw * bands).reshape(rows, bw, bands)
        if tags.get(_PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, 1, dtype=kind.newbyteorder("="))
        r, c = k // across * bh, k % across * bw
        z[r: r + rows, c: c + bw] = block[: h - r, : w - c, 0]
    return z


def encode_tiff(z: np.ndarray, m: Meta, ndv: float | None = None, kind: str = "f8", deflate: bool = True, strip_rows: int = 64) -> bytes:
    """A classic little-endian TIFF of one band in strips."""
    z = np.ascontiguousarray(z, "<" + kind)
    strips = [z[r: r + strip_rows].tobytes() for r in range(0, m.height, strip_rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    body, offsets = bytearray(b"II*\0\0\0\0\0"), []
    for s in strips:
        offsets.append(len(body))
        body += s + b"\0" * (len(s) % 2)
    form = {"u": 1, "i": 2, "f": 3}[kind[0]]
    tags = [(_WIDTH, 4, [m.width]), (_HEIGHT, 4, [m.height]), (_BITS, 3, [8 * int(kind[1])]), (_COMPRESSION, 3, [8 if deflate else 1]), (262, 3, [1]), (_OFFSETS, 4, offsets), (_SAMPLES, 3, [1]), (_STRIP_ROWS, 4, [strip_rows]),
            (_COUNTS, 4, [len(s) for s in strips]), (_FORMAT, 3, [form]), (_SCALE, 12, [m.cell_size, m.cell_size, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, m.pos_x, m.pos_y + m.height * m.cell_size, 0.0]),
            (_GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, m.srid])]
    if ndv is not None:
        tags.append((_NO_DATA, 2, repr(float(ndv)).encode() + b"\0"))
    entries = b""
    for tag, code, values in tags:
        raw = values if code == 2 else struct.pack("<" + _TYPES[code] * len(values), *values)
        if len(raw) > 4:
            spot = struct.pack("<I", len(body))
            body += raw + b"\0" * (len(raw) % 2)
        else:
            spot = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code, len(values)) + spot
    body[4:8] = struct.pack("<I", len(body))
    return bytes(body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")


def read_geotiff(spark: SparkSession, path: str, check_srid: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells (raster_id, row, col, z) and metadata (raster_id, width, height, pos_x, pos_y, cell_size, srid) of the files of a path; a file is decoded in one task and sent on row by row."""
    return decode_rasters(spark.read.format("binaryFile").load(path).select("path", "content"), check_srid)


def decode_rasters(files: DataFrame, check_srid: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of files (path, content) that are read already; metadata needs their headers only."""

    def cells(it):
        for pdf in it:
            for r in pdf.itertuples():
                z, m, ndv = decode_tiff(bytes(r.content), check_srid)
                bad = np.isnan(z) | (z == ndv if ndv is not None else False)
                for row in range(m.height):
                    yield pd.DataFrame({"raster_id": r.path, "row": row, "col": np.arange(m.width), "z": np.where(bad[row], np.nan, z[row])})

    def metas(it):
        for pdf in it:
            rows = [(r.path, *(getattr(m, k) for k in ("width", "height", "pos_x", "pos_y", "cell_size", "srid"))) for r in pdf.itertuples() for _, m, _ in [decode_tiff(bytes(r.content), check_srid, header=True)]]
            yield pd.DataFrame(rows, columns=["raster_id", "width", "height", "pos_x", "pos_y", "cell_size", "srid"])

    out = files.mapInPandas(cells, "raster_id string, row int, col int, z double")
    return out.withColumn("z", no_data_to_null(F.col("z"), None)), files.mapInPandas(metas, "raster_id string, width int, height int, pos_x double, pos_y double, cell_size double, srid int")


def geotiff_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of the valid cells, at the upper-left corner of each pixel."""
    cells, metas = read_geotiff(spark, path)
    joined = cells.where("z is not null").join(F.broadcast(metas), "raster_id")  # a row for each file
    return joined.select((F.col("pos_x") + F.col("col") * F.col("cell_size")).alias("x"), (F.col("pos_y") + (F.col("height") - F.col("row")) * F.col("cell_size")).alias("y"), "z")
