"""Web Mercator (EPSG:3857, tiles of 256 pixels, y to the north) and geocentric coordinates, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the projection and of the WGS84 ellipsoid.
RADIUS = 6378137.0
HALF = 20037508.342789243
TILE = 256
FIRST_RESOLUTION = 156543.04
E2 = 0.00669437999014


def resolution(zoom) -> Column | float:
    """Metres of a pixel."""
    if isinstance(zoom, Column):
        return F.lit(2 * HALF / TILE) / F.pow(F.lit(2.0), zoom)
    return 2 * HALF / TILE / 2.0**zoom


def lonlat_to_meters(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * HALF / 180.0, F.log(F.tan(math.pi / 4 + lat * (math.pi / 360))) * RADIUS


def meters_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return x / HALF * 180.0, (2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2) * (180.0 / math.pi)


def pixels_to_meters(p: Column, zoom) -> Column:
    return p * resolution(zoom) - HALF


def meters_to_pixels(m: Column, zoom) -> Column:
    return (m + HALF) / resolution(zoom)


def pixels_to_tile(p: Column) -> Column:
    """A pixel on the edge of two tiles belongs to the lower one."""
    return (F.ceil(p / float(TILE)) - 1).cast("int")


def meters_to_tile(m: Column, zoom) -> Column:
    return pixels_to_tile(meters_to_pixels(m, zoom))


def image_row(py: Column, zoom) -> Column:
    """Pixel row counted from the north."""
    size = F.lit(float(TILE)) * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    return size - py


def tile_meters(zoom) -> Column | float:
    return F.lit(2 * HALF) / F.pow(F.lit(2.0), zoom) if isinstance(zoom, Column) else 2 * HALF / 2.0**zoom


def tile_bounds(tx: Column, ty: Column, zoom) -> tuple[Column, Column, Column, Column]:
    at = lambda t: pixels_to_meters(t * float(TILE), zoom)
    return at(tx), at(ty), at(tx + 1), at(ty + 1)


def ecef(x: Column, y: Column, h: Column) -> tuple[Column, Column, Column]:
    """Geocentric coordinates (EPSG:4978) of a Mercator point and its height above the ellipsoid."""
    lon, lat = meters_to_lonlat(x, y)
    lon, lat = F.radians(lon), F.radians(lat)
    n = RADIUS / F.sqrt(1 - E2 * F.pow(F.sin(lat), F.lit(2.0)))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + h) * F.sin(lat)


def max_zoom(cell: float) -> int:
    """Zoom whose pixels are nearest to the cell size."""
    x = math.log2(FIRST_RESOLUTION / cell)
    return int(math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1))


def min_zoom(top: int, width: int, height: int) -> int:
    """Zoom at which the longer side still fills about half a tile."""
    return max(0, min(math.floor(math.log2(128.0 * 2.0**top / n)) for n in (width, height)))


def zoom_range(cell: float, width: int, height: int, lowest: int | None = None, highest: int | None = None) -> tuple[int, int]:
    """Estimated zooms, within what the caller asks for (None: no bound; a reversed range is turned round); never reversed."""
    if lowest is not None and highest is not None:
        lowest, highest = min(lowest, highest), max(lowest, highest)
    top = max_zoom(cell)
    low = min_zoom(top, width, height)
    lo = low if lowest is None else min(max(low, lowest), top)
    hi = top if highest is None else max(min(top, highest), lo)
    return lo, hi
