"""Integer codings of mesh tiles as expressions: zig-zag, quantising, differences, high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Largest quantised coordinate.
TOP = 32767


def zigzag(i: Column) -> Column:
    """16-bit: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    i = i.cast("int")
    return F.shiftleft(i, 1).bitwiseXOR(F.shiftright(i, 15)).bitwiseAND(F.lit(65535))


def unzigzag(u: Column) -> Column:
    u = u.cast("int")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def quantise(v: Column, low: Column, high: Column) -> Column:
    """0..TOP, truncated; 0 where the range is empty."""
    return F.coalesce((F.try_divide(v - low, high - low) * TOP).cast("int"), F.lit(0))


def dequantise(q: Column, low: Column, high: Column) -> Column:
    return low + q / float(TOP) * (high - low)


def differences(v: Column, keys: list[str], order: str) -> Column:
    return v - F.lag(v, 1, 0).over(Window.partitionBy(*keys).orderBy(order))


def running_sum(d: Column, keys: list[str], order: str) -> Column:
    return F.sum(d).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def high_water_encode(index: Column, keys: list[str], order: str) -> Column:
    """0 for an index not seen before, else how far it lies below the next new one; indices appear in rising order."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(index).over(before) + 1, F.lit(0)) - index


def high_water_decode(code: Column, keys: list[str], order: str) -> Column:
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.when(code == 0, 1).otherwise(0)).over(before), F.lit(0)) - code


def index_bits(n_vertices: Column) -> Column:
    return F.when(n_vertices <= 65536, 16).otherwise(32)
