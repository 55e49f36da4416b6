"""Georeference of a raster and the expressions between cells and world coordinates. Row 0 is the top row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Meta:
    """Width, height, lower-left corner, square cell size, coordinate reference."""

    width: int
    height: int
    pos_x: float = 0.0
    pos_y: float = 0.0
    cell_size: float = 1.0
    srid: int = 3857

    def moved(self, **changes) -> Meta:
        return replace(self, **changes)

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        """(min_x, min_y, max_x, max_y) of the centres of the outermost cells."""
        h = 0.5 * self.cell_size
        return (self.pos_x + h, self.pos_y + h, self.pos_x + (self.width - 0.5) * self.cell_size, self.pos_y + (self.height - 0.5) * self.cell_size)


def col_to_x(col: Column, m: Meta) -> Column:
    return F.lit(m.pos_x) + (col + 0.5) * m.cell_size


def row_to_y(row: Column, m: Meta) -> Column:
    return F.lit(m.pos_y) + ((m.height - 1 - row) + 0.5) * m.cell_size


def _nearest(v: Column, low: float, cell: float) -> Column:
    """Number of the cell whose centre is nearest, counted from low; casts truncate towards zero."""
    return F.lit(0) if cell <= 0 else (0.5 + (v - low - 0.5 * cell) / cell).cast("int")


def x_to_col(x: Column, m: Meta) -> Column:
    return _nearest(x, m.pos_x, m.cell_size)


def y_to_row(y: Column, m: Meta) -> Column:
    return F.lit(0) if m.cell_size <= 0 else m.height - _nearest(y, m.pos_y, m.cell_size) - 1


def ll_row(row: Column, m: Meta) -> Column:
    """Row counted from the bottom; its own inverse."""
    return m.height - 1 - row


def no_data_to_null(z: Column, ndv: float | None) -> Column:
    """Null for null, NaN and the no-data value: everything after ingestion knows null alone."""
    bad = F.isnan(z) if ndv is None else F.isnan(z) | (z == ndv)
    return F.when(~bad, z)
