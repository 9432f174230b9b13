"""Map coordinates, cells and tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfield.schema import ROUNDING, GridMeta


def is_rotated(rot_x: Column, rot_y: Column) -> Column:
    """Whether rotation terms of a geotransform are more than rounding; unknown ones count as none."""
    return F.coalesce(F.abs(rot_x) > ROUNDING, F.lit(False)) | F.coalesce(F.abs(rot_y) > ROUNDING, F.lit(False))


def require_north_up(meta: GridMeta) -> None:
    if meta.is_rotated():
        raise ValueError("rotated grids are not supported")


def col_of(x: Column, meta: GridMeta) -> Column:
    return F.floor((x - meta.x0) / meta.dx)


def row_of(y: Column, meta: GridMeta) -> Column:
    return F.floor((y - meta.y0) / meta.dy)


def world_to_cell(x: Column, y: Column, meta: GridMeta) -> tuple[Column, Column]:
    """(row, col) of a map position; may lie off the grid."""
    require_north_up(meta)
    return row_of(y, meta), col_of(x, meta)


def in_grid(row: Column, col: Column, meta: GridMeta) -> Column:
    return row.between(0, meta.nrows - 1) & col.between(0, meta.ncols - 1)


def cell_id(row: Column, col: Column, meta: GridMeta) -> Column:
    return row.cast("bigint") * F.lit(meta.ncols).cast("bigint") + col.cast("bigint")


def cell_row(cell: Column, meta: GridMeta) -> Column:
    return F.call_function("div", cell, F.lit(meta.ncols).cast("bigint"))


def cell_col(cell: Column, meta: GridMeta) -> Column:
    return F.pmod(cell, F.lit(meta.ncols).cast("bigint"))


def cell_to_world(row: Column, col: Column, meta: GridMeta, anchor: str = "corner") -> tuple[Column, Column]:
    """Map position of a cell's upper-left corner or of its centre."""
    if anchor not in ("corner", "center"):
        raise ValueError(f"anchor must be 'corner' or 'center', got {anchor!r}")
    shift = 0.0 if anchor == "corner" else 0.5
    return (F.lit(meta.x0) + (col + shift) * F.lit(meta.dx),
            F.lit(meta.y0) + (row + shift) * F.lit(meta.dy))


def z_order(row: Column, col: Column) -> Column:
    """Place of a cell on the Z-shaped curve: the bits of row and column (up to 31 each) take turns.

    Cells that are close on the curve are close on the grid.
    """
    def apart(n: Column) -> Column:
        n = n.cast("bigint")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
        return n

    return F.shiftleft(apart(row), 1).bitwiseOR(apart(col))
