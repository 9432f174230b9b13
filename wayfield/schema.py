"""Shapes of the tables the library works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Rotation terms up to this size are none.
ROUNDING = 1e-12


@dataclass(frozen=True)
class GridMeta:
    """Size and placement of an elevation grid.

    ``dx`` and ``dy`` are the signed cell steps of the geotransform (``dy`` is negative for a
    north-up grid); ``rot_x`` and ``rot_y`` are its rotation terms.
    """

    nrows: int
    ncols: int
    x0: float
    y0: float
    dx: float
    dy: float
    crs: str = ""
    rot_x: float = 0.0
    rot_y: float = 0.0

    @property
    def res_x(self) -> float:
        return abs(self.dx)

    @property
    def res_y(self) -> float:
        return abs(self.dy)

    @property
    def n_cells(self) -> int:
        return self.nrows * self.ncols

    def is_rotated(self) -> bool:
        return abs(self.rot_x) > ROUNDING or abs(self.rot_y) > ROUNDING

    def same_grid(self, other: "GridMeta") -> bool:
        return (self.nrows, self.ncols) == (other.nrows, other.ncols)


@dataclass(frozen=True)
class JobOptions:
    """Options shared by the two end-to-end jobs.

    ``resume`` is a folder of the shared store in which a job keeps its finished steps: begun again with it, over the
    same data, the job goes on after the last one. ``tile_size`` is the least side of a tile; long grids get larger ones.
    """

    neighbours: int = 16
    slope_units: str = "degrees"
    buffer: int = 0
    line_buffer: int = 2
    line_combine: str = "max_with_1"
    cost_function: str = "tobler"
    on_mismatch: str = "raise"
    on_outside: str = "raise"
    tile_size: int = 512
    sources_per_pass: int = 16384
    resume: str | None = None


CELLS = T.StructType([
    T.StructField("cell_id", T.LongType(), False),
    T.StructField("row", T.IntegerType(), False),
    T.StructField("col", T.IntegerType(), False),
    T.StructField("z", T.DoubleType(), True),
])

POINTS = T.StructType([
    T.StructField("point_id", T.LongType(), False),
    T.StructField("x", T.DoubleType(), True),
    T.StructField("y", T.DoubleType(), True),
])

VERTEX = T.StructType([
    T.StructField("x", T.DoubleType(), True),
    T.StructField("y", T.DoubleType(), True),
])

LINES = T.StructType([
    T.StructField("line_id", T.LongType(), False),
    T.StructField("cost", T.DoubleType(), True),
    T.StructField("parts", T.ArrayType(T.ArrayType(VERTEX)), True),
])

COST_RASTER = T.StructType([
    T.StructField("cell_id", T.LongType(), False),
    T.StructField("v", T.DoubleType(), True),
])
