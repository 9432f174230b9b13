"""Points to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.functions.geo import cell_id, in_grid, world_to_cell
from wayfield.schema import GridMeta


def points_to_cells(points: DataFrame, meta: GridMeta) -> DataFrame:
    """Points on the grid with their cell: ``point_id, cell_id, row, col``."""
    row, col = world_to_cell(F.col("x"), F.col("y"), meta)
    return (points.select("point_id", row.alias("row"), col.alias("col"))
                  .where(in_grid(F.col("row"), F.col("col"), meta))
                  .select("point_id", cell_id(F.col("row"), F.col("col"), meta).alias("cell_id"), "row", "col"))


def points_on_cells(points: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Points with the elevation of their cell."""
    return points_to_cells(points, meta).select("point_id", "cell_id").join(
        cells.select("cell_id", "z"), "cell_id")


def sample_cells(points: DataFrame, meta: GridMeta) -> DataFrame:
    """Distinct cells that hold points, with how many: ``cell_id, m``."""
    return points_to_cells(points, meta).groupBy("cell_id").agg(F.count("*").alias("m"))


def cells_with_points(cells: DataFrame, points: DataFrame, meta: GridMeta) -> DataFrame:
    """The cells that hold at least one point."""
    return cells.join(points_to_cells(points, meta).select("cell_id"), "cell_id", "left_semi")
