"""Input checks as one-row reports ``check, ok, status``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.geo import is_rotated
from wayfield.operators.points import points_to_cells
from wayfield.schema import GridMeta


def _report(df: DataFrame, check: str, status: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), (status == "ok").alias("ok"), status.alias("status"))


def _cell_facts(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """One row: different cells on the grid, rows on it and off it.

    Each task marks the cells that it reads in bitmaps of 32,768 cells and counts them; only bitmaps are shuffled. A cell
    that two tasks read, or one twice, shows in the number of rows.
    """
    on_grid = F.coalesce(F.col("cell_id").between(0, meta.n_cells - 1), F.lit(False))
    at = F.when(on_grid, F.col("cell_id") + 1)
    bits = (cells.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"),
                      F.count_if(on_grid).alias("inside"), F.count_if(~on_grid).alias("outside")))
    return bits.agg(F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))), F.lit(0)).alias("distinct"),
                    F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"), F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"))


def _complete(meta: GridMeta, first: Column) -> Column:
    """``first``, a ``when`` chain, followed by the status of the cells."""
    return (first.when(F.col("outside") > 0, "cells_outside_grid")
                 .when(F.col("inside") > F.col("distinct"), "repeated_cells")
                 .when(F.col("distinct") != meta.n_cells, "missing_cells").otherwise("ok"))


def check_dem(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Usable resolution, a CRS, and every cell exactly once."""
    first = F.when(F.lit(meta.dx == 0 and meta.dy == 0), "no_geotransform").when(F.lit(not meta.crs), "no_crs")
    return _report(_cell_facts(cells, meta), "dem", _complete(meta, first))


def check_points(points: DataFrame) -> DataFrame:
    """At least one feature."""
    return _report(points.agg(F.count("*").alias("n")), "points",
                   F.when(F.col("n") == 0, "no_points").otherwise("ok"))


def points_bounds(points: DataFrame, meta: GridMeta) -> DataFrame:
    """Points in all, outside the closed extent, and assigned to no cell.

    The extent test includes all four edges; the assignment to cells does not include the far ones.
    """
    x_end, y_end = meta.x0 + meta.ncols * meta.dx, meta.y0 + meta.nrows * meta.dy
    x_range, y_range = sorted((meta.x0, x_end)), sorted((meta.y0, y_end))
    inside = F.col("x").between(*x_range) & F.col("y").between(*y_range)
    col, row = F.floor((F.col("x") - meta.x0) / meta.dx), F.floor((F.col("y") - meta.y0) / meta.dy)
    on_grid = row.between(0, meta.nrows - 1) & col.between(0, meta.ncols - 1)
    # A point without coordinates is nowhere: outside, and in no cell.
    outside, nowhere = (~F.coalesce(x, F.lit(False)) for x in (inside, on_grid))
    return points.agg(F.count("*").alias("total"), F.count_if(outside).alias("outside"),
                      F.count_if(nowhere).alias("without_cell"))


def points_bounds_report(points: DataFrame, meta: GridMeta) -> DataFrame:
    """Bounds facts with a status telling all from some."""
    status = (F.when(F.col("outside") == 0, "ok")
               .when(F.col("outside") == F.col("total"), "all_outside").otherwise("some_outside"))
    return points_bounds(points, meta).select("total", "outside", "without_cell", status.alias("status"))


def check_points_bounds(points: DataFrame, meta: GridMeta) -> DataFrame:
    return _report(points_bounds_report(points, meta), "points_bounds", F.col("status"))


def check_origin(points: DataFrame) -> DataFrame:
    """Exactly one feature."""
    return _report(points.agg(F.count("*").alias("n")), "origin",
                   F.when(F.col("n") == 1, "ok").otherwise("not_exactly_one"))


def check_destinations(points: DataFrame, meta: GridMeta) -> DataFrame:
    """At least one feature, at least one of them on the grid; how many are skipped."""
    n = points_bounds(points, meta)
    status = (F.when(F.col("total") == 0, "no_destinations")
               .when(F.col("without_cell") == F.col("total"), "none_on_grid").otherwise("ok"))
    return n.select(F.lit("destinations").alias("check"), (status == "ok").alias("ok"), status.alias("status"),
                    F.col("total"), F.col("without_cell").alias("skipped"))


def usable_destinations(points: DataFrame, meta: GridMeta) -> DataFrame:
    return points_to_cells(points, meta).select(F.col("point_id").alias("dest_id"), "cell_id")


def check_inputs(cells: DataFrame, points: DataFrame, meta: GridMeta) -> DataFrame:
    """All checks as rows in the order they are made; see :func:`first_failure`."""
    reports = [check_dem(cells, meta), check_points(points), check_points_bounds(points, meta)]
    numbered = [r.select(F.lit(i).alias("step"), "check", "ok", "status") for i, r in enumerate(reports)]
    return reduce(DataFrame.unionByName, numbered)


def check_path_inputs(cells: DataFrame, origin: DataFrame, destinations: DataFrame, meta: GridMeta) -> DataFrame:
    """The checks of a search from one origin as rows in the order they are made, with the destinations' numbers."""
    reports = [check_dem(cells, meta), check_origin(origin), check_destinations(destinations, meta),
               check_points(points_to_cells(origin, meta))]
    none = F.lit(None).cast("bigint")
    numbered = [r.select(F.lit(i).alias("step"), "check", "ok", "status", *[c if c in r.columns else none.alias(c) for c in ("total", "skipped")])
                for i, r in enumerate(reports)]
    return reduce(DataFrame.unionByName, numbered)


def first_failure(reports: DataFrame) -> DataFrame:
    """Verdict of a chain of checks: the first that failed, or ``ok``."""
    bad = F.min(F.when(~F.col("ok"), F.struct("step", "check", "status")))
    return reports.agg(bad.alias("bad")).select(
        F.coalesce("bad.check", F.lit("all")).alias("check"), F.col("bad").isNull().alias("ok"),
        F.coalesce("bad.status", F.lit("ok")).alias("status"))


def check_same_grid(raster: DataFrame, meta: GridMeta, raster_meta: GridMeta) -> DataFrame:
    """A cost raster has the rows and columns of the elevation grid, and each of its cells exactly once."""
    first = F.when(F.lit(not meta.same_grid(raster_meta)), "other_dimensions")
    return _report(_cell_facts(raster, meta), "same_grid", _complete(meta, first))


def check_line_schema(lines: DataFrame) -> list[str]:
    """The columns of a line table; raises unless ``cost`` is among them."""
    if "cost" not in lines.columns:
        raise ValueError(f"lines have no column 'cost'; columns: {', '.join(lines.columns)}")
    return lines.columns


def line_schema_report(lines: DataFrame) -> DataFrame:
    """As the other checks: whether a line table has costs."""
    status = F.lit("ok" if "cost" in lines.columns else "no_cost_column")
    return _report(lines.agg(F.count("*")), "line_schema", status)


def check_rotation(transforms: DataFrame) -> DataFrame:
    """The verdict for each row of a table of geotransforms (``rot_x, rot_y`` are their rotation terms).

    No operator can work on a grid that is turned.
    """
    turned = is_rotated(F.col("rot_x"), F.col("rot_y"))
    return transforms.withColumns({"ok": ~turned, "status": F.when(turned, "rotated").otherwise("ok")})
