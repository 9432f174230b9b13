"""Focal rasters: slope, base cost, multipliers, total cost, box dilation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfield.functions.costs import clean_raster_multiplier, cost_function, slope_in_units
from wayfield.functions.geo import cell_col, cell_row
from wayfield.operators.neighbours import neighbour_pairs
from wayfield.operators.tiles import STENCIL_TILE, StoredTiles, tile_of, with_halo
from wayfield.schema import GridMeta


def slope(cells: DataFrame | StoredTiles, meta: GridMeta, units: str = "degrees", tile_size: int = STENCIL_TILE) -> DataFrame:
    """Slope by central differences; 0 on the outermost rows and columns.

    Cells are shuffled once by tile with a one-cell halo; stored tiles are read as they are. Both axes are then
    windows inside the tile. A neighbour counts only if it is the adjacent cell, so gaps give null.
    """
    if isinstance(cells, StoredTiles):
        local, tile_size = cells.within(1), cells.size
    else:
        local = with_halo(cells, meta, tile_size, 1).repartition("tile")

    def difference(along: str, across: str, res: float):
        w = Window.partitionBy("tile", across).orderBy(along)
        adjacent = ((F.lead(along).over(w) == F.col(along) + 1)
                    & (F.lag(along).over(w) == F.col(along) - 1))
        return F.when(adjacent, (F.lead("z").over(w) - F.lag("z").over(w)) / (2.0 * res))

    gradients = (local.withColumn("gx", difference("col", "row", meta.res_x))
                      .withColumn("gy", difference("row", "col", meta.res_y))
                      .where(F.col("tile") == tile_of(F.col("row"), F.col("col"), meta, tile_size)))
    border = (F.col("row").isin(0, meta.nrows - 1)) | (F.col("col").isin(0, meta.ncols - 1))
    gradient = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return gradients.select(
        "cell_id", F.when(border, F.lit(0.0)).otherwise(slope_in_units(gradient, units)).alias("value"))


def base_cost(cells: DataFrame | StoredTiles, k: int, meta: GridMeta, cost: str = "tobler",
              tile_size: int = STENCIL_TILE) -> DataFrame:
    """Mean cost of leaving a cell towards its valid neighbours; 0 if it has none, null without elevation.

    The group key starts with the tile, so the aggregation needs no further shuffle.
    """
    pairs = neighbour_pairs(cells, k, meta, tile_size, how="left")
    w = cost_function(cost)(F.col("dh"), F.col("z_to") - F.col("z_from"), "speed")
    value = F.when(F.col("z").isNotNull(), F.coalesce("w", F.lit(0.0)))
    return (pairs.groupBy("tile", "src").agg(F.avg(w).alias("w"), F.max("z_from").alias("z"))
                 .select(F.col("src").alias("cell_id"), value.alias("value")))


def combine_multipliers(cells: DataFrame, line_mult: DataFrame | None,
                        cost_raster: DataFrame | None) -> DataFrame:
    """Product of the line and raster multipliers for every cell, 1 where neither says anything."""
    out = cells.select("cell_id")
    m = F.lit(1.0)
    if line_mult is not None:
        out = out.join(line_mult.select("cell_id", F.col("m").alias("lm")), "cell_id", "left")
        m = m * F.coalesce("lm", F.lit(1.0))
    if cost_raster is not None:
        out = out.join(cost_raster.select("cell_id", F.col("v").alias("rv")), "cell_id", "left")
        m = m * clean_raster_multiplier(F.col("rv"))
    return out.select("cell_id", m.alias("m"))


def total_cost(base: DataFrame, mult: DataFrame) -> DataFrame:
    """Base cost times multiplier, cell by cell."""
    return (base.join(mult.select("cell_id", "m"), "cell_id", "left")
                .select("cell_id", (F.col("value") * F.coalesce("m", F.lit(1.0))).alias("value")))


def modifier_stats(line_mult: DataFrame, cost_raster: DataFrame, meta: GridMeta) -> DataFrame:
    """Cells changed by lines (only raised ones count) and by the raster, as one row."""
    lines = line_mult.agg(F.count_if(F.col("m") > 1.0).alias("modified"))
    raster = cost_raster.agg(
        F.count_if(clean_raster_multiplier(F.col("v")) != 1.0).alias("applied_raster_cells"))
    both = lines.withColumn("_one", F.lit(1)).join(raster.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        F.col("modified").alias("modified_cells"), F.lit(meta.n_cells).cast("bigint").alias("total_cells"),
        (F.col("modified") * 100.0 / F.lit(meta.n_cells)).alias("modified_percent"), "applied_raster_cells")


def _sum_changes(cells: DataFrame, at: str, other: str, b: int) -> DataFrame:
    """Where the running sum of values within ``b`` changes along one axis, as ``other, x, value``.

    A value enters at its position less ``b`` and leaves after its position plus ``b``. ``value`` is null
    where nothing is within reach, which a count tells and not the sum.
    """
    moves = F.array(F.struct((F.col(at) - b).alias("x"), F.col("value").alias("v"), F.lit(1).alias("n")),
                    F.struct((F.col(at) + b + 1).alias("x"), (-F.col("value")).alias("v"), F.lit(-1).alias("n")))
    changes = cells.select(other, F.inline(moves)).groupBy(other, "x").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    so_far = Window.partitionBy(other).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(other, "x", F.when(F.sum("n").over(so_far) > 0, F.sum("v").over(so_far)).alias("value"))


def _max_changes(cells: DataFrame, at: str, other: str, b: int) -> DataFrame:
    """Where the largest value within ``b`` can change along one axis, as ``other, x, value``.

    The axis is cut into blocks of ``2b+1``, the length of the reach. So what is within ``b`` of a place is the
    end of one block and the start of the next: a running maximum backwards and one forwards. Each value asks
    at the two places where it comes and goes.
    """
    def ask(pos, x, tail):
        return F.struct(pos.alias("pos"), F.lit(None).alias("v"), x.alias("x"), F.lit(tail).alias("tail"))

    here, first, after = F.col(at), F.col(at) - b, F.col(at) + b + 1
    rows = F.array(F.struct(here.alias("pos"), F.col("value").alias("v"), first.alias("x"), F.lit(False).alias("tail")),
                   ask(first - b, first, True), ask(after - b, after, True), ask(after + b, after, False))
    asked = cells.select(other, F.inline(rows)).withColumn("block", F.floor(F.col("pos") / (2 * b + 1)))
    block = Window.partitionBy(other, "block")
    forwards = F.max("v").over(block.orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))
    backwards = F.max("v").over(block.orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0))
    return (asked.select(other, "x", F.when(F.col("tail"), backwards).otherwise(forwards).alias("value"))
                 .groupBy(other, "x").agg(F.max("value").alias("value")))


def _spread(cells: DataFrame, at: str, other: str, b: int, last: int, changes) -> DataFrame:
    """Value of every cell within ``b`` of a value along one axis.

    Between two changes it stays the same, so cells are unpacked from such runs, once each.
    """
    onwards = Window.partitionBy(other).orderBy("x")
    runs = (changes(cells, at, other, b).withColumn("end", F.lead("x").over(onwards) - 1)
            .where(F.col("value").isNotNull())
            .withColumns({"x": F.greatest("x", F.lit(0).cast("bigint")), "end": F.least("end", F.lit(last).cast("bigint"))})
            .where(F.col("x") <= F.col("end")))
    return runs.select(other, F.explode(F.sequence("x", "end")).alias(at), "value")


def dilate(values: DataFrame, meta: GridMeta, b: int, how: str) -> DataFrame:
    """Sum or maximum over the (2b+1) x (2b+1) box around each cell, clipped to the grid.

    ``values`` is sparse ``cell_id, value`` and may repeat cells; null values count as none. A box is one pass along rows and one
    along columns, and a pass shuffles a few rows for each value (two for sums, four for maxima) however wide
    the box is. Sums are differences of running sums: exact for integers, rounded for doubles.
    """
    if how not in ("sum", "max"):
        raise ValueError(f"how must be 'sum' or 'max', got {how!r}")
    agg, changes = (F.sum, _sum_changes) if how == "sum" else (F.max, _max_changes)
    cells = values.where(F.col("value").isNotNull()).groupBy("cell_id").agg(agg("value").alias("value"))
    if b == 0:
        return cells
    ncols = F.lit(meta.ncols).cast("bigint")
    at = cells.select(cell_row(F.col("cell_id"), meta).alias("row"),
                      cell_col(F.col("cell_id"), meta).alias("col"), "value")
    box = _spread(_spread(at, "col", "row", b, meta.ncols - 1, changes), "row", "col", b, meta.nrows - 1, changes)
    return box.select((F.col("row") * ncols + F.col("col")).alias("cell_id"), "value")


def on_grid(cells: DataFrame, values: DataFrame, name: str = "n") -> DataFrame:
    """A sparse count raster on every cell, 0 elsewhere."""
    return (cells.select("cell_id").join(values.select("cell_id", "value"), "cell_id", "left")
                 .select("cell_id", F.coalesce("value", F.lit(0)).cast("bigint").alias(name)))
