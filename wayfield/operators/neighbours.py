"""Neighbour join and the directed edge table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.costs import cost_function
from wayfield.functions.geo import in_grid
from wayfield.functions.offsets import offsets, radius, step_length
from wayfield.operators.tiles import STENCIL_TILE, StoredTiles, joins_keep_tiles, tile_of, with_halo
from wayfield.schema import GridMeta


def _stencil(k: int, meta: GridMeta) -> Column:
    """The stencil as a literal array, so that expanding it is a generator and not a join."""
    return F.array(*[
        F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"),
                 F.lit(step_length(dr, dc, meta)).alias("dh"))
        for dr, dc in offsets(k)])


def neighbour_pairs(cells: DataFrame | StoredTiles, k: int, meta: GridMeta, tile_size: int = STENCIL_TILE,
                    how: str = "inner") -> DataFrame:
    """Each cell with each in-grid cell of its stencil.

    Columns ``tile, src, z_from, dst, dr, dc, dh, z_to`` and, when ``cells`` has it, the target's
    multiplier ``m``. The narrow cell rows are shuffled by tile before the stencil expands them,
    and the join looks up cells inside the tile. With ``how='left'`` targets that have no row stay
    as nulls. Stored tiles are joined with themselves where they lie.
    """
    spark = cells.sparkSession
    extra = ["m"] if "m" in cells.columns else []
    stored = cells if isinstance(cells, StoredTiles) else None
    if stored is not None:
        cells, tile_size = stored.home(), stored.size
    near = cells.select(tile_of(F.col("row"), F.col("col"), meta, tile_size).alias("tile") if stored is None else F.col("tile"),
                        F.col("cell_id").alias("src"), "row", "col", F.col("z").alias("z_from"))
    local = joins_keep_tiles(spark)
    if local and stored is None:
        near = near.repartition("tile")
    near = (near.withColumn("step", F.explode(_stencil(k, meta)))
                .select("tile", "src", "z_from",
                        (F.col("row") + F.col("step.dr")).alias("_row"),
                        (F.col("col") + F.col("step.dc")).alias("_col"),
                        F.col("step.dr").alias("dr"), F.col("step.dc").alias("dc"),
                        F.col("step.dh").alias("dh"))
                .where(in_grid(F.col("_row"), F.col("_col"), meta)))
    far_columns = [F.col("row").alias("_row"), F.col("col").alias("_col"),
                   F.col("cell_id").alias("dst"), F.col("z").alias("z_to"), *extra]
    if local:
        far = (with_halo(cells, meta, tile_size, radius(k)).repartition("tile") if stored is None else stored.within(radius(k)))
        pairs = near.join(far.select("tile", *far_columns).hint("shuffle_hash"), ["tile", "_row", "_col"], how)
    else:
        pairs = near.join(cells.select(*far_columns), ["_row", "_col"], how)
    return pairs.select("tile", "src", "z_from", "dst", "dr", "dc", "dh", "z_to", *extra)


def with_multipliers(cells: DataFrame | StoredTiles, mult: DataFrame | None) -> DataFrame | StoredTiles:
    """Cells with their multiplier as column ``m``; unchanged when there is none.

    Multipliers that come with stored tiles lie in them already; others are joined by cell.
    """
    if mult is None:
        return cells
    if isinstance(cells, StoredTiles):
        return replace(cells, rows=with_multipliers(cells.rows.drop("m"), mult))
    return (cells.join(mult.select("cell_id", "m"), "cell_id", "left")
                 .withColumn("m", F.coalesce("m", F.lit(1.0))))


def edges(cells: DataFrame | StoredTiles, k: int, meta: GridMeta, mult: DataFrame | None = None,
          cap: str = "speed", cost: str = "tobler", tile_size: int = STENCIL_TILE) -> DataFrame:
    """Directed weighted edges ``src, dst, w``: hours, times the multiplier of the target cell.

    Cells without elevation have no edges.
    """
    known = with_multipliers(cells.where(F.col("z").isNotNull()), mult)
    pairs = neighbour_pairs(known, k, meta, tile_size)
    w = cost_function(cost)(F.col("dh"), F.col("z_to") - F.col("z_from"), cap)
    if "m" in pairs.columns:
        w = w * F.col("m")
    return pairs.select("src", "dst", w.alias("w"))


def degree_profile(edge_table: DataFrame, cells: DataFrame) -> DataFrame:
    """Out-degree of every cell, 0 for cells without an edge."""
    rows = edge_table.select("src", F.lit(1).alias("one")).unionByName(cells.select(F.col("cell_id").alias("src"), F.lit(0).alias("one")))
    return rows.groupBy("src").agg(F.sum("one").alias("degree"))


def edge_totals(edge_table: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells, edges and the range of out-degrees as one row."""
    return degree_profile(edge_table, cells).agg(
        F.count("*").alias("cells"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
