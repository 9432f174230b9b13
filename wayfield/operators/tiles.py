"""Square tiles of the grid, with a halo of neighbouring cells.

A tile is the unit that keeps stencil work local: cells are shuffled once by tile, each tile also
receiving the few cells within ``reach`` of its edge, and all neighbour look-ups then stay inside
a partition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.schema import GridMeta


# Tile side for stencil work: small enough for many partitions, and halos of at most a fifth.
STENCIL_TILE = 64


def tiles_across(meta: GridMeta, size: int) -> int:
    return -(-meta.ncols // size)


def tiles_down(meta: GridMeta, size: int) -> int:
    return -(-meta.nrows // size)


def tile_count(meta: GridMeta, size: int) -> int:
    return tiles_across(meta, size) * tiles_down(meta, size)


def tile_of(row: Column, col: Column, meta: GridMeta, size: int) -> Column:
    across = F.lit(tiles_across(meta, size)).cast("bigint")
    return (F.floor(row / size) * across + F.floor(col / size)).cast("bigint")


def _span(at: Column, size: int, reach: int, last: int) -> Column:
    """Tile numbers along one axis whose padded extent holds position ``at``."""
    low = F.greatest(F.floor((at - reach) / size), F.lit(0))
    high = F.least(F.floor((at + reach) / size), F.lit(last))
    return F.sequence(low.cast("bigint"), high.cast("bigint"))


def halo_tiles(row: Column, col: Column, meta: GridMeta, size: int, reach: int) -> Column:
    """Numbers of all tiles whose padded extent holds a cell, as an array."""
    across = F.lit(tiles_across(meta, size)).cast("bigint")
    down = _span(row, size, reach, tiles_down(meta, size) - 1)
    along = _span(col, size, reach, tiles_across(meta, size) - 1)
    return F.flatten(F.transform(down, lambda tr: F.transform(along, lambda tc: tr * across + tc)))


def with_halo(cells: DataFrame, meta: GridMeta, size: int, reach: int) -> DataFrame:
    """Add column ``tile``, one copy of a row for each tile whose padded extent holds the cell."""
    return cells.withColumn("tile", F.explode(halo_tiles(F.col("row"), F.col("col"), meta, size, reach)))


@dataclass(frozen=True)
class StoredTiles:
    """Cells stored by tile, each tile with the cells within ``reach`` of its edge.

    ``rows`` is a scan that reports its partitioning by ``tile``, with columns ``tile, cell_id, row, col, z`` and,
    if multipliers were stored, ``m``. Operators that take it for their cells read it without an exchange.
    """

    rows: DataFrame
    meta: GridMeta
    size: int
    reach: int

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "tile"]

    def home(self) -> DataFrame:
        """Each cell once, in its own tile."""
        return self.rows.where(F.col("tile") == tile_of(F.col("row"), F.col("col"), self.meta, self.size))

    def where(self, condition: Column) -> "StoredTiles":
        return replace(self, rows=self.rows.where(condition))

    def within(self, reach: int) -> DataFrame:
        """The rows within ``reach`` of their tile."""
        if reach > self.reach:
            raise ValueError(f"tiles are stored with the cells within {self.reach} of them, {reach} are needed")
        if reach == self.reach:
            return self.rows
        across = F.lit(tiles_across(self.meta, self.size)).cast("bigint")
        row0 = F.call_function("div", F.col("tile"), across) * self.size
        col0 = F.pmod(F.col("tile"), across) * self.size
        return self.rows.where(F.col("row").between(row0 - reach, row0 + self.size - 1 + reach)
                               & F.col("col").between(col0 - reach, col0 + self.size - 1 + reach))


def joins_keep_tiles(spark: SparkSession) -> bool:
    """Whether a join on (tile, ...) accepts inputs that are already partitioned by tile."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    return spark.conf.get(key, "true").lower() == "false"


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators are planned for."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Rows of the path operators hold arrays, so batches are bounded by bytes.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark
