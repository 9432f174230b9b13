"""Cell tables stored by tile together with the cells around each tile.

Such a table is bucketed by tile, and its scan reports so: slope, base cost, edges and packed tiles are made from it
without an exchange, as often as they are asked for. It costs one shuffle when it is written and the halo's share
of more storage (a tenth for the default tile of 512 with what path searches need around it).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.operators.tiles import StoredTiles, tile_count, with_halo
from wayfield.schema import GridMeta

# Cells in a bucket, about: a bucket is the work of one task.
BUCKET_CELLS = 1 << 22
# Most buckets a table may have by Spark's default settings.
MOST_BUCKETS = 100_000
LAYOUT = ("tile_side", "tile_reach", "buckets")


def bucket_count(meta: GridMeta, size: int, slots: int) -> int:
    """Buckets of about ``BUCKET_CELLS`` cells, at least one for each of ``slots``, at most one for each tile."""
    return min(tile_count(meta, size), max(slots, -(-meta.n_cells // BUCKET_CELLS)), MOST_BUCKETS)


def write_tiles(cells: DataFrame, path: str, meta: GridMeta, size: int, reach: int) -> StoredTiles:
    """Store ``cell_id, row, col, z`` (and multipliers ``m``, if there are any) by tile under ``path``, a new folder.

    ``reach`` is how far around a tile operators may look: the stencil's radius for slope and edges, the
    tiles' overlap besides for path searches (``Stencil.overlap + Stencil.reach``).
    """
    spark = cells.sparkSession
    buckets = bucket_count(meta, size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = ["cell_id", "row", "col", "z", *(["m"] if "m" in cells.columns else [])]
    layout = [F.lit(v).alias(name) for name, v in zip(LAYOUT, (size, reach, buckets))]
    table = _name()
    (with_halo(cells.select(kept), meta, size, reach).select("tile", *kept, *layout).repartition(buckets, "tile")
     .write.format("parquet").option("path", path).bucketBy(buckets, "tile").sortBy("tile").saveAsTable(table))
    return StoredTiles(spark.table(table).drop(*LAYOUT), meta, size, reach)


def read_tiles(spark: SparkSession, path: str, meta: GridMeta) -> StoredTiles:
    """Tiles stored by :func:`write_tiles`, perhaps by another session; the layout is read from the table itself."""
    layout = spark.read.schema(", ".join(f"{name} int" for name in LAYOUT)).parquet(path).first()
    if layout is None:
        raise ValueError(f"no tiles are stored in {path}")
    found = spark.read.parquet(path)
    table = _name()
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (tile) SORTED BY (tile) "
              f"INTO {layout['buckets']} BUCKETS LOCATION '{where}'")
    return StoredTiles(spark.table(table).drop(*LAYOUT), meta, layout["tile_side"], layout["tile_reach"])


def _name() -> str:
    return f"wayfield_tiles_{uuid.uuid4().hex}"
