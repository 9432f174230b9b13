"""Cell tables: one row per grid cell, stored in square storage blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfield.functions.geo import cell_col, cell_row
from wayfield.schema import CELLS, COST_RASTER, GridMeta

# Side of a storage block in cells: 2048 x 2048 cells give files of tens of MB.
BLOCK_SIDE = 2048
BLOCKS = ("block_side", "block_row", "block_col")


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_dem(spark: SparkSession, path: str, meta: GridMeta, nodata: float | None = None,
             fmt: str = "parquet", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Elevation cells; the NoData value and NaN become null.

    ``path`` holds columns ``cell_id, z``. ``window`` is (first row, last row, first col, last
    col); if the table has the storage blocks of :func:`write_cells`, whole blocks are skipped. Their
    size is stored with them.
    """
    raw = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField("z", T.DoubleType())])
    blocked = window is not None and fmt == "parquet" and "block_side" in spark.read.parquet(path).columns
    if blocked:
        raw = T.StructType(raw.fields + [T.StructField(c, T.IntegerType()) for c in BLOCKS])
    cells = _read(spark, path, raw, fmt)
    missing = F.isnan("z") if nodata is None else F.isnan("z") | (F.col("z") == nodata)
    cells = cells.select(
        "cell_id",
        cell_row(F.col("cell_id"), meta).cast("int").alias("row"),
        cell_col(F.col("cell_id"), meta).cast("int").alias("col"),
        F.when(missing, None).otherwise(F.col("z")).alias("z"),
        *(BLOCKS if blocked else []))
    if window is not None:
        r0, r1, c0, c1 = window
        cells = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
        if blocked:
            side = F.col("block_side")
            for block, low, high in (("block_row", r0, r1), ("block_col", c0, c1)):
                cells = cells.where(((F.col(block) + 1) * side > low) & (F.col(block) * side <= high))
    return cells.select(*CELLS.names)


def read_cost_raster(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Multiplier cells ``cell_id, v`` as stored; cleaning happens when they are applied."""
    return _read(spark, path, COST_RASTER, fmt)


def grid_from_cells(cells: DataFrame, x0: float, y0: float, dx: float, dy: float, crs: str) -> GridMeta:
    """Grid size from the cells themselves; one aggregate over two columns."""
    size = cells.agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols")).first()
    return GridMeta(size["nrows"] or 0, size["ncols"] or 0, x0, y0, dx, dy, crs)


def grid_extent(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Size, extent and resolution of a grid as one row."""
    return cells.agg((F.max("row") + 1).cast("bigint").alias("nrows"),
                     (F.max("col") + 1).cast("bigint").alias("ncols")).select(
        "nrows", "ncols",
        F.lit(meta.x0).alias("x_min"),
        (F.lit(meta.x0) + F.col("ncols") * meta.dx).alias("x_max"),
        (F.lit(meta.y0) + F.col("nrows") * meta.dy).alias("y_min"),
        F.lit(meta.y0).alias("y_max"),
        F.lit(meta.res_x).alias("res_x"), F.lit(meta.res_y).alias("res_y"))


def write_cells(df: DataFrame, path: str, meta: GridMeta, mode: str = "errorifexists") -> None:
    """Store a raster by square blocks, so that clipped reads skip whole folders.

    A block is spread over its rows' hash too, so one block is never one task's whole work.
    """
    row, col = cell_row(F.col("cell_id"), meta), cell_col(F.col("cell_id"), meta)
    (df.withColumn("block_side", F.lit(BLOCK_SIDE)).withColumn("block_row", F.floor(row / BLOCK_SIDE).cast("int"))
       .withColumn("block_col", F.floor(col / BLOCK_SIDE).cast("int"))
       .repartition("block_row", "block_col", F.pmod(F.hash(row), F.lit(4)))
       .sortWithinPartitions("block_row", "block_col", "cell_id")
       .write.mode(mode).partitionBy(*BLOCKS).parquet(path))


def full_grid(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """Every cell of the grid, made by Spark without any input."""
    ids = spark.range(meta.n_cells).withColumnRenamed("id", "cell_id")
    return ids.select("cell_id", cell_row(F.col("cell_id"), meta).cast("int").alias("row"),
                      cell_col(F.col("cell_id"), meta).cast("int").alias("col"))
