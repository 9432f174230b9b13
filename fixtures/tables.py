"""Analysis inputs derived from the given tables, always from all of their rows.

``part`` is the terrain: a grid 40 cells wide, 30 m a cell, one part per cell. ``supplier`` gives
sample points and lines, ``customer`` gives destinations. The *wide* terrain is made of ``orders``, 500
cells wide, with its own points. ``fixtures/oracle.py`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.operators.points import points_to_cells
from wayfield.schema import GridMeta

WIDTH = 40
WIDE = 500
CELL = 30.0
CRS = "LOCAL_CS[\"metres\"]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_meta(spark: SparkSession, sf_dir: str) -> GridMeta:
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last")).first()["last"]
    nrows = last // WIDTH + 1
    return GridMeta(nrows, WIDTH, 0.0, CELL * nrows, CELL, -CELL, CRS)


def wide_meta(spark: SparkSession, sf_dir: str) -> GridMeta:
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last")).first()["last"]
    nrows = last // WIDE + 1
    return GridMeta(nrows, WIDE, 0.0, CELL * nrows, CELL, -CELL, CRS)


def wide_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("cell_id"), F.call_function("div", key, F.lit(WIDE)).cast("int").alias("row"),
        F.pmod(key, F.lit(WIDE)).cast("int").alias("col"),
        (F.pmod(F.col("o_custkey"), F.lit(40)) * F.lit(0.25) + F.col("o_totalprice") * F.lit(0.00001)).alias("z"))


def dem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("cell_id"), F.call_function("div", key, F.lit(WIDTH)).cast("int").alias("row"),
        F.pmod(key, F.lit(WIDTH)).cast("int").alias("col"),
        (F.col("p_size") * F.lit(0.25) + F.col("p_retailprice") * F.lit(0.01)).alias("z"))


def cost_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    v = F.pmod(key * 7, F.lit(11)) * F.lit(0.25) - F.lit(0.25)
    return table(spark, sf_dir, "part").select(
        key.alias("cell_id"),
        F.when(F.pmod(key, F.lit(101)) == 0, F.lit(None).cast("double"))
         .when(F.pmod(key, F.lit(97)) == 0, F.lit(float("nan"))).otherwise(v).alias("v"))


def _x(col: Column) -> Column:
    return (col + 0.5) * CELL


def _y(row: Column, meta: GridMeta) -> Column:
    return F.lit(meta.y0) - (row + 0.5) * CELL


def _placed(df: DataFrame, key: str, row: Column, col: Column, meta: GridMeta) -> DataFrame:
    """Points at cell centres; every tenth lies below the grid."""
    off = F.when(F.pmod(F.col(key), F.lit(10)) == 9, meta.nrows).otherwise(0)
    row = F.pmod(row, F.lit(meta.nrows)) + off
    col = F.pmod(col, F.lit(meta.ncols))
    return df.select(F.col(key).alias("point_id"), _x(col).alias("x"), _y(row, meta).alias("y"))


def points(spark: SparkSession, sf_dir: str, meta: GridMeta) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    across = 11 if meta.ncols == WIDTH else 37
    return _placed(table(spark, sf_dir, "supplier"), "s_suppkey", k * 7 + n, k * across + n * 3, meta)


def destinations(spark: SparkSession, sf_dir: str, meta: GridMeta) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    across = 7 if meta.ncols == WIDTH else 17
    return _placed(table(spark, sf_dir, "customer"), "c_custkey", k * 3 + n, k * across + n * 5, meta)


def origin(spark: SparkSession, sf_dir: str, meta: GridMeta) -> DataFrame:
    """Mean centre of the sample points on the grid."""
    row, col = F.floor((F.col("y") - meta.y0) / meta.dy), F.floor((F.col("x") - meta.x0) / meta.dx)
    return (points(spark, sf_dir, meta)
            .where(row.between(0, meta.nrows - 1) & col.between(0, meta.ncols - 1))
            .agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
            .select(F.lit(0).cast("bigint").alias("point_id"), "x", "y"))


def lines(spark: SparkSession, sf_dir: str, meta: GridMeta) -> DataFrame:
    """Short three-vertex lines; even keys have one part, odd keys two, every eighth runs off the grid."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    r0, c0 = F.pmod(k * 3 + n, F.lit(meta.nrows)), F.pmod(k * 5 + n * 7, F.lit(WIDTH))
    r1, c1 = r0 + F.pmod(k, F.lit(7)) - 3, c0 + F.pmod(n * 11, F.lit(9)) - 4
    r2, c2 = r1 + F.pmod(n, F.lit(5)) - 2, c1 + F.pmod(k * 3, F.lit(11)) - 5
    c2 = c2 + F.when(F.pmod(k, F.lit(8)) == 7, 60).otherwise(0)
    a, b, c = (F.struct(_x(col).alias("x"), _y(row, meta).alias("y")) for row, col in ((r0, c0), (r1, c1), (r2, c2)))
    parts = (F.when(F.pmod(k, F.lit(2)) == 0, F.array(F.array(a, b, c)))
              .otherwise(F.array(F.array(a, b), F.array(c, a))))
    return table(spark, sf_dir, "supplier").select(
        k.alias("line_id"), (F.pmod(n, F.lit(5)) * F.lit(0.75) - F.lit(0.25)).alias("cost"), parts.alias("parts"))


def sample_sources(spark: SparkSession, sf_dir: str, meta: GridMeta) -> DataFrame:
    return points_to_cells(points(spark, sf_dir, meta), meta).select("cell_id").distinct()
