"""Point and line features, as columns or as well-known text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfield.schema import LINES, POINTS

LINE_KINDS = ("LINESTRING", "MULTILINESTRING")


def _load(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def geometry_kind(wkt: Column) -> Column:
    """Upper-case geometry tag of a WKT text, without any Z or M suffix."""
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def keep_geometry(df: DataFrame, kinds: tuple[str, ...], wkt: str = "wkt") -> DataFrame:
    return df.where(geometry_kind(F.col(wkt)).isin(*kinds))


def _vertex(text: Column) -> Column:
    """Two numbers; null where there are none, as in an empty geometry."""
    xy = F.split(F.trim(text), r"\s+")
    return F.struct(*[F.get(xy, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xy")])


def points_from_wkt(df: DataFrame, wkt: str = "wkt") -> DataFrame:
    """``point_id, wkt`` to ``point_id, x, y``; other and empty geometries are left out."""
    inner = F.regexp_extract(F.col(wkt), r"\(([^()]*)\)", 1)
    vertex = _vertex(inner)
    return keep_geometry(df, ("POINT",), wkt).select(
        "point_id", vertex["x"].alias("x"), vertex["y"].alias("y")).where("x is not null and y is not null")


def lines_from_wkt(df: DataFrame, wkt: str = "wkt") -> DataFrame:
    """``line_id, cost, wkt`` to nested parts; other geometries and vertices that are no numbers are left out."""
    known = lambda v: v["x"].isNotNull() & v["y"].isNotNull()
    parts = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), 1)
    return keep_geometry(df, LINE_KINDS, wkt).select(
        "line_id", "cost",
        F.transform(parts, lambda part: F.filter(F.transform(F.split(part, ","), _vertex), known)).alias("parts"))


def _vertex_text(v: Column) -> Column:
    return F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))


def vertices_text(vertices: Column) -> Column:
    """What stands between the brackets of a LINESTRING text, from an array of x, y structs."""
    return F.concat_ws(", ", F.transform(vertices, _vertex_text))


def lines_to_wkt(lines: DataFrame) -> DataFrame:
    part = lambda p: F.concat(F.lit("("), vertices_text(p), F.lit(")"))
    body = F.concat_ws(", ", F.transform("parts", part))
    return lines.select("line_id", "cost", F.when(F.size("parts") == 1, F.concat(F.lit("LINESTRING "), body))
                        .otherwise(F.concat(F.lit("MULTILINESTRING ("), body, F.lit(")"))).alias("wkt"))


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", wkt: bool = False) -> DataFrame:
    """Point features from ``point_id, x, y`` columns or from ``point_id, wkt``."""
    if wkt:
        schema = T.StructType([POINTS["point_id"], T.StructField("wkt", T.StringType())])
        return points_from_wkt(_load(spark, path, schema, fmt))
    return _load(spark, path, POINTS, fmt)


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet", wkt: bool = False) -> DataFrame:
    """Line features with ``cost`` from nested arrays or from ``line_id, cost, wkt``."""
    if wkt:
        schema = T.StructType([LINES["line_id"], LINES["cost"], T.StructField("wkt", T.StringType())])
        return lines_from_wkt(_load(spark, path, schema, fmt))
    return _load(spark, path, LINES, fmt)


def write_path_lines(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", compression: str | None = None) -> None:
    """Store path lines as ``path_id, dest_id, wkt``; by default compressed as the format is.

    Texts of lines are long and shrink to about a fifth even with a fast codec (``lz4``).
    """
    out = df.select("path_id", "dest_id", "wkt").write.mode(mode).format(fmt)
    (out.option("compression", compression) if compression else out).save(path)
