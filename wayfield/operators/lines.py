"""Lines to cells: segments, the integer line walk, rasterised multipliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.costs import clean_line_multiplier
from wayfield.functions.geo import in_grid, world_to_cell
from wayfield.operators.terrain import dilate
from wayfield.schema import GridMeta

# Longest run of cells unpacked from one array.
RUN = 4096


def line_segments(lines: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of every part: ``line_id, part, seg, cost, x1, y1, x2, y2``."""
    parts = lines.select("line_id", "cost", F.posexplode("parts").alias("part", "p"))
    n = F.size("p")
    pairs = F.when(n >= 2, F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b"))))
    return (parts.select("line_id", "part", "cost", F.posexplode(pairs).alias("seg", "s"))
                 .select("line_id", "part", "seg", "cost",
                         F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"),
                         F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")))


def segment_cells(segments: DataFrame, meta: GridMeta) -> DataFrame:
    """End cells of each segment; they may lie off the grid."""
    r1, c1 = world_to_cell(F.col("x1"), F.col("y1"), meta)
    r2, c2 = world_to_cell(F.col("x2"), F.col("y2"), meta)
    return segments.select("line_id", "part", "seg", "cost", r1.alias("r1"), c1.alias("c1"),
                           r2.alias("r2"), c2.alias("c2"))


def _entering(start: Column, step: Column, extent: int, margin: int) -> tuple[Column, Column]:
    """First and last walk step whose major coordinate is within ``margin`` of the grid."""
    top = F.lit(extent - 1 + margin)
    low = F.when(step > 0, -margin - start).otherwise(start - top)
    high = F.when(step > 0, top - start).otherwise(start + margin)
    return low, high


def walk_segments(segments: DataFrame, meta: GridMeta, margin: int = 0) -> DataFrame:
    """Cells an integer line walk visits between the end cells of each segment.

    The walk moves one cell per step on its longer axis and by a closed form on the other, so the
    cells of a segment come from a sequence of step numbers. Only steps within ``margin`` of the
    grid are made, whatever the length of the segment, and long walks are unpacked in runs.
    """
    ends = segment_cells(segments, meta)
    wide, tall = F.abs(F.col("c2") - F.col("c1")), F.abs(F.col("r2") - F.col("r1"))
    walk = ends.select(
        "line_id", "part", "seg", "cost", "r1", "c1",
        F.when(F.col("c1") < F.col("c2"), 1).otherwise(-1).alias("sc"),
        F.when(F.col("r1") < F.col("r2"), 1).otherwise(-1).alias("sr"),
        (wide >= tall).alias("by_col"), F.greatest(wide, tall).alias("n"), F.least(wide, tall).alias("m"))
    col_low, col_high = _entering(F.col("c1"), F.col("sc"), meta.ncols, margin)
    row_low, row_high = _entering(F.col("r1"), F.col("sr"), meta.nrows, margin)
    walk = (walk.withColumn("lo", F.greatest(F.lit(0), F.when(F.col("by_col"), col_low).otherwise(row_low)))
                .withColumn("hi", F.least("n", F.when(F.col("by_col"), col_high).otherwise(row_high)))
                .where(F.col("lo") <= F.col("hi"))
                .withColumn("run", F.explode(F.sequence("lo", "hi", F.lit(RUN).cast("bigint"))))
                .withColumn("step", F.explode(F.sequence("run", F.least(F.col("run") + RUN - 1, F.col("hi"))))))
    minor = F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(F.call_function(
        "div", 2 * F.col("step") * F.col("m") + F.col("n") - 1, F.greatest(2 * F.col("n"), F.lit(1).cast("bigint"))))
    along_col = F.when(F.col("by_col"), F.col("step")).otherwise(minor)
    along_row = F.when(F.col("by_col"), minor).otherwise(F.col("step"))
    cells = walk.select("line_id", "part", "seg", "step", "cost",
                        (F.col("r1") + F.col("sr") * along_row).alias("row"),
                        (F.col("c1") + F.col("sc") * along_col).alias("col"))
    near = (F.col("row").between(-margin, meta.nrows - 1 + margin)
            & F.col("col").between(-margin, meta.ncols - 1 + margin))
    return cells.where(near)


def rasterize_lines(lines: DataFrame, meta: GridMeta, b: int = 2, combine: str = "max_with_1") -> DataFrame:
    """Line multipliers per covered cell: ``cell_id, m``.

    The largest multiplier wins where buffers overlap. With ``max_with_1`` it is never below 1, so
    lines can only slow travel down; ``max`` keeps multipliers below 1. Cells are reduced to one
    value each before and during the dilation.
    """
    if combine not in ("max_with_1", "max"):
        raise ValueError(f"combine must be 'max_with_1' or 'max', got {combine!r}")
    cost = clean_line_multiplier(F.col("cost"))
    cells = walk_segments(line_segments(lines).withColumn("cost", cost), meta, b)
    # Positions up to b outside the grid still reach into it, so spread in a grid that is b wider.
    wider = GridMeta(meta.nrows + 2 * b, meta.ncols + 2 * b, 0.0, 0.0, 1.0, -1.0)
    spread = dilate(cells.select(
        ((F.col("row") + b) * F.lit(wider.ncols).cast("bigint") + F.col("col") + b).alias("cell_id"),
        F.col("cost").alias("value")), wider, b, "max")
    row = F.call_function("div", F.col("cell_id"), F.lit(wider.ncols).cast("bigint")) - b
    col = F.pmod(F.col("cell_id"), F.lit(wider.ncols).cast("bigint")) - b
    m = F.col("value") if combine == "max" else F.greatest(F.col("value"), F.lit(1.0))
    return (spread.select(row.alias("row"), col.alias("col"), m.alias("m"))
                  .where(in_grid(F.col("row"), F.col("col"), meta))
                  .select((F.col("row") * F.lit(meta.ncols).cast("bigint") + F.col("col")).alias("cell_id"), "m"))


def line_coverage(lines: DataFrame, meta: GridMeta) -> DataFrame:
    """Features read, features with a vertex on the grid, segment ends read and on the grid."""
    ends = segment_cells(line_segments(lines), meta)
    inside = (in_grid(F.col("r1"), F.col("c1"), meta).cast("int")
              + in_grid(F.col("r2"), F.col("c2"), meta).cast("int"))
    per_line = ends.groupBy("line_id").agg((2 * F.count("*")).alias("ends"), F.sum(inside).alias("inside"))
    return (lines.select("line_id").join(per_line, "line_id", "left")
                 .agg(F.count("*").alias("features"),
                      F.count_if(F.col("inside") > 0).alias("features_inside"),
                      F.coalesce(F.sum("ends"), F.lit(0)).alias("vertices"),
                      F.coalesce(F.sum("inside"), F.lit(0)).alias("vertices_inside")))
