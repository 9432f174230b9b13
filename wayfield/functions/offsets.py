"""Neighbour stencils: which cells one step may reach."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from wayfield.schema import GridMeta

# Accepted stencil sizes.
NEIGHBOUR_OPTIONS = (8, 16, 24, 32, 64)


def _is_step(k: int, dr: int, dc: int) -> bool:
    near, far = sorted((abs(dr), abs(dc)))
    if far == 0:
        return False
    if far == 1 or k == 64:
        return True
    knight = (near, far) == (1, 2)
    if k == 16:
        return knight
    if k == 24:
        return far == 2
    return k == 32 and (far == 2 or (near, far) == (1, 3))


def offsets(k: int) -> list[tuple[int, int]]:
    """The (dr, dc) steps of stencil ``k`` in row-major order.

    8 is the ring around a cell, 16 adds the knight moves, 24 is the full 5x5 square, 32 adds the
    (1, 3) moves to it, and 64 is the full 7x7 square, which has 48 distinct steps.
    """
    if k not in NEIGHBOUR_OPTIONS:
        raise ValueError(f"neighbours must be one of {NEIGHBOUR_OPTIONS}, got {k}")
    reach = radius(k)
    span = range(-reach, reach + 1)
    return [(dr, dc) for dr in span for dc in span if _is_step(k, dr, dc)]


def radius(k: int) -> int:
    return {8: 1, 16: 2, 24: 2, 32: 3, 64: 3}[k]


def step_length(dr: int, dc: int, meta: GridMeta) -> float:
    """Planar length of one step in map units."""
    return math.sqrt((dr * meta.res_y) ** 2 + (dc * meta.res_x) ** 2)


def offsets_table(spark: SparkSession, k: int, meta: GridMeta) -> DataFrame:
    """Stencil as a table ``(k, dr, dc, dh)``; at most 48 rows."""
    rows = [(i, dr, dc, step_length(dr, dc, meta)) for i, (dr, dc) in enumerate(offsets(k))]
    return spark.createDataFrame(rows, "k int, dr int, dc int, dh double")
