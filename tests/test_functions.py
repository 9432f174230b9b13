import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.functions import costs, offsets
from wayfield.functions.geo import cell_id, cell_to_world, require_north_up, world_to_cell
from wayfield.schema import GridMeta

META = GridMeta(5, 7, 100.0, 500.0, 10.0, -20.0, "local")


@pytest.mark.parametrize("k, n, reach", [(8, 8, 1), (16, 16, 2), (24, 24, 2), (32, 32, 3), (64, 48, 3)])
def test_stencils_are_symmetric_and_exclude_the_cell(k, n, reach):
    steps = offsets.offsets(k)
    assert len(steps) == len(set(steps)) == n and (0, 0) not in steps
    assert {(-a, -b) for a, b in steps} == set(steps) == {(b, a) for a, b in steps}
    assert max(abs(a) for a, _ in steps) == reach == offsets.radius(k)


def test_stencils_grow():
    eight, sixteen, t24, t32, t64 = (set(offsets.offsets(k)) for k in offsets.NEIGHBOUR_OPTIONS)
    assert eight < sixteen < t24 < t32 < t64
    assert sixteen - eight == {(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)}
    assert t32 - t24 == {(a, b) for a in (-3, -1, 1, 3) for b in (-3, -1, 1, 3) if abs(a) != abs(b)}


def test_unknown_options_are_refused():
    with pytest.raises(ValueError):
        offsets.offsets(12)
    with pytest.raises(ValueError):
        costs.cost_function("teleport")
    with pytest.raises(ValueError):
        require_north_up(GridMeta(2, 2, 0, 0, 1, -1, "local", rot_x=0.1))


def test_offsets_table_has_step_lengths(spark):
    rows = offsets.offsets_table(spark, 16, META).collect()
    assert {(r.dr, r.dc): r.dh for r in rows}[(1, -2)] == math.hypot(20.0, 20.0)


def test_cost_is_the_same_for_columns_and_arrays(spark):
    dz = [-30.0, -0.5, 0.0, 0.4, 5.0, 60.0, 400.0]
    table = spark.createDataFrame([(z,) for z in dz], "dz double")
    for cap in ("speed", "exponent"):
        column = [r.w for r in table.select(costs.tobler(F.lit(10.0), F.col("dz"), cap).alias("w")).collect()]
        array = costs.tobler(10.0, np.array(dz), cap, costs.ARRAY_MATH)
        assert np.allclose(column, array, rtol=1e-13)
    flat = costs.tobler(10.0, np.array([0.0]), "speed", costs.ARRAY_MATH)[0]
    assert flat == pytest.approx(0.01 / (6 * math.exp(-0.175)))


def test_caps_differ_only_on_hopeless_slopes():
    dz = np.array([8.0, 9.0, 1000.0])
    speed, exponent = (costs.tobler(1.0, dz, cap, costs.ARRAY_MATH) for cap in ("speed", "exponent"))
    assert speed[0] == pytest.approx(exponent[0]) and speed[1] < exponent[1]
    assert speed[2] == pytest.approx(1e9) and exponent[2] == pytest.approx(math.exp(80) / 6000)


def test_multipliers_are_cleaned(spark):
    values = [None, float("nan"), -1.0, 0.0, 0.4, 3.0]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = table.select("i", costs.clean_line_multiplier(F.col("v")).alias("line"),
                        costs.clean_raster_multiplier(F.col("v")).alias("raster")).orderBy("i").collect()
    assert [r.line for r in rows] == [r.raster for r in rows] == [1.0, 1.0, 1.0, 1.0, 0.4, 3.0]


def test_world_and_cell(spark):
    xy = [(100.0, 500.0), (109.9, 480.1), (110.0, 480.0), (169.9, 400.1), (170.0, 400.0), (99.9, 500.1)]
    row, col = world_to_cell(F.col("x"), F.col("y"), META)
    got = spark.createDataFrame(xy, "x double, y double").select(row.alias("r"), col.alias("c")).collect()
    assert [(r.r, r.c) for r in got] == [(0, 0), (0, 0), (1, 1), (4, 6), (5, 7), (-1, -1)]
    x, y = cell_to_world(F.lit(2), F.lit(3), META, "center")
    back = spark.range(1).select(x.alias("x"), y.alias("y"), cell_id(F.lit(2), F.lit(3), META).alias("id")).first()
    assert (back.x, back.y, back.id) == (135.0, 450.0, 17)
