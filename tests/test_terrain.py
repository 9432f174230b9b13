import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from wayfield.operators import neighbours as N, terrain as R
from wayfield.schema import GridMeta


def values(df, name="value"):
    return {r.cell_id: r[name] for r in df.collect()}


def test_ramp_slope_and_direction(spark):
    cells, meta = brute.grid(spark, [[c for c in range(5)] for _ in range(5)])
    percent, degrees = values(R.slope(cells, meta, "percent", 2)), values(R.slope(cells, meta, "degrees", 3))
    for cell in range(25):
        inside = cell // 5 in (1, 2, 3) and cell % 5 in (1, 2, 3)
        assert percent[cell] == pytest.approx(10.0 if inside else 0.0)
        assert degrees[cell] == pytest.approx(5.710593 if inside else 0.0)
    w = {(r.src, r.dst): r.w for r in N.edges(cells, 8, meta).collect()}
    assert w[(11, 12)] > w[(12, 11)]


def test_slope_next_to_missing_elevation_is_null(spark):
    rows = [[float(r * c) for c in range(5)] for r in range(5)]
    rows[2][2] = None
    cells, meta = brute.grid(spark, rows)
    got = values(R.slope(cells, meta))
    assert got[11] is None and got[7] is None and got[6] is not None
    gaps = values(R.slope(cells.where("z is not null"), meta))
    assert gaps[11] is None and 12 not in gaps


def test_flat_grid_costs(spark):
    cells, meta = brute.grid(spark, [[0.0] * 3] * 3)
    unit = 0.01 / (6 * math.exp(-0.175))
    w = {(r.src, r.dst): r.w for r in N.edges(cells, 8, meta).collect()}
    assert len(w) == 40 and w[(0, 1)] == pytest.approx(unit) and w[(0, 4)] == pytest.approx(unit * math.sqrt(2))
    assert values(R.base_cost(cells, 8, meta))[0] == pytest.approx(unit * (2 + math.sqrt(2)) / 3)


@pytest.mark.parametrize("k", [8, 16, 24, 32, 64])
@pytest.mark.parametrize("local", ["false", "true"])
def test_edges_match_brute_force(spark, k, local):
    """With either join, tiles smaller than the grid, missing cells and multipliers."""
    rnd = random.Random(k)
    rows = [[None if rnd.random() < 0.1 else rnd.uniform(0, 8) for _ in range(9)] for _ in range(7)]
    cells, meta = brute.grid(spark, rows)
    mult = {i: rnd.choice([0.5, 2.0]) for i in range(0, 63, 3)}
    table = spark.createDataFrame(list(mult.items()), "cell_id long, m double")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", local)
    try:
        got = {(r.src, r.dst): r.w for r in N.edges(cells, k, meta, table, tile_size=4).collect()}
        base = values(R.base_cost(cells, k, meta, tile_size=4))
        profile = {r.src: r.degree for r in N.degree_profile(N.edges(cells, k, meta, tile_size=4), cells).collect()}
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    want = {(v, u): w for v, out in brute.edges(rows, meta, k, mult).items() for u, w in out}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
    plain = brute.edges(rows, meta, k)
    for cell, out in plain.items():
        if rows[cell // meta.ncols][cell % meta.ncols] is None:
            assert base[cell] is None
        else:
            assert base[cell] == pytest.approx(sum(w for _, w in out) / len(out) if out else 0.0)
        assert profile[cell] == len(out)


def test_one_cell_grid(spark):
    cells, meta = brute.grid(spark, [[3.0]])
    assert N.edges(cells, 16, meta).count() == 0 and values(R.slope(cells, meta)) == {0: 0.0}


def test_edges_shuffle_narrow_cells_only(spark):
    """Both join inputs are exchanged by tile, before the stencil expands them."""
    cells, meta = brute.grid(spark, [[0.0] * 20] * 20)
    plan = R.base_cost(cells, 16, meta, tile_size=8)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert len(exchanges) == 2 and all("hashpartitioning(tile" in line for line in exchanges)


@pytest.mark.parametrize("b", [0, 1, 2, 4, 200])
@pytest.mark.parametrize("how", ["sum", "max"])
def test_dilation_matches_brute_force(spark, b, how):
    rnd = random.Random(b)
    meta = GridMeta(6, 9, 0, 60, 10, -10, "local")
    sparse = {rnd.randrange(54): rnd.randrange(1, 9) for _ in range(7)}
    table = spark.createDataFrame([(c, n) for c, n in sparse.items()], "cell_id long, value long")
    fold = (lambda a, n: a + n) if how == "sum" else max
    assert values(R.dilate(table, meta, b, how)) == brute.box(sparse, meta, b, fold)


@pytest.mark.parametrize("how", ["sum", "max"])
def test_dilation_moves_as_many_rows_for_any_box(spark, how):
    """Rows before the shuffle of a pass depend on the values alone."""
    cells, meta = brute.grid(spark, [[(r * 7 + c * 3) % 10 for c in range(12)] for r in range(8)])
    at = cells.select("row", "col", F.col("z").cast("bigint").alias("value"))
    changes = R._sum_changes if how == "sum" else R._max_changes
    per_value = {"sum": 2, "max": 4}[how]
    for b in (2, 200):
        plan = changes(at, "col", "row", b)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate inline") == 1 and "explode" not in plan
        assert R._spread(at, "col", "row", b, 11, changes).count() == 96
        assert changes(at, "col", "row", b).count() <= per_value * 96
    wide = values(R.dilate(cells.select("cell_id", F.col("z").cast("bigint").alias("value")), meta, 200, how))
    total = [(r * 7 + c * 3) % 10 for r in range(8) for c in range(12)]
    assert wide == {i: sum(total) if how == "sum" else max(total) for i in range(96)}


def test_multipliers_stack_and_count(spark):
    cells, meta = brute.grid(spark, [[0.0] * 4])
    lines = spark.createDataFrame([(0, 2.0), (1, 1.0)], "cell_id long, m double")
    raster = spark.createDataFrame([(0, 0.5), (1, float("nan")), (2, 3.0), (3, -1.0)], "cell_id long, v double")
    mult = R.combine_multipliers(cells, lines, raster)
    assert values(mult, "m") == {0: 1.0, 1: 1.0, 2: 3.0, 3: 1.0}
    stats = R.modifier_stats(lines, raster, meta).first()
    assert (stats.modified_cells, stats.total_cells, stats.modified_percent, stats.applied_raster_cells) == (1, 4, 25.0, 2)
    base = cells.select("cell_id", F.lit(2.0).alias("value"))
    assert values(R.total_cost(base, mult)) == {0: 2.0, 1: 2.0, 2: 6.0, 3: 2.0}
