import pytest
from pyspark.sql import functions as F

import brute
from wayfield.operators import checks
from wayfield.plans.jobs import fete, lcpa, source_passes
from wayfield.schema import GridMeta, JobOptions
from wayfield.sources import cells as C, features as V
from wayfield.sources.scratch import Scratch


def points(spark, meta, cells):
    data = [(i, (c % meta.ncols + 0.5) * meta.dx, meta.y0 + (c // meta.ncols + 0.5) * meta.dy)
            for i, c in enumerate(cells)]
    return spark.createDataFrame(data, "point_id long, x double, y double")


def raster(df, name="n"):
    return {r.cell_id: r[name] for r in df.collect()}


def test_shared_cells_weigh_both_ways(spark):
    """Two points in one cell and one elsewhere: every path counts twice in each direction."""
    cells, meta = brute.grid(spark, [[0.0] * 3] * 3)
    out = fete(cells, points(spark, meta, [3, 3, 5]), meta, JobOptions(neighbours=8))
    assert raster(out["density"]) == {0: 0, 1: 0, 2: 0, 3: 4, 4: 4, 5: 4, 6: 0, 7: 0, 8: 0}
    assert tuple(out["summary"].first()) == (4, 4, 4, 3, 9)
    assert set(out) == {"slope", "base_cost", "density", "summary", "report"}


def test_buffer_is_clipped_and_counts_again(spark):
    cells, meta = brute.grid(spark, [[0.0] * 3] * 3)
    out = fete(cells, points(spark, meta, [0, 1]), meta, JobOptions(neighbours=8, buffer=1))
    assert raster(out["density"]) == {0: 4, 1: 4, 2: 2, 3: 4, 4: 4, 5: 2, 6: 0, 7: 0, 8: 0}


def test_sources_in_several_passes_give_the_same_density(spark):
    rows = [[float((r * 7 + c * 3) % 5) for c in range(9)] for r in range(8)]
    cells, meta = brute.grid(spark, rows)
    pts = points(spark, meta, [0, 8, 13, 40, 40, 71, 66])
    one, many = (raster(fete(cells, pts, meta, JobOptions(tile_size=5, sources_per_pass=n))["density"]) for n in (100, 2))
    assert one == many and sum(one.values()) > 0


def test_passes_follow_the_curve(spark):
    cells, meta = brute.grid(spark, [[0.0] * 64] * 64)
    samples = cells.where("row % 2 = 0 AND col % 2 = 0").select("cell_id", F.lit(1).alias("m"))
    placed = source_passes(samples, meta, 16, Scratch(spark, "passes"))
    tile = F.floor(F.floor(F.col("cell_id") / 64) / 16) * 4 + F.floor(F.col("cell_id") % 64 / 16)
    rows = placed.groupBy("pass").agg(F.count("*").alias("n"), F.count_distinct(tile).alias("tiles")).collect()
    assert len(rows) == 16 and all((r.n, r.tiles) == (64, 1) for r in rows)


def test_points_outside(spark):
    cells, meta = brute.grid(spark, [[0.0] * 3] * 3)
    pts = points(spark, meta, [0, 8, 300])
    with pytest.raises(ValueError, match="some_outside"):
        fete(cells, pts, meta)
    out = fete(cells, pts, meta, JobOptions(on_outside="skip", neighbours=8))
    assert raster(out["density"])[4] == 2
    with pytest.raises(ValueError, match="no_points"):
        fete(cells, points(spark, meta, [300]), meta, JobOptions(on_outside="skip"))


def test_modifiers_add_outputs_and_wrong_rasters_are_refused_or_skipped(spark):
    cells, meta = brute.grid(spark, [[0.0] * 4] * 3)
    pts = points(spark, meta, [0, 3])
    good = cells.select("cell_id", F.lit(2.0).alias("v"))
    out = fete(cells, pts, meta, cost_raster=good, raster_meta=meta)
    base, total = raster(out["base_cost"], "value"), raster(out["total_cost"], "value")
    assert all(total[c] == pytest.approx(2 * base[c]) for c in base)
    assert set(raster(out["additional_cost"], "value").values()) == {2.0}
    bad = good.where("cell_id < 5")
    with pytest.raises(ValueError, match="missing_cells"):
        fete(cells, pts, meta, cost_raster=bad, raster_meta=meta)
    with pytest.raises(ValueError, match="other_dimensions"):
        fete(cells, pts, meta, cost_raster=good, raster_meta=GridMeta(4, 3, 0, 30, 10, -10, "local"))
    with pytest.raises(ValueError, match="raster_meta is missing"):
        fete(cells, pts, meta, cost_raster=good)
    assert "total_cost" not in fete(cells, pts, meta, JobOptions(on_mismatch="skip"), cost_raster=bad, raster_meta=meta)


def test_paths_to_many_destinations(spark):
    """Unreachable and outside destinations are skipped; numbers go to written paths only."""
    rows = [[0.0, 0.0, 0.0, None, 0.0], [0.0, 0.0, 0.0, None, 0.0]]
    cells, meta = brute.grid(spark, rows)
    dests = points(spark, meta, [0, 4, 2, 900, 2])
    out = lcpa(cells, points(spark, meta, [0]), dests, meta, JobOptions(neighbours=8, tile_size=2))
    reach = {r.dest_id: r.reachable for r in out["reachability"].collect()}
    assert reach == {0: True, 1: False, 2: True, 4: True}
    lines = {r.path_id: (r.dest_id, r.wkt) for r in out["path_lines"].collect()}
    assert lines == {0: (0, "LINESTRING (0.0 20.0)"), 1: (2, "LINESTRING (0.0 20.0, 10.0 20.0, 20.0 20.0)"),
                     2: (4, "LINESTRING (0.0 20.0, 10.0 20.0, 20.0 20.0)")}
    assert raster(out["path_raster"]) == {0: 3, 1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}
    summary = out["summary"].first()
    assert (summary.num_destinations, summary.total_path_cells) == (4, 7)
    assert summary.total_cost == pytest.approx(4 * brute.hours(10.0, 0.0))
    steps = sorted((r.path_id, r.step, r.cell_id) for r in out["paths"].collect())
    assert steps == [(0, 0, 0)] + [(p, i, i) for p in (1, 2) for i in range(3)]
    centred = lcpa(cells, points(spark, meta, [0]), dests, meta, JobOptions(neighbours=8), anchor="center")
    assert "LINESTRING (5.0 15.0)" in {r.wkt for r in centred["path_lines"].collect()}


def test_origin_and_destinations_are_checked(spark):
    cells, meta = brute.grid(spark, [[0.0] * 3])
    one, two, off = (points(spark, meta, c) for c in ([0], [0, 1], [77]))
    for origin, dests, status in ((two, one, "not_exactly_one"), (one, off, "none_on_grid"),
                                  (one, one.limit(0), "no_destinations"), (off, one, "no_points")):
        with pytest.raises(ValueError, match=status):
            lcpa(cells, origin, dests, meta)


def test_grid_checks(spark):
    cells, meta = brute.grid(spark, [[0.0] * 3] * 3)
    status = lambda df, m=meta: checks.check_dem(df, m).first().status
    assert status(cells) == "ok"
    assert status(cells.where("cell_id != 4")) == "missing_cells"
    assert status(cells.unionByName(cells)) == "repeated_cells"
    assert status(cells.withColumn("cell_id", F.col("cell_id") + 1)) == "cells_outside_grid"
    assert status(cells, GridMeta(3, 3, 0, 30, 10, -10, "")) == "no_crs"
    assert status(cells, GridMeta(3, 3, 0, 30, 0, 0, "local")) == "no_geotransform"
    none = cells.limit(0)
    assert checks.first_failure(checks.check_inputs(none, points(spark, meta, [0]), meta)).first().status == "missing_cells"
    assert checks.first_failure(checks.check_inputs(cells, points(spark, meta, [0]), meta)).first().ok
    edge = spark.createDataFrame([(1, 30.0, 0.0)], "point_id long, x double, y double")
    assert tuple(checks.points_bounds_report(edge, meta).first()) == (1, 0, 1, "ok")
    with pytest.raises(ValueError, match="rotated"):
        fete(cells, edge, GridMeta(3, 3, 0, 30, 10, -10, "local", rot_x=1.0))


def test_cells_are_stored_by_block_and_read_by_window(spark, tmp_path):
    cells, meta = brute.grid(spark, [[float(c) for c in range(40)] for _ in range(30)])
    path = str(tmp_path / "dem")
    blocks = C.BLOCK_SIDE
    C.BLOCK_SIDE = 16
    try:
        C.write_cells(cells.select("cell_id", "z"), path, meta)
        assert sorted(C.read_dem(spark, path, meta).collect()) == sorted(cells.collect())
        part = C.read_dem(spark, path, meta, nodata=3.0, window=(16, 20, 0, 15))
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(block_row" in plan
        rows = part.collect()
        assert len(rows) == 5 * 16 and {r.z for r in rows if r.col == 3} == {None}
        assert len(part.inputFiles()) < len(C.read_dem(spark, path, meta).inputFiles()) or len(rows) == 80
    finally:
        C.BLOCK_SIDE = blocks


def test_features_are_read_back(spark, tmp_path):
    cells, meta = brute.grid(spark, [[0.0] * 3])
    pts = points(spark, meta, [0, 2])
    pts.write.option("header", True).csv(str(tmp_path / "p"))
    assert sorted(V.read_points(spark, str(tmp_path / "p"), "csv").collect()) == sorted(pts.collect())
    lines = lcpa(cells, points(spark, meta, [0]), pts, meta)["path_lines"]
    V.write_path_lines(lines, str(tmp_path / "l"), "csv")
    back = spark.read.schema("path_id int, dest_id long, wkt string").csv(str(tmp_path / "l"))
    assert sorted(back.collect()) == sorted(lines.select("path_id", "dest_id", "wkt").collect())


def test_scratch_tables_go_to_the_shared_folder(spark):
    scratch = Scratch(spark, "x")
    assert scratch.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    table = scratch.save(spark.range(3), "t")
    assert table.count() == 3 and not table._jdf.queryExecution().logical().toString().startswith("Range")
    scratch.drop(table)
    assert not spark._jvm.java.io.File(table._wayfield_path).exists()


def test_many_sources_get_larger_tiles(spark, monkeypatch):
    """Where groups of sources keep all tasks busy, tiles grow and nothing is relaxed twice; the density stays the same."""
    from wayfield.operators.tile_kernels import Stencil
    from wayfield.plans import jobs
    wide = Stencil(GridMeta(1800, 500, 0.0, 54000.0, 30.0, -30.0, "local"), 16, 512)
    assert jobs._for_many(wide, 5400, 36).size == 2048 and jobs._for_many(wide, 200, 36).size == 512
    cells, meta = brute.grid(spark, [[float((r * 5 + c * 3) % 7) for c in range(12)] for r in range(12)])
    at = points(spark, meta, range(0, 144, 11))
    sizes = []
    pack = jobs.pack_tiles
    monkeypatch.setattr(jobs, "pack_tiles", lambda cells, stencil, *more: sizes.append(stencil.size) or pack(cells, stencil, *more))
    found = []
    for slots in (1000, 0):
        monkeypatch.setattr(jobs, "task_slots", lambda session, n=slots: n)
        made = jobs.point_density(cells, at, meta, JobOptions(tile_size=6)).groupBy("cell_id").agg(F.sum("value").alias("n"))
        found.append({r["cell_id"]: r["n"] for r in made.collect()})
    assert sizes == [6, 12] and found[0] == found[1] and len(found[0]) > 14


def test_cells_of_paths_are_not_stored(spark, monkeypatch):
    """Paths have a row for each tile in what is stored; rows for their cells are only given out."""
    cells, meta = brute.grid(spark, [[0.0] * 30 for _ in range(4)])
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *more: saved.append(set(df.columns)) or save(self, df, name, *more))
    found = lcpa(cells, points(spark, meta, [0]), points(spark, meta, [29, 29, 59]), meta, JobOptions(tile_size=8))["paths"].collect()
    assert not [columns for columns in saved if {"dest_cell", "step"} <= columns]
    steps = {n: sorted(r["step"] for r in found if r["path_id"] == n) for n in range(3)}
    assert steps[0] == steps[1] == list(range(len(steps[0]))) and len(steps[2]) > 1
