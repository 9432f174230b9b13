"""Cells stored by tile: the same results without an exchange."""

import random
from dataclasses import replace

import brute
import pytest
from pyspark.sql import functions as F

from wayfield.operators import distance as D, neighbours as N, terrain as R
from wayfield.operators.tile_kernels import Stencil
from wayfield.sources.tile_store import bucket_count, read_tiles, write_tiles

SIZE, REACH = 8, 4


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows = [[None if rnd.random() < 0.05 else rnd.randrange(60) for _ in range(21)] for _ in range(19)]
    cells, meta = brute.grid(spark, rows)
    path = str(tmp_path_factory.mktemp("tiles") / "grid")
    write_tiles(cells, path, meta, SIZE, REACH)
    return cells, meta, read_tiles(spark, path, meta)


def rows_of(df):
    return sorted(tuple(-1.0 if v is None else v for v in r) for r in df.collect())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_stencils_equal_and_do_not_shuffle(stored):
    cells, meta, tiles = stored
    for make in (lambda c: R.slope(c, meta), lambda c: R.base_cost(c, 16, meta), lambda c: N.edges(c, 32, meta)):
        plain, kept = make(cells), make(tiles)
        assert exchanges(plain) and not exchanges(kept)
        for a, b in zip(rows_of(plain), rows_of(kept), strict=True):
            assert a == pytest.approx(b, rel=1e-12)


def test_packed_tiles_equal_and_do_not_shuffle_cells(stored):
    cells, meta, tiles = stored
    stencil = Stencil(meta, 16, SIZE, "speed")
    assert stencil.overlap + stencil.reach <= REACH
    packed = D.pack_tiles(tiles, stencil)
    assert not exchanges(packed)
    assert rows_of(packed.drop("m")) == rows_of(D.pack_tiles(cells, stencil).drop("m"))
    goals = cells.where("cell_id % 17 = 0").select("cell_id")
    mult = cells.select("cell_id", (F.col("cell_id") % 3 + 1).cast("double").alias("m"))
    both = D.pack_tiles(tiles, stencil, mult, goals)
    assert rows_of(both) == rows_of(D.pack_tiles(cells, stencil, mult, goals))
    source = cells.where("cell_id = 5").select("cell_id")
    found = D.cost_distance(tiles, source, stencil, mult)
    assert rows_of(found) == rows_of(D.cost_distance(cells, source, stencil, mult))


def test_stored_multipliers(spark, stored, tmp_path):
    cells, meta, _ = stored
    mult = cells.select("cell_id", (F.col("cell_id") % 3 + 1).cast("double").alias("m"))
    tiles = write_tiles(N.with_multipliers(cells, mult), str(tmp_path / "with_m"), meta, SIZE, REACH)
    kept = N.edges(tiles, 8, meta)
    assert not exchanges(kept)
    stencil = Stencil(meta, 8, SIZE, "speed")
    assert rows_of(D.pack_tiles(tiles, stencil)) == rows_of(D.pack_tiles(cells, stencil, mult))
    for a, b in zip(rows_of(N.edges(cells, 8, meta, mult)), rows_of(kept), strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_what_is_not_stored_is_refused(spark, stored, tmp_path):
    cells, meta, tiles = stored
    with pytest.raises(ValueError, match="within 1"):
        R.base_cost(replace(tiles, reach=1), 16, meta)
    with pytest.raises(ValueError, match="side of 8"):
        D.pack_tiles(tiles, Stencil(meta, 16, 16, "speed"))
    empty = str(tmp_path / "none")
    write_tiles(cells.limit(0), empty, meta, SIZE, 1)
    with pytest.raises(ValueError, match="no tiles"):
        read_tiles(spark, empty, meta)


def test_buckets_follow_the_grid():
    meta = brute.GridMeta(100_000, 100_000, 0, 0, 1, -1)
    assert bucket_count(meta, 512, 200) == 2385 and bucket_count(replace(meta, nrows=600, ncols=600), 512, 200) == 4
