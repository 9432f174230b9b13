"""Searches and jobs that lost their driver go on after their last finished step."""

import brute
import pytest
from pyspark.sql import functions as F

from wayfield.operators import distance as D
from wayfield.operators.tile_kernels import Stencil
from wayfield.plans import jobs
from wayfield.schema import JobOptions
from wayfield.sources.journal import Journal


@pytest.fixture(scope="module")
def narrow(spark):
    return brute.grid(spark, [[(r * 5 + c * 3) % 11 for c in range(40)] for r in range(8)])


def counted(monkeypatch, module, name, fail_at=None):
    """Count calls of a function; the ``fail_at``-th one fails."""
    calls, plain = [], getattr(module, name)

    def wrapper(*args, **kw):
        calls.append(name)
        if len(calls) == fail_at:
            raise ConnectionError("driver lost")
        return plain(*args, **kw)

    monkeypatch.setattr(module, name, wrapper)
    return calls


@pytest.mark.parametrize("settle", [2, 8])
def test_search_goes_on_after_its_last_round(spark, narrow, monkeypatch, tmp_path, settle):
    cells, meta = narrow
    monkeypatch.setattr(D, "SETTLE_EVERY", settle)
    stencil, source = Stencil(meta, 8, 8, "speed"), cells.where("cell_id in (0, 45)").select("cell_id")
    plain = D.cost_trees(cells, source, stencil, keep_cells=True)
    expected = {(r.source, r.cell_id): r.d for r in D.distances(plain).collect()}
    assert plain.rounds > 3

    with monkeypatch.context() as lost:
        counted(lost, D, "_merge", fail_at=4)
        with pytest.raises(ConnectionError):
            D.cost_trees(cells, source, stencil, keep_cells=True, resume=str(tmp_path))
    packed = counted(monkeypatch, D, "pack_tiles")
    rounds = counted(monkeypatch, D, "_merge")
    again = D.cost_trees(cells, source, stencil, keep_cells=True, resume=str(tmp_path))
    assert again.rounds == plain.rounds and len(rounds) == plain.rounds - 3 and not packed
    assert {(r.source, r.cell_id): r.d for r in D.distances(again).collect()} == expected

    rounds.clear()
    found = D.cost_trees(cells, source, stencil, keep_cells=True, resume=str(tmp_path))
    assert not rounds and D.distances(found).count() == len(expected)
    with pytest.raises(ValueError, match="another job"):
        D.cost_trees(cells, source, Stencil(meta, 16, 8, "speed"), keep_cells=True, resume=str(tmp_path))


def test_density_repeats_no_finished_pass(spark, narrow, monkeypatch, tmp_path):
    cells, meta = narrow
    points = spark.createDataFrame([(i, 5.0 + 40 * i, 5.0 + 10 * (i % 8)) for i in range(9)], "point_id long, x double, y double")
    options = JobOptions(neighbours=8, tile_size=16, sources_per_pass=3)
    expected = {tuple(r) for r in jobs.point_density(cells, points, meta, options).collect()}
    kept = JobOptions(neighbours=8, tile_size=16, sources_per_pass=3, resume=str(tmp_path / "kept"))
    with monkeypatch.context() as lost:
        counted(lost, jobs, "path_counts", fail_at=2)
        with pytest.raises(ConnectionError):
            jobs.point_density(cells, points, meta, kept)
    passes, rounds = counted(monkeypatch, jobs, "path_counts"), counted(monkeypatch, D, "_merge")
    found = jobs.point_density(cells, points, meta, kept)
    assert {tuple(r) for r in found.collect()} == expected
    # The second pass had its trees already; only the third one is searched.
    assert len(passes) == 2 and 0 < len(rounds)
    folders = {p.name for p in (tmp_path / "kept" / "density").iterdir()}
    assert not {f for f in folders if f.startswith("pass-")}


def test_unfinished_steps_are_not_read(spark, tmp_path):
    first = Journal(spark, str(tmp_path), "a")
    assert first.state is None
    table = spark.range(3)
    table.write.parquet(str(tmp_path / "t"))
    table._wayfield_path = str(tmp_path / "t")
    first.record(done=[table], n=1)
    again = Journal(spark, str(tmp_path), "a")
    assert again.state["n"] == 1 and again.table(again.state["done"][0]).agg(F.sum("id")).first()[0] == 3
    again.record(n=2)
    assert Journal(spark, str(tmp_path), "a").state == {"n": 2}
    with pytest.raises(ValueError, match="another job"):
        Journal(spark, str(tmp_path), "b")
