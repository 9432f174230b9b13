import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from wayfield.operators import distance as D, frontier, neighbours as N, tile_kernels as K, tracing
from wayfield.operators.tile_kernels import Frame, Stencil, relax
from wayfield.plans.jobs import lcpa
from wayfield.schema import GridMeta, JobOptions
from wayfield.sources.scratch import Scratch


def terrain(seed, nrows=19, ncols=27, holes=0.05):
    rnd = random.Random(seed)
    return [[None if rnd.random() < holes else rnd.uniform(0, 6) for _ in range(ncols)] for _ in range(nrows)]


def ids(spark, cells):
    return spark.createDataFrame([(c,) for c in cells], "cell_id long")


def weights(spark, counts):
    return spark.createDataFrame(list(counts.items()), "cell_id long, m long")


def setup(spark, seed, k=16, cap="speed", with_mult=True, n=5):
    rows = terrain(seed)
    cells, meta = brute.grid(spark, rows)
    rnd = random.Random(seed + 1)
    mult = {i: rnd.choice([0.25, 2.0, 7.0]) for i in range(0, meta.n_cells, 4)} if with_mult else None
    graph = brute.edges(rows, meta, k, mult, cap)
    known = [i for i in range(meta.n_cells) if rows[i // meta.ncols][i % meta.ncols] is not None]
    sources = rnd.sample(known, n)
    table = spark.createDataFrame(list(mult.items()), "cell_id long, m double") if mult else None
    return cells, meta, table, graph, sources


def as_dict(df, *key, value):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}


@pytest.mark.parametrize("k, size, cap, settle, lap", [
    (8, 8, "speed", 1, 0), (16, 6, "exponent", 2, 4), (32, 9, "speed", 100, 2), (64, 100, "exponent", 1, 9)])
def test_distances_and_predecessors_match_brute_force(spark, k, size, cap, settle, lap, monkeypatch):
    """Overlapping or not, with finished tiles leaving the loop after every round, sometimes or never."""
    monkeypatch.setattr(D, "SETTLE_EVERY", settle)
    cells, meta, mult, graph, sources = setup(spark, k, k, cap)
    solved = D.cost_trees(cells, ids(spark, sources), Stencil(meta, k, size, cap, lap=lap), mult, keep_cells=True)
    got = as_dict(D.distances(solved), "source", "cell_id", value="d")
    pred = as_dict(D.tree_predecessors(solved), "source", "cell_id", value="pred")
    for s in sources:
        best = brute.distances(graph, s)
        mine = {c: d for (o, c), d in got.items() if o == s}
        assert mine.keys() == best.keys() and all(mine[c] == pytest.approx(best[c], abs=1e-9) for c in best)
        assert {c: p for (o, c), p in pred.items() if o == s} == brute.predecessors(graph, best)


def test_relaxation_by_joins_agrees(spark):
    cells, meta, mult, graph, sources = setup(spark, 3, n=2)
    edge_table = N.edges(cells, 16, meta, mult)
    dist = frontier.frontier_distance(edge_table, ids(spark, sources))
    got = as_dict(dist, "source", "cell_id", value="d")
    want = {(s, c): d for s in sources for c, d in brute.distances(graph, s).items()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    pred = as_dict(frontier.predecessors(dist, edge_table), "source", "cell_id", value="pred")
    assert pred == {(s, c): p for s in sources for c, p in brute.predecessors(graph, brute.distances(graph, s)).items()}


def test_no_edge_improves_a_distance(spark):
    cells, meta, mult, _, sources = setup(spark, 5, n=2)
    dist = D.cost_distance(cells, ids(spark, sources), Stencil(meta, 16, 7), mult)
    edge_table = N.edges(cells, 16, meta, mult)
    there = dist.select("source", F.col("cell_id").alias("dst"), F.col("d").alias("d_to"))
    slack = dist.join(edge_table, dist["cell_id"] == edge_table["src"]).join(there, ["source", "dst"], "left")
    assert slack.where("d_to is null or d + w < d_to - 1e-12").count() == 0


@pytest.mark.parametrize("size", [5, 64])
def test_bounded_search_changes_nothing_at_targets(spark, size, monkeypatch):
    """Near targets end the search early; an unreachable target does not lose the others."""
    monkeypatch.setattr(D, "SETTLE_EVERY", 2)
    cells, meta, mult, graph, sources = setup(spark, 7, n=2)
    best = {s: brute.distances(graph, s) for s in sources}
    near = sorted(best[sources[0]], key=best[sources[0]].get)[3:9]
    stencil = Stencil(meta, 16, size, lap=1)
    solved = D.cost_trees(cells, ids(spark, sources), stencil, mult, ids(spark, near), bounded=True, with_goals=True)
    got = as_dict(D.target_costs(solved), "source", "cell_id", value="d")
    assert got.keys() == {(s, t) for s in sources for t in near}
    assert all(got[s, t] == pytest.approx(best[s][t]) for s, t in got)
    hole = next(c for c in range(meta.n_cells) if c not in best[sources[0]])
    solved = D.cost_trees(cells, ids(spark, sources), stencil, mult, ids(spark, near + [hole]), bounded=True, with_goals=True)
    assert as_dict(D.target_costs(solved), "source", "cell_id", value="d") == got
    edge_table = N.edges(cells, 16, meta, mult)
    bounded = as_dict(frontier.frontier_distance(edge_table, ids(spark, sources[:1]), ids(spark, near)),
                      "source", "cell_id", value="d")
    assert len(bounded) < len(best[sources[0]]) and all(bounded[sources[0], t] == pytest.approx(best[sources[0]][t]) for t in near)


def test_bounded_search_leaves_far_tiles_alone(spark):
    cells, meta = brute.grid(spark, [[0.0] * 60 for _ in range(12)])
    solved = D.cost_trees(cells, ids(spark, [0]), Stencil(meta, 8, 6), targets=ids(spark, [3, 7]), bounded=True)
    assert solved.trees.select("tile").distinct().count() <= 6 and solved.rounds <= 4
    full = D.cost_trees(cells, ids(spark, [0]), Stencil(meta, 8, 6), targets=ids(spark, [3, 7]))
    assert full.trees.select("tile").distinct().count() == 20


@pytest.mark.parametrize("size", [6, 100])
def test_path_counts_and_density_match_traced_paths(spark, size):
    cells, meta, mult, graph, sources = setup(spark, 11, cap="exponent")
    m = {s: i % 3 + 1 for i, s in enumerate(sources)}
    table = Scratch(spark, "t").save(weights(spark, m), "m")
    solved = D.cost_trees(cells, table, Stencil(meta, 16, size, "exponent", lap=3), mult, table, bounded=True)
    want = {}
    for s in sources:
        pred = brute.predecessors(graph, brute.distances(graph, s))
        for t in sources:
            if t != s:
                for cell in brute.path(pred, s, t):
                    want[s, cell] = want.get((s, cell), 0) + m[t]
    counts = tracing.path_counts(solved)
    assert as_dict(counts, "source", "cell_id", value="n") == want
    dense = {}
    for (s, cell), n in want.items():
        dense[cell] = dense.get(cell, 0) + n * m[s]
    weighted = as_dict(tracing.density(counts, table), "cell_id", value="value")
    in_tasks = tracing.density(tracing.path_counts(solved, table, per_source=False))
    assert weighted == as_dict(in_tasks, "cell_id", value="value") == {(c,): n for c, n in dense.items()}
    at_sources = {s: n for (s, cell), n in want.items() if s == cell}
    assert at_sources == {s: sum(m.values()) - m[s] for s in sources}


@pytest.mark.parametrize("size, pieces", [(6, 2), (100, 4096)])
def test_traced_paths(spark, size, pieces, monkeypatch):
    """Cells in order, costs adding up, also when the pieces of a tile are split by a salt."""
    monkeypatch.setattr(tracing, "PIECES_PER_GROUP", pieces)
    cells, meta, mult, graph, sources = setup(spark, 13, n=9)
    origin, dests = sources[0], sources
    solved = D.cost_trees(cells, ids(spark, [origin]), Stencil(meta, 16, size, lap=2), mult, ids(spark, dests), with_goals=True)
    steps = {}
    for r in tracing.trace_paths(solved, ids(spark, dests)).collect():
        steps.setdefault(r.dest_cell, {})[r.step] = r.cell_id
    pred = brute.predecessors(graph, brute.distances(graph, origin))
    costs = as_dict(D.target_costs(solved), "cell_id", value="d")
    for dest in dests:
        path = [steps[dest][i] for i in range(len(steps[dest]))]
        assert path == brute.path(pred, origin, dest)
        assert sum(dict(graph[a])[b] for a, b in zip(path, path[1:])) == pytest.approx(costs[dest,])


@pytest.mark.parametrize("size, pieces, every", [(6, 2, 3), (6, 4096, 1), (100, 3, 4), (9, 4096, 128)])
def test_lines_put_together_at_marks(spark, size, pieces, every, monkeypatch):
    """The same vertices and text as from the traced cells: with marks and without, in many tiles and one, for two numbers of one cell."""
    monkeypatch.setattr(tracing, "PIECES_PER_GROUP", pieces)
    monkeypatch.setattr(tracing, "MARK_STEPS", every)
    cells, meta, mult, graph, sources = setup(spark, 13)
    origin, dests = sources[0], sorted(brute.distances(graph, sources[0]))[::3] + [sources[0]]
    solved = D.cost_trees(cells, ids(spark, [origin]), Stencil(meta, 16, size, lap=2), mult, ids(spark, dests), with_goals=True)
    numbered = spark.createDataFrame([(i, 100 + i, c) for i, c in enumerate([*dests, dests[0]])], "path_id long, dest_id long, cell_id long")
    pred = brute.predecessors(graph, brute.distances(graph, origin))
    lines = {r.path_id: r for r in tracing.path_lines(solved, numbered).collect()}
    assert len(lines) == len(dests) + 1
    for i, dest in enumerate([*dests, dests[0]]):
        want = [(step, c % meta.ncols * meta.dx, meta.y0 + c // meta.ncols * meta.dy) for step, c in enumerate(brute.path(pred, origin, dest))]
        assert (lines[i].dest_id, lines[i].dest_cell, [tuple(p) for p in lines[i].pts]) == (100 + i, dest, want)
        assert lines[i].wkt == "LINESTRING (" + ", ".join(f"{x} {y}" for _, x, y in want) + ")"


def test_lines_take_no_row_for_each_vertex(spark, monkeypatch):
    """On a long grid the tables behind the lines hold a fraction of the vertices that the lines have."""
    monkeypatch.setattr(tracing, "MARK_STEPS", 16)
    held, save = {}, Scratch.save

    def watch(self, df, name, *args):
        table = save(self, df, name, *args)
        content = F.sum(F.size("cells")) if "cells" in df.columns else F.count("*")
        held[name] = held.get(name, 0) + (table.agg(content).first()[0] or 0)
        return table

    monkeypatch.setattr(Scratch, "save", watch)
    cells, meta = brute.grid(spark, [[float((r * 5 + c * 3) % 7) for c in range(3)] for r in range(400)])
    at = lambda c: (c, (c % 3 + 0.5) * meta.dx, meta.y0 + (c // 3 + 0.5) * meta.dy)
    points = lambda some: spark.createDataFrame([at(c) for c in some], "point_id long, x double, y double")
    lines = lcpa(cells, points([1]), points(range(1200)), meta, JobOptions(tile_size=16))["path_lines"]
    vertices = lines.agg(F.sum(F.size("pts"))).first()[0]
    assert vertices > 100_000 and max(held.values()) < vertices / 8


def test_finished_tiles_leave_the_loop(spark, monkeypatch):
    """Behind the front of a long flat grid the ring shrinks to one row per (source, tile)."""
    sizes = []
    settle = D._settle

    def watch(ring, blocks, stencil):
        out = settle(ring, blocks, stencil)
        sizes.append((ring.count(), out.where("settled and cell_id >= 0").count()))
        return out

    monkeypatch.setattr(D, "SETTLE_EVERY", 2)
    monkeypatch.setattr(D, "_settle", watch)
    cells, meta = brute.grid(spark, [[0.0] * 48 for _ in range(6)])
    got = as_dict(D.cost_distance(cells, ids(spark, [0]), Stencil(meta, 8, 6)), "cell_id", value="d")
    best = brute.distances(brute.edges([[0.0] * 48 for _ in range(6)], meta, 8), 0)
    assert got.keys() == {(c,) for c in best} and all(got[c,] == pytest.approx(best[c]) for c in best)
    assert len(sizes) >= 3 and sum(left for _, left in sizes) > 0 and max(n for n, _ in sizes) < 60


def test_many_sources_form_many_groups(spark, monkeypatch):
    monkeypatch.setattr(D, "SOURCES_PER_GROUP", 4)
    cells, meta, mult, graph, sources = setup(spark, 17, n=15)
    solved = D.cost_trees(cells, ids(spark, sources), Stencil(meta, 16, 10), mult, ids(spark, sources), with_goals=True)
    sizes = [r["count"] for r in solved.trees.select("source", "bucket").distinct().groupBy("bucket").count().collect()]
    assert sorted(sizes) == [3, 4, 4, 4]
    got = as_dict(D.target_costs(solved), "source", "cell_id", value="d")
    want = {(s, t): d for s in sources for t, d in brute.distances(graph, s).items() if t in sources}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_walls_multipliers_and_symmetry(spark):
    """A dear column is crossed by ring moves and jumped by knight moves; scaling scales costs."""
    cells, meta = brute.grid(spark, [[0.0] * 5 for _ in range(5)])
    wall = lambda width: spark.createDataFrame(
        [(r * 5 + c, 10.0) for r in range(5) for c in range(2 - width, 3 + width)], "cell_id long, m double")
    cost = lambda k, mult: as_dict(D.cost_distance(cells, ids(spark, [10]), Stencil(meta, k), mult), "cell_id", value="d")
    assert cost(8, wall(0))[14,] > 2 * cost(8, None)[14,]
    assert cost(16, wall(0))[14,] < 1.5 * cost(16, None)[14,]
    assert cost(16, wall(1))[14,] > 2 * cost(16, None)[14,]
    double = cells.select("cell_id", F.lit(2.0).alias("m"))
    one, two = cost(16, cells.select("cell_id", F.lit(1.0).alias("m"))), cost(16, double)
    none = cost(16, None)
    assert one.keys() == none.keys() and all(one[c] == pytest.approx(none[c]) and two[c] == pytest.approx(2 * one[c]) for c in one)
    pairs = as_dict(D.pairwise_cost(cells, ids(spark, [1, 23]), Stencil(meta, 16)), "source", "cell_id", value="d")
    assert pairs[1, 23] == pytest.approx(pairs[23, 1])


def test_source_without_elevation_reaches_itself_only(spark):
    cells, meta = brute.grid(spark, [[None, 1.0, 2.0, 3.0]])
    got = as_dict(D.cost_distance(cells, ids(spark, [0]), Stencil(meta, 8, 1)), "cell_id", value="d")
    assert got == {(0,): 0.0}


def test_summary_of_an_empty_density(spark):
    cells, meta = brute.grid(spark, [[0.0, 1.0]])
    empty = cells.select("cell_id", F.lit(0).cast("long").alias("n"))
    row = tracing.density_summary(empty, meta).first()
    assert tuple(row) == (0, 0, 0, 0, 2)


def test_counts_between_tiles_are_bounded_by_the_borders(spark):
    """No row for a pair of points: what leaves a tile is at most a row for each source and cell around its area."""
    cells, meta = brute.grid(spark, [[float((r * 5 + c * 3) % 7) for c in range(16)] for r in range(16)])
    points = weights(spark, {i: 1 for i in range(0, 256, 3)})
    stencil = Stencil(meta, 16, 8)
    solved = D.cost_trees(cells, points, stencil, targets=points, bounded=True)
    around = sum((f.height + 2 * f.reach) * (f.width + 2 * f.reach) - f.height * f.width for f in (Frame(t, stencil) for t in range(4)))
    rows = solved.trees.agg(F.sum(F.size("leave_cell")).alias("leave"), F.sum(F.size("goal_cell")).alias("goals")).first()
    assert rows["goals"] == 0 and rows["leave"] < 86 * around / 2 < 86 * 85 * 2
    assert tracing.path_counts(solved).agg(F.sum("n")).first()[0] > 86 * 85
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wayfield_hops")]


def test_sources_far_apart_in_cost_do_not_wait_for_each_other():
    stencil = Stencil(GridMeta(40, 40, 0.0, 400.0, 10.0, -10.0, "local"), 16, 64)
    frame = Frame(0, stencil)
    z = np.full(frame.length, np.nan)
    z[frame.area] = np.random.default_rng(1).uniform(0, 3, len(frame.area))
    w = frame.weights(z, None)

    def rounds(bases):
        d = np.full((len(bases), frame.length), np.inf)
        for i, base in enumerate(bases):
            d[i, frame.area[i * 37]] = base
        return relax(d, w, frame.steps)

    assert rounds([5.0 * i for i in range(16)]) <= 2 * max(rounds([0.0]), rounds([0.0] * 16))


@pytest.mark.parametrize("task, most, side, rounds", [(1 << 18, 1 << 20, 128, 0), (96, 160, 16, 12)])
def test_long_grids_get_larger_tiles(spark, monkeypatch, task, most, side, rounds):
    """Rounds follow the tiles along a grid, so they are not as many as a long grid has squares of the least side."""
    monkeypatch.setattr(K, "TASK_CELLS", task)
    monkeypatch.setattr(K, "TILE_CELLS", most)
    heights = [[float((r * 5 + c * 3) % 7) for c in range(5)] for r in range(120)]
    cells, meta = brute.grid(spark, heights)
    stencil = Stencil(meta, 16, 4)
    assert stencil.size == side and Stencil(meta, 16, side).size == side and Stencil(meta, 16, 8).size == 8
    solved = D.cost_trees(cells, ids(spark, [2, 301]), stencil, targets=ids(spark, [0, 304, 599]), keep_cells=True, with_goals=True)
    assert solved.rounds <= rounds
    graph = brute.edges(heights, meta, 16)
    want = {(s, c): d for s in (2, 301) for c, d in brute.distances(graph, s).items()}
    got = as_dict(D.distances(solved), "source", "cell_id", value="d")
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    counts = as_dict(tracing.path_counts(solved), "source", "cell_id", value="n")
    traced = tracing.trace_paths(solved, ids(spark, [0, 304, 599])).groupBy("source", "cell_id").count()
    assert counts == as_dict(traced, "source", "cell_id", value="count") and counts[2, 599] == 1


def test_groups_of_sources_are_smaller_on_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP_CELLS", 300)
    cells, meta = brute.grid(spark, [[0.0] * 10 for _ in range(10)])
    grouped = D.group_sources(ids(spark, range(9)), Stencil(meta, 8, 10), Scratch(spark, "groups"))
    assert sorted(r["count"] for r in grouped.groupBy("bucket").count().collect()) == [3, 3, 3]


def test_traced_paths_are_not_joined_by_broadcast(spark):
    """Nodes and pieces of paths take little room in files and much in the driver."""
    cells, meta = brute.grid(spark, [[0.0] * 8 for _ in range(8)])
    solved = D.cost_trees(cells, ids(spark, [0]), Stencil(meta, 8, 4), targets=ids(spark, [7, 63]), with_goals=True)
    plan = tracing.trace_paths(solved, ids(spark, [7, 63]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
