import random

import pytest

import brute
from wayfield.operators import checks, lines as L
from wayfield.schema import LINES, GridMeta
from wayfield.sources import features as V

META = GridMeta(12, 15, 0.0, 120.0, 10.0, -10.0, "local")


def centre(col, row, meta=META):
    return {"x": (col + 0.5) * meta.dx, "y": meta.y0 + (row + 0.5) * meta.dy}


def table(spark, lines):
    """Lines as (cost, parts) with vertices as (col, row)."""
    return spark.createDataFrame([
        {"line_id": i, "cost": cost, "parts": [[centre(*v) for v in part] for part in parts]}
        for i, (cost, parts) in enumerate(lines)], LINES)


def test_walk_of_a_shallow_line(spark):
    got = L.walk_segments(L.line_segments(table(spark, [(2.0, [[(0, 0), (4, 2)]])])), META).orderBy("step").collect()
    assert [(r.col, r.row) for r in got] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_walk_matches_step_by_step(spark):
    """All end points around a start, off the grid as well."""
    ends = [(c, r) for c in range(-9, 10) for r in range(-9, 10)]
    big = GridMeta(60, 60, 0.0, 600.0, 10.0, -10.0, "local")
    data = [{"line_id": i, "cost": 1.0, "parts": [[centre(20, 20, big), centre(20 + c, 20 + r, big)]]}
            for i, (c, r) in enumerate(ends)]
    rows = L.walk_segments(L.line_segments(spark.createDataFrame(data, LINES)), big).collect()
    got = {}
    for r in rows:
        got.setdefault(r.line_id, {})[r.step] = (r.col, r.row)
    for i, (c, r) in enumerate(ends):
        assert [got[i][s] for s in sorted(got[i])] == brute.walk(20, 20, 20 + c, 20 + r)


@pytest.mark.parametrize("b, combine", [(0, "max_with_1"), (2, "max_with_1"), (1, "max")])
def test_rasterised_lines_match_brute_force(spark, b, combine):
    rnd = random.Random(b)
    vertex = lambda: (rnd.randrange(-8, 23), rnd.randrange(-8, 20))
    lines = [(rnd.choice([-1.0, 0.4, 1.5, 3.0]), [[vertex() for _ in range(rnd.randrange(1, 4))] for _ in range(2)])
             for _ in range(12)]
    want = {}
    for cost, parts in lines:
        for part in parts:
            for (c1, r1), (c2, r2) in zip(part, part[1:]):
                for c, r in brute.walk(c1, r1, c2, r2):
                    for rr in range(r - b, r + b + 1):
                        for cc in range(c - b, c + b + 1):
                            if 0 <= rr < META.nrows and 0 <= cc < META.ncols:
                                cell = rr * META.ncols + cc
                                want[cell] = max(want.get(cell, 0.0), cost if cost > 0 else 1.0)
    if combine == "max_with_1":
        want = {cell: max(m, 1.0) for cell, m in want.items()}
    got = {r.cell_id: r.m for r in L.rasterize_lines(table(spark, lines), META, b, combine).collect()}
    assert got == want


def test_a_very_long_line_makes_steps_on_the_grid_only(spark):
    lines = table(spark, [(2.0, [[(-3_000_000_000, 5), (3_000_000_000, 5)]])])
    got = L.rasterize_lines(lines, META, 1).collect()
    assert {r.cell_id // META.ncols for r in got} == {4, 5, 6} and len(got) == 3 * META.ncols


def test_coverage_counts_segment_ends(spark):
    lines = table(spark, [(1.0, [[(0, 0), (3, 3), (99, 3)]]), (1.0, [[(99, 0), (98, 3)]]), (1.0, [[(1, 1)]])])
    got = L.line_coverage(lines, META).first()
    assert (got.features, got.features_inside, got.vertices, got.vertices_inside) == (3, 1, 6, 3)


def test_cost_column_is_required(spark):
    assert "cost" in checks.check_line_schema(table(spark, [(1.0, [[(0, 0), (1, 1)]])]))
    with pytest.raises(ValueError, match="width"):
        checks.check_line_schema(spark.createDataFrame([(1, 2.0)], "line_id long, width double"))


def test_text_round_trip_and_other_geometries(spark):
    lines = table(spark, [(0.5, [[(0, 0), (1, 1)]]), (2.0, [[(0, 0), (1, 1)], [(2, 2), (3, 1), (4, 4)]])])
    text = V.lines_to_wkt(lines)
    assert sorted(r.wkt.split(" ")[0] for r in text.collect()) == ["LINESTRING", "MULTILINESTRING"]
    other = spark.createDataFrame([(9, 1.0, "POINT (1 2)"), (10, 1.0, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], text.schema)
    back = V.lines_from_wkt(text.unionByName(other))
    assert sorted(back.collect(), key=str) == sorted(lines.collect(), key=str)
    points = spark.createDataFrame([(1, "POINT (1.5 -2e1)"), (2, "point z (3 4 5)"), (3, "LINESTRING (0 0, 1 1)")],
                                   "point_id long, wkt string")
    got = V.points_from_wkt(points).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.y) for r in got] == [(1, 1.5, -20.0), (2, 3.0, 4.0)]
