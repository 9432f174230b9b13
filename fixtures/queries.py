"""Every operator as a query over the given tables, next to the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import tables
from fixtures.oracle import boxed, sql, walk_cost
from wayfield.functions.costs import tobler
from wayfield.functions.geo import cell_col, cell_id, cell_row, cell_to_world
from wayfield.functions.offsets import NEIGHBOUR_OPTIONS
from wayfield.operators import checks, lines as L, neighbours as N, points as P, terrain as R
from wayfield.operators import distance as D, frontier, overlay
from wayfield.operators.tile_kernels import Stencil
from wayfield.operators.tiles import configure
from wayfield.plans.jobs import fete, lcpa, point_density, point_path_counts
from wayfield.schema import JobOptions
from wayfield.sources import cells as C, features as V
from wayfield.sources.scratch import Scratch
from wayfield.sources.tile_store import read_tiles, write_tiles

# Tiles small enough that the grids of the test data have many of them and halos are exchanged (timings are taken with the default).
TILE = 16
SMALL_TILE = 32


class Inputs:
    """The derived inputs of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    @cached_property
    def meta(self):
        return tables.grid_meta(self.spark, self.sf_dir)

    @property
    def cells(self):
        return tables.dem_cells(self.spark, self.sf_dir)

    @property
    def holes(self):
        """The terrain with every thirteenth cell or so without elevation."""
        return self.cells.withColumn("z", F.when(F.col("cell_id") % 13 != 5, F.col("z")))

    @property
    def raster(self):
        return tables.cost_raster(self.spark, self.sf_dir)

    @property
    def points(self):
        return tables.points(self.spark, self.sf_dir, self.meta)

    @property
    def samples(self):
        return P.sample_cells(self.points, self.meta)

    @property
    def dest_points(self):
        return tables.destinations(self.spark, self.sf_dir, self.meta)

    @property
    def dests(self):
        return checks.usable_destinations(self.dest_points, self.meta)

    @property
    def origin(self):
        return tables.origin(self.spark, self.sf_dir, self.meta)

    @property
    def lines(self):
        return tables.lines(self.spark, self.sf_dir, self.meta)

    @property
    def line_mult(self):
        return L.rasterize_lines(self.lines, self.meta, 2)

    @property
    def mult(self):
        return R.combine_multipliers(self.cells, self.line_mult, self.raster)

    def stencil(self, cap: str = "speed", tile: int | None = None) -> Stencil:
        return Stencil(self.meta, 16, tile or TILE, cap)

    def options(self, **kw) -> JobOptions:
        return JobOptions(tile_size=kw.pop("tile_size", TILE), on_outside="skip", **kw)

    def lcpa(self, **kw) -> dict[str, DataFrame]:
        modified = kw.pop("modified", False)
        extra = {"lines": self.lines, "cost_raster": self.raster, "raster_meta": self.meta} if modified else {}
        extra["tiles"] = kw.pop("tiles", None)
        return lcpa(self.cells, self.origin, self.dest_points, self.meta, self.options(**kw), **extra)

    def tiles(self, size: int, reach: int):
        """The terrain written by tile and read back."""
        path = self.scratch("tiles")
        write_tiles(self.cells, path, self.meta, size, reach)
        return read_tiles(self.spark, path, self.meta)

    def scratch(self, label: str) -> str:
        return Scratch(self.spark, label).path

    @property
    def wide(self) -> "Wide":
        return Wide(self.spark, self.sf_dir)


class Wide(Inputs):
    """The wide terrain with its own points; its queries use the default tile."""

    @cached_property
    def meta(self):
        return tables.wide_meta(self.spark, self.sf_dir)

    @property
    def cells(self):
        return tables.wide_cells(self.spark, self.sf_dir)

    def options(self, **kw) -> JobOptions:
        return JobOptions(on_outside="skip", **kw)


def _r(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn
    return add


# ---- sources and sinks -------------------------------------------------------------------------

@query("dem_stored", "select cell_id, cast(r as integer) as row, cast(c as integer) as col, "
                     "case when z = 14.0::double then null else round(z, 6) end as z from cells")
def _(q):
    path = q.scratch("dem")
    C.write_cells(q.cells.select("cell_id", "z"), path, q.meta)
    return C.read_dem(q.spark, path, q.meta, nodata=14.0).select("cell_id", "row", "col", _r("z"))


@query("dem_window", "select cell_id, cast(r as integer) as row, cast(c as integer) as col, round(z, 6) as z "
                     "from cells, g where r between nrows // 2 and nrows - 1 and c between 10 and 29")
def _(q):
    path = q.scratch("dem")
    C.write_cells(q.cells.select("cell_id", "z"), path, q.meta)
    window = (q.meta.nrows // 2, q.meta.nrows - 1, 10, 29)
    return C.read_dem(q.spark, path, q.meta, window=window).select("cell_id", "row", "col", _r("z"))


@query("dem_window_plain", "select cell_id, cast(r as integer) as row, cast(c as integer) as col, round(z, 6) as z "
                           "from cells, g where r between nrows // 2 and nrows - 1 and c between 10 and 29")
def _(q):
    path = q.scratch("dem")
    q.cells.select("cell_id", "z").write.parquet(path)
    window = (q.meta.nrows // 2, q.meta.nrows - 1, 10, 29)
    return C.read_dem(q.spark, path, q.meta, window=window).select("cell_id", "row", "col", _r("z"))


@query("points_stored", "select point_id, x, y from pts")
def _(q):
    path = q.scratch("points")
    q.points.write.option("header", True).csv(path)
    return V.read_points(q.spark, path, "csv")


@query("points_wkt", "select point_id, x, y from dest_pts")
def _(q):
    path = q.scratch("points")
    text = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    shapes = q.dest_points.select("point_id", text.alias("wkt")).unionByName(
        V.lines_to_wkt(q.lines).select(F.col("line_id").alias("point_id"), "wkt"))
    shapes.write.json(path)
    return V.read_points(q.spark, path, "json", wkt=True)


_POS = "({0} + 0.5::double) * 30", "y0 - ({0} + 0.5::double) * 30"
_SEG = (f"select line_id, cast(part as integer) as part, cast(seg as integer) as seg, cost, {_POS[0].format('ca')} as x1, "
        f"{_POS[1].format('ra')} as y1, {_POS[0].format('cb')} as x2, {_POS[1].format('rb')} as y2 from segs, g")


@query("lines_wkt_stored", _SEG)
def _(q):
    path = q.scratch("lines")
    V.lines_to_wkt(q.lines).write.parquet(path)
    return L.line_segments(V.read_lines(q.spark, path, wkt=True)).select(
        "line_id", "part", "seg", "cost", "x1", "y1", "x2", "y2")


@query("cost_raster_stored", "select cell_id, case when isnan(v) then -99.0::double else v end as v from raster")
def _(q):
    path = q.scratch("raster")
    C.write_cells(q.raster, path, q.meta)
    return C.read_cost_raster(q.spark, path).select(
        "cell_id", F.when(F.isnan("v"), -99.0).otherwise(F.col("v")).alias("v"))


@query("grid_extent", "select cast(max(r) + 1 as bigint) as nrows, cast(max(c) + 1 as bigint) as ncols, 0.0::double as x_min, "
                      "(max(c) + 1) * 30.0::double as x_max, any_value(y0) - (max(r) + 1) * 30.0::double as y_min, "
                      "any_value(y0) as y_max, 30.0::double as res_x, 30.0::double as res_y from cells, g")
def _(q):
    return C.grid_extent(q.cells, q.meta)


@query("grid_from_cells", "select cast(count(*) as bigint) as n, cast(max(r) + 1 as bigint) as nrows, cast(max(c) + 1 as bigint) as ncols from cells")
def _(q):
    meta = C.grid_from_cells(q.cells, 0.0, q.meta.y0, 30.0, -30.0, "local")
    return C.full_grid(q.spark, meta).join(q.cells.select("cell_id"), "cell_id").agg(
        F.count("*").alias("n"), (F.max("row") + 1).cast("bigint").alias("nrows"),
        (F.max("col") + 1).cast("bigint").alias("ncols"))


# ---- checks ------------------------------------------------------------------------------------

_OUTSIDE = "not (x between 0 and 1200.0::double and y between 0 and y0)"


@query("grid_check", "select 'dem' as \"check\", count(distinct cell_id) = any_value(nrows) * 40 as ok, "
                     "case when count(distinct cell_id) = any_value(nrows) * 40 then 'ok' else 'missing_cells' end as status from cells, g")
def _(q):
    return checks.check_dem(q.cells, q.meta)


@query("grid_check_incomplete", "select 'dem' as \"check\", count(*) = any_value(nrows) * 40 as ok, "
                                "case when count(*) = any_value(nrows) * 40 then 'ok' else 'missing_cells' end as status from samples, g")
def _(q):
    return checks.check_dem(q.samples, q.meta)


@query("points_check", "select 'points' as \"check\", count(*) > 0 as ok, case when count(*) > 0 then 'ok' else 'no_points' end as status from pts")
def _(q):
    return checks.check_points(q.points)


@query("points_bounds_report",
       f"select count(*) as total, count(*) filter ({_OUTSIDE}) as outside, count(*) - (select count(*) from placed) as without_cell, "
       f"case when count(*) filter ({_OUTSIDE}) = 0 then 'ok' when count(*) filter ({_OUTSIDE}) = count(*) then 'all_outside' "
       "else 'some_outside' end as status from pts, g")
def _(q):
    return checks.points_bounds_report(q.points, q.meta)


@query("origin_check", "select 'origin' as \"check\", count(*) = 1 as ok, case when count(*) = 1 then 'ok' else 'not_exactly_one' end as status from origin_pt")
def _(q):
    return checks.check_origin(q.origin)


@query("destinations_check", "select 'destinations' as \"check\", (select count(*) from dests) > 0 as ok, "
                             "case when (select count(*) from dests) > 0 then 'ok' else 'none_on_grid' end as status, "
                             "count(*) as total, count(*) - (select count(*) from dests) as skipped from dest_pts")
def _(q):
    return checks.check_destinations(q.dest_points, q.meta)


@query("input_checks", f"select 'points_bounds' as \"check\", false as ok, case when bool_and({_OUTSIDE}) then 'all_outside' else 'some_outside' end as status from pts, g")
def _(q):
    return checks.first_failure(checks.check_inputs(q.cells, q.points, q.meta))


def _same_grid_sql(raster: str, dims: str = "true") -> str:
    """Status of a cost raster, a select of its ``cell_id``."""
    status = (f"case when not {dims} then 'other_dimensions' when count(*) filter (cell_id not between 0 and n - 1) > 0 then 'cells_outside_grid' "
              "when count(*) > count(distinct cell_id) then 'repeated_cells' when count(*) < any_value(n) then 'missing_cells' else 'ok' end")
    return (f"select 'same_grid' as \"check\", status = 'ok' as ok, status from (select {status} as status "
            f"from ({raster}), (select count(*) as n from cells))")


@query("same_grid_check", _same_grid_sql("select cell_id from raster"))
def _(q):
    return checks.check_same_grid(q.raster, q.meta, q.meta)


@query("same_grid_repeated", _same_grid_sql("select case when cell_id = 3 then 4 else cell_id end as cell_id from raster"))
def _(q):
    raster = q.raster.withColumn("cell_id", F.when(F.col("cell_id") == 3, 4).otherwise(F.col("cell_id")))
    return checks.check_same_grid(raster, q.meta, q.meta)


@query("same_grid_transposed", _same_grid_sql("select cell_id from raster", "(select nrows = 40 from g)"))
def _(q):
    return checks.check_same_grid(q.raster, q.meta, replace(q.meta, nrows=q.meta.ncols, ncols=q.meta.nrows))


@query("other_grid_check", _same_grid_sql("select s as cell_id from samples"))
def _(q):
    return checks.check_same_grid(q.samples, q.meta, q.meta)


def _line_schema_sql(columns: str) -> str:
    return (f"select 'line_schema' as \"check\", bool_or(column_name = 'cost') as ok, case when bool_or(column_name = 'cost') then 'ok' else 'no_cost_column' end as status "
            f"from (describe select {columns} from supplier)")


@query("line_schema_check", f"{_line_schema_sql('s_suppkey as line_id, s_acctbal as cost')} union all {_line_schema_sql('s_suppkey as line_id, s_acctbal as costs')} "
                            f"union all {_line_schema_sql('*')}")
def _(q):
    suppliers = tables.table(q.spark, q.sf_dir, "supplier")
    named = [suppliers.select(F.col("s_suppkey").alias("line_id"), F.col("s_acctbal").alias(name)) for name in ("cost", "costs")]
    return reduce(DataFrame.unionByName, map(checks.line_schema_report, [*named, suppliers]))


@query("rotation_check", "select n_nationkey as grid, not coalesce(abs(x) > 1e-12, false) and not coalesce(abs(y) > 1e-12, false) as ok, "
                         "case when coalesce(abs(x) > 1e-12, false) or coalesce(abs(y) > 1e-12, false) then 'rotated' else 'ok' end as status from (select n_nationkey, "
                         "case when n_regionkey = 4 then null else (n_nationkey % 4 - 2) * 1e-12::double end as x, (n_regionkey - 2) * 0.6e-12::double as y from nation)")
def _(q):
    """One geotransform for each nation, turned by nothing, by rounding or by more."""
    nations = tables.table(q.spark, q.sf_dir, "nation")
    x = F.when(F.col("n_regionkey") != 4, (F.pmod("n_nationkey", F.lit(4)) - 2) * F.lit(1e-12))
    grids = nations.select(F.col("n_nationkey").alias("grid"), x.alias("rot_x"), ((F.col("n_regionkey") - 2) * F.lit(0.6e-12)).alias("rot_y"))
    return checks.check_rotation(grids).select("grid", "ok", "status")


@query("points_null", "select count(*) as total, count(*) filter (x is null or not (x between 0 and 1200.0::double and y between 0 and y0)) as outside, "
                      "count(*) - (select count(*) from placed where point_id % 7 <> 3) as without_cell, 'some_outside' as status "
                      "from (select case when point_id % 7 = 3 then null else x end as x, y from pts), g")
def _(q):
    return checks.points_bounds_report(q.points.withColumn("x", F.when(F.col("point_id") % 7 != 3, F.col("x"))), q.meta)


@query("points_wkt_empty", "select point_id, x, y from pts where point_id % 3 <> 1")
def _(q):
    text = F.when(F.col("point_id") % 3 == 1, "POINT EMPTY").otherwise(
        F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")))
    return V.points_from_wkt(q.points.select("point_id", text.alias("wkt")))


# ---- points and coordinates --------------------------------------------------------------------

@query("points_to_cells", "select point_id, cell_id, r as row, c as col from placed")
def _(q):
    return P.points_to_cells(q.points, q.meta)


@query("sample_cells", "select s as cell_id, m from samples")
def _(q):
    return q.samples


@query("destination_cells", "select cell_id, count(*) as m from dests group by 1")
def _(q):
    return P.sample_cells(q.dest_points, q.meta)


@query("points_on_cells", "select point_id, cell_id, round(z, 6) as z from placed join cells using (cell_id)")
def _(q):
    return P.points_on_cells(q.points, q.cells, q.meta).select("point_id", "cell_id", _r("z"))


@query("cells_with_points", "select cell_id, round(z, 6) as z from cells where cell_id in (select s from samples)")
def _(q):
    return P.cells_with_points(q.cells, q.points, q.meta).select("cell_id", _r("z"))


@query("cell_coordinates", "select cell_id, r as row, c as col, c * 30.0::double as x_corner, y0 - r * 30.0::double as y_corner, "
                           "(c + 0.5::double) * 30 as x_center, y0 - (r + 0.5::double) * 30 as y_center from cells, g")
def _(q):
    row, col = cell_row(F.col("cell_id"), q.meta), cell_col(F.col("cell_id"), q.meta)
    corner, center = (cell_to_world(row, col, q.meta, a) for a in ("corner", "center"))
    return q.cells.select(cell_id(row, col, q.meta).alias("cell_id"), row.alias("row"), col.alias("col"),
                          corner[0].alias("x_corner"), corner[1].alias("y_corner"),
                          center[0].alias("x_center"), center[1].alias("y_center"))


# ---- terrain -----------------------------------------------------------------------------------

def _slope_sql(value: str) -> str:
    grad = ("sqrt(((e.z - w.z) / 60.0::double) ** 2 + ((s.z - n.z) / 60.0::double) ** 2)")
    return (f"select m.cell_id, case when n.z is null or s.z is null or e.z is null or w.z is null then 0.0::double "
            f"else round({value.format(grad)}, 6) end as value from cells m left join cells n on n.r = m.r - 1 and n.c = m.c "
            "left join cells s on s.r = m.r + 1 and s.c = m.c left join cells e on e.r = m.r and e.c = m.c + 1 "
            "left join cells w on w.r = m.r and w.c = m.c - 1")


@query("slope_degrees", _slope_sql("degrees(atan({}))"))
def _(q):
    return R.slope(q.cells, q.meta, "degrees", SMALL_TILE).select("cell_id", _r("value"))


@query("slope_percent", _slope_sql("{} * 100"))
def _(q):
    return R.slope(q.cells, q.meta, "percent").select("cell_id", _r("value"))


_PAIRS = "from cells a cross join (select * from steps where k = {k}) o join cells b on b.r = a.r + o.dr and b.c = a.c + o.dc"


@query("slope_stored_tiles", _slope_sql("degrees(atan({}))"))
def _(q):
    return R.slope(q.tiles(TILE, 1), q.meta, "degrees").select("cell_id", _r("value"))


@query("neighbour_pairs", f"select a.cell_id as src, b.cell_id as dst, dr, dc, round(dh, 6) as dh, round(b.z - a.z, 6) as dz {_PAIRS.format(k=32)}")
def _(q):
    return N.neighbour_pairs(q.cells, 32, q.meta, SMALL_TILE).select(
        "src", "dst", "dr", "dc", _r("dh"), F.round(F.col("z_to") - F.col("z_from"), 6).alias("dz"))


@query("neighbour_edges_8", f"select a.cell_id as src, b.cell_id as dst, round({walk_cost('speed')}, 9) as w {_PAIRS.format(k=8)}")
def _(q):
    return N.edges(q.cells, 8, q.meta).select("src", "dst", _r("w", 9))


@query("edges_16", "select src, dst, round(w, 9) as w from edge_x")
def _(q):
    return N.edges(q.cells, 16, q.meta, cap="exponent").select("src", "dst", _r("w", 9))


@query("edges_modified", "select src, dst, round(w, 9) as w from edge_sm")
def _(q):
    return N.edges(q.cells, 16, q.meta, q.mult, tile_size=SMALL_TILE).select("src", "dst", _r("w", 9))


@query("tobler_caps", f"select a.cell_id as src, b.cell_id as dst, "
                      f"round(ln({walk_cost('speed', dz='(b.z - a.z) * 40')}), 6) as by_speed, "
                      f"round(ln({walk_cost('exponent', dz='(b.z - a.z) * 40')}), 6) as by_exponent {_PAIRS.format(k=16)}")
def _(q):
    pairs = N.neighbour_pairs(q.cells, 16, q.meta)
    dz = (F.col("z_to") - F.col("z_from")) * 40
    return pairs.select("src", "dst", F.round(F.ln(tobler(F.col("dh"), dz, "speed")), 6).alias("by_speed"),
                        F.round(F.ln(tobler(F.col("dh"), dz, "exponent")), 6).alias("by_exponent"))


for _k in NEIGHBOUR_OPTIONS:
    def _degree(q, k=_k):
        return N.degree_profile(N.edges(q.cells, k, q.meta), q.cells)
    query(f"degree_profile_{_k}", f"select a.cell_id as src, count(*) as degree {_PAIRS.format(k=_k)} group by 1")(_degree)

    def _base(q, k=_k):
        return R.base_cost(q.cells, k, q.meta).select("cell_id", _r("value", 9))
    query(f"base_cost_{_k}", f"select a.cell_id, round(avg({walk_cost('speed')}), 9) as value {_PAIRS.format(k=_k)} group by 1")(_base)


@query("edge_totals", f"select count(*) as cells, cast(sum(n) as bigint) as edges, min(n) as min_degree, max(n) as max_degree "
                      f"from (select a.cell_id, count(*) as n {_PAIRS.format(k=16)} group by 1)")
def _(q):
    return N.edge_totals(N.edges(q.cells, 16, q.meta), q.cells)


_HOLES = "(select *, case when cell_id % 13 = 5 then null else z end as h from cells)"
_HOLE_PAIRS = (f"from {_HOLES} a left join (select * from steps where k = 16) o on true "
               f"left join {_HOLES} b on b.r = a.r + o.dr and b.c = a.c + o.dc and b.h is not null and a.h is not null")
_HOLE_COST = walk_cost("speed", dz="(b.h - a.h)")


@query("degree_profile_holes", f"select a.cell_id as src, count(b.cell_id) as degree {_HOLE_PAIRS} group by 1")
def _(q):
    return N.degree_profile(N.edges(q.holes, 16, q.meta), q.holes)


@query("base_cost_nodata", f"select a.cell_id, case when any_value(a.h) is not null then round(coalesce(avg({_HOLE_COST}) filter (b.cell_id is not null), 0), 9) end as value {_HOLE_PAIRS} group by 1")
def _(q):
    return R.base_cost(q.holes, 16, q.meta).select("cell_id", _r("value", 9))


@query("total_cost_nodata", f"select cell_id, round(value * m, 9) as value from (select a.cell_id, case when any_value(a.h) is not null "
                            f"then coalesce(avg({_HOLE_COST}) filter (b.cell_id is not null), 0) end as value {_HOLE_PAIRS} group by 1) join mult using (cell_id)")
def _(q):
    return R.total_cost(R.base_cost(q.holes, 16, q.meta), q.mult).select("cell_id", _r("value", 9))


@query("base_cost_stored_tiles", "select cell_id, round(value, 9) as value from base16")
def _(q):
    return R.base_cost(q.tiles(TILE, 3), 16, q.meta).select("cell_id", _r("value", 9))


@query("base_cost_by_name", f"select a.cell_id, round(avg({walk_cost('speed')}), 9) as value {_PAIRS.format(k=8)} group by 1")
def _(q):
    return R.base_cost(q.cells, 8, q.meta, cost="tobler").select("cell_id", _r("value", 9))


# ---- lines and multipliers ---------------------------------------------------------------------

@query("line_segments", _SEG)
def _(q):
    return L.line_segments(q.lines)


@query("line_walk", "select line_id, cast(part as integer) as part, cast(seg as integer) as seg, step, r as row, c as col from walk, g "
                    "where r between 0 and nrows - 1 and c between 0 and 39")
def _(q):
    return L.walk_segments(L.line_segments(q.lines), q.meta).select("line_id", "part", "seg", "step", "row", "col")


for _b in (0, 1, 2):
    def _line_mult(q, b=_b):
        return L.rasterize_lines(q.lines, q.meta, b)
    query(f"line_multipliers_b{_b}", f"select cell_id, greatest(m, 1.0::double) as m from spread where b = {_b}")(_line_mult)


@query("line_multipliers_any", "select cell_id, m from spread where b = 1")
def _(q):
    return L.rasterize_lines(q.lines, q.meta, 1, "max")


@query("line_coverage",
       "select (select count(*) from supplier) as features, (select count(distinct line_id) from segs, g where (ra between 0 and nrows - 1 and ca between 0 and 39) "
       "or (rb between 0 and nrows - 1 and cb between 0 and 39)) as features_inside, cast(2 * count(*) as bigint) as vertices, "
       "cast(sum((ra between 0 and nrows - 1 and ca between 0 and 39)::int + (rb between 0 and nrows - 1 and cb between 0 and 39)::int) as bigint) as vertices_inside from segs, g")
def _(q):
    return L.line_coverage(q.lines, q.meta)


@query("raster_multipliers", "select cell_id, m from rmult")
def _(q):
    return R.combine_multipliers(q.cells, None, q.raster)


@query("additional_cost", "select cell_id, round(m, 9) as m from mult")
def _(q):
    return q.mult.select("cell_id", _r("m", 9))


@query("total_cost", "select cell_id, round(value * m, 9) as value from base16 join mult using (cell_id)")
def _(q):
    return R.total_cost(R.base_cost(q.cells, 16, q.meta), q.mult).select("cell_id", _r("value", 9))


@query("modifier_stats", "select (select count(*) from lmult where m > 1) as modified_cells, count(*) as total_cells, "
                         "round((select count(*) from lmult where m > 1) * 100.0::double / count(*), 6) as modified_percent, "
                         "count(*) filter (m <> 1) as applied_raster_cells from rmult")
def _(q):
    return R.modifier_stats(q.line_mult, q.raster, q.meta).withColumn("modified_percent", F.round("modified_percent", 6))


@query("dilate_sum", f"select cell_id, cast(n as bigint) as value from {boxed('samples_n', 's', 2)}".replace(
    "from samples_n)", "from (select s, m as n from samples))"))
def _(q):
    return R.dilate(q.samples.select("cell_id", F.col("m").alias("value")), q.meta, 2, "sum")


def _box_sql(fold: str, b: int) -> str:
    """A box's sum or maximum by comparing every cell with every sample cell."""
    return (f"select a.cell_id, cast({fold}(m) as bigint) as value from cells a, (select m, s // 40 as r, s % 40 as c from samples) b "
            f"where abs(a.r - b.r) <= {b} and abs(a.c - b.c) <= {b} group by 1")


@query("dilate_sum_200", _box_sql("sum", 200))
def _(q):
    return R.dilate(q.samples.select("cell_id", F.col("m").alias("value")), q.meta, 200, "sum")


@query("dilate_max", _box_sql("max", 6))
def _(q):
    return R.dilate(q.samples.select("cell_id", F.col("m").alias("value")), q.meta, 6, "max")


# ---- cost distance and paths -------------------------------------------------------------------

@query("cost_distance", "select s as source, v as cell_id, round(dist, 6) as d from dist_p")
def _(q):
    return D.cost_distance(q.cells, q.samples, q.stencil("exponent", SMALL_TILE)).select("source", "cell_id", _r("d"))


@query("cost_distance_modified", "select s as source, v as cell_id, round(dist, 6) as d from dist_pm")
def _(q):
    return D.cost_distance(q.cells, q.samples, q.stencil("exponent"), q.mult).select("source", "cell_id", _r("d"))


@query("cost_distance_wide", "select s as source, v as cell_id, round(dist, 6) as d from dist_wo")
def _(q):
    q = q.wide
    source = P.points_to_cells(q.origin, q.meta).select("cell_id")
    return D.cost_distance(q.cells, source, q.stencil(tile=JobOptions.tile_size)).select("source", "cell_id", _r("d"))


@query("cost_distance_frontier", "select s as source, v as cell_id, round(dist, 6) as d from dist_p")
def _(q):
    edge_table = N.edges(q.cells, 16, q.meta, cap="exponent")
    return frontier.frontier_distance(edge_table, q.samples).select("source", "cell_id", _r("d"))


@query("cost_distance_resumed", "select s as source, v as cell_id, round(dist, 6) as d from dist_o")
def _(q):
    """Two rounds, then the rest by a second search that finds the first one's tables."""
    where, source = q.scratch("resumed"), P.points_to_cells(q.origin, q.meta).select("cell_id")
    try:
        D.cost_trees(q.cells, source, q.stencil(), keep_cells=True, resume=where, max_rounds=2)
    except D.Unfinished:
        pass
    solved = D.cost_trees(q.cells, source, q.stencil(), keep_cells=True, resume=where)
    return D.distances(solved).select("source", "cell_id", _r("d"))


@query("cost_distance_buckets", "select s as source, v as cell_id, round(dist, 6) as d from dist_om")
def _(q):
    """Expanding what lies within a few level steps of a source's nearest cell."""
    source = P.points_to_cells(q.origin, q.meta).select("cell_id")
    edge_table = N.edges(q.cells, 16, q.meta, Scratch(q.spark, "m").save(q.mult, "m"))
    return frontier.frontier_distance(edge_table, source, width=0.4).select("source", "cell_id", _r("d"))


@query("predecessors", "select s as source, v as cell_id, p as pred from pred_p")
def _(q):
    return D.cost_predecessors(q.cells, q.samples, q.stencil("exponent", SMALL_TILE))


@query("predecessors_joined", "select s as source, v as cell_id, p as pred from pred_pm")
def _(q):
    mult = Scratch(q.spark, "m").save(q.mult, "m")
    dist = D.cost_distance(q.cells, q.samples, q.stencil("exponent", SMALL_TILE), mult)
    return frontier.predecessors(dist, N.edges(q.cells, 16, q.meta, mult, cap="exponent"))


@query("pairwise_cost", "select d.s as source, v as cell_id, round(dist, 6) as d from dist_p d join samples t on t.s = d.v")
def _(q):
    return D.pairwise_cost(q.cells, q.samples, q.stencil("exponent")).select("source", "cell_id", _r("d"))


@query("pairwise_cost_overlay", "select d.s as source, v as cell_id, round(dist, 6) as d from dist_p d join samples t on t.s = d.v")
def _(q):
    """The same through costs of crossing tiles."""
    over = overlay.build_overlay(q.cells, q.stencil("exponent"))
    return overlay.overlay_costs(over, q.samples, q.samples).select("source", "cell_id", _r("d"))


@query("overlay_searched_again", "select d.s as source, v as cell_id, round(dist, 6) as d from dist_pm d join (select distinct cell_id from dests) t on t.cell_id = d.v")
def _(q):
    """A second search of one overlay, with other points, in cost buckets."""
    over = overlay.build_overlay(q.cells, q.stencil("exponent", SMALL_TILE), Scratch(q.spark, "m").save(q.mult, "m"))
    first = overlay.overlay_costs(over, q.dests, q.samples)
    return overlay.overlay_costs(over, first.select("cell_id").distinct(), q.dests, width=1.0).select("source", "cell_id", _r("d"))


@query("reachability", "select dest_id, cell_id, round(dist, 6) as d, dist is not null as reachable from dests left join dist_o on v = cell_id")
def _(q):
    return q.lcpa()["reachability"].select("dest_id", "cell_id", _r("d"), "reachable")


@query("reachability_stored_tiles", "select dest_id, cell_id, round(dist, 6) as d, dist is not null as reachable from dests left join dist_o on v = cell_id")
def _(q):
    stencil = q.stencil()
    return q.lcpa(tiles=q.tiles(stencil.size, stencil.overlap + stencil.reach))["reachability"].select("dest_id", "cell_id", _r("d"), "reachable")


@query("lcpa_paths", "select path_id, cast(step as integer) as step, cell as cell_id from num_o join path_o on dest = cell_id")
def _(q):
    return q.lcpa()["paths"]


@query("lcpa_paths_modified", "select path_id, cast(step as integer) as step, cell as cell_id from num_om join path_om on dest = cell_id")
def _(q):
    return q.lcpa(modified=True, tile_size=SMALL_TILE)["paths"]


_HITS = "(select cell, count(*) as n from path_o join dests on dest = cell_id group by 1)"


@query("lcpa_path_raster", f"select cells.cell_id, coalesce(n, 0) as n from cells left join {_HITS} h on h.cell = cells.cell_id")
def _(q):
    return q.lcpa()["path_raster"]


@query("lcpa_path_raster_wide", "select wcells.cell_id, coalesce(n, 0) as n from wcells left join (select cell, count(*) as n from num_wo join path_wo on dest = cell_id group by 1) h "
                                "on h.cell = wcells.cell_id")
def _(q):
    return q.wide.lcpa()["path_raster"]


@query("lcpa_path_raster_b1", f"select cells.cell_id, cast(coalesce(n, 0) as bigint) as n from cells left join {boxed(_HITS, 'cell', 1)} h on h.cell_id = cells.cell_id")
def _(q):
    return q.lcpa(buffer=1)["path_raster"]


@query("lcpa_path_lines", "select path_id, dest_id, cell_id as dest_cell, 'LINESTRING (' || string_agg((cell % 40 * 30)::double::varchar || ' ' || "
                          "(y0 - cell // 40 * 30)::double::varchar, ', ' order by step) || ')' as wkt "
                          "from num_o join path_o on dest = cell_id, g group by 1, 2, 3")
def _(q):
    return q.lcpa()["path_lines"].select("path_id", "dest_id", "dest_cell", "wkt")


@query("lcpa_path_lines_stored", "select path_id, dest_id, cast(count(*) as integer) as vertices from num_o join path_o on dest = cell_id group by 1, 2")
def _(q):
    path = q.scratch("lines")
    V.write_path_lines(q.lcpa()["path_lines"], path, "json", compression="lz4")
    stored = q.spark.read.schema("path_id long, dest_id long, wkt string").json(path)
    return stored.select("path_id", "dest_id", F.size(F.split("wkt", ",")).alias("vertices"))


def _summary_sql(tag: str) -> str:
    return (f"select count(*) as num_destinations, cast(sum(n) as bigint) as total_path_cells, round(sum(dist), 6) as total_cost "
            f"from num{tag} join (select dest, count(*) as n from path{tag} group by 1) on dest = cell_id")


@query("lcpa_summary", _summary_sql("_o"))
def _(q):
    return q.lcpa()["summary"].select("num_destinations", "total_path_cells", _r("total_cost"))


@query("lcpa_summary_modified", _summary_sql("_om"))
def _(q):
    return q.lcpa(modified=True)["summary"].select("num_destinations", "total_path_cells", _r("total_cost"))


@query("fete_path_counts", "select s as source, cell as cell_id, n from pc_p")
def _(q):
    return point_path_counts(q.cells, q.samples, q.stencil("exponent", SMALL_TILE))


@query("fete_density", "select cells.cell_id, coalesce(n, 0) as n from cells left join dens_p on cell = cells.cell_id")
def _(q):
    return R.on_grid(q.cells, point_density(q.cells, q.points, q.meta, q.options()))


# DuckDB takes minutes for this on the larger tables, so it is compared at the smallest scale only, by the tests.
SLOW = {"fete_density_wide": sql("select wcells.cell_id, coalesce(n, 0) as n from wcells left join dens_wp on cell = wcells.cell_id")}


@query("fete_density_wide")
def _(q):
    q = q.wide
    return R.on_grid(q.cells, point_density(q.cells, q.points, q.meta, q.options()))


@query("fete_density_b1", f"select cells.cell_id, cast(coalesce(n, 0) as bigint) as n from cells left join {boxed('dens_p', 'cell', 1)} h on h.cell_id = cells.cell_id")
def _(q):
    return R.on_grid(q.cells, point_density(q.cells, q.points, q.meta, q.options(buffer=1)))


@query("fete_density_modified", "select cells.cell_id, coalesce(n, 0) as n from cells left join dens_pm on cell = cells.cell_id")
def _(q):
    return fete(q.cells, q.points, q.meta, q.options(tile_size=SMALL_TILE), q.lines, q.raster, q.meta)["density"]


@query("density_summary", "select max(n) as max_density, min(n) as min_density, cast(sum(n) // count(*) as bigint) as avg_density, "
                          "count(*) as nonzero_cells, (select count(*) from cells) as total_cells from dens_p")
def _(q):
    return fete(q.cells, q.points, q.meta, q.options())["summary"]


_FACTS = ("select 'cost_raster' as fact, 'applied' as status, null::double as value union all select 'modified_cells', null, (select count(*) from lmult where m > 1) "
          "union all select 'modified_percent', null, round((select count(*) from lmult where m > 1) * 100.0::double / (select count(*) from cells), 6) "
          "union all select 'applied_raster_cells', null, (select count(*) from rmult where m <> 1) "
          "union all select 'line_features', null, (select count(*) from supplier) "
          "union all select 'line_vertices', null, (select 2 * count(*) from segs) "
          "union all select 'line_features_inside', null, (select count(distinct line_id) from line_ends where inside) "
          "union all select 'line_vertices_inside', null, (select count(*) from line_ends where inside)")


@query("fete_report", f"select 'points' as fact, null as status, (select count(*) from pts)::double as value union all "
                      f"select 'points_skipped', null, (select count(*) from pts) - (select count(*) from placed) union all {_FACTS}")
def _(q):
    report = fete(q.cells, q.points, q.meta, q.options(), q.lines, q.raster, q.meta)["report"]
    return report.withColumn("value", F.round("value", 6))


@query("lcpa_report", f"select 'destinations' as fact, null as status, (select count(*) from dest_pts)::double as value union all "
                      f"select 'destinations_skipped', null, (select count(*) from dest_pts) - (select count(*) from dests) union all {_FACTS}")
def _(q):
    return q.lcpa(modified=True)["report"].withColumn("value", F.round("value", 6))
