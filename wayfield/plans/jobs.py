"""The two end-to-end jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions.geo import cell_col, cell_row, require_north_up, z_order
from wayfield.operators import checks
from wayfield.operators.distance import GROUP_CELLS, SOURCES_PER_GROUP, cost_trees, pack_tiles, reachability, target_costs
from wayfield.operators.lines import line_coverage, rasterize_lines
from wayfield.operators.numbering import numbered
from wayfield.operators.points import points_to_cells, sample_cells
from wayfield.operators.strips import strip_density, strip_path_counts, strip_side, strips_for
from wayfield.operators.terrain import base_cost, combine_multipliers, dilate, modifier_stats, on_grid, slope, total_cost
from wayfield.operators.tile_kernels import Stencil, many_sources_side
from wayfield.operators.tiles import StoredTiles
from wayfield.operators.tracing import (density_summary, lcpa_summary, number_paths, path_counts,
                                        path_lines, path_raster, trace_paths)
from wayfield.schema import COST_RASTER, GridMeta, JobOptions
from wayfield.sources.journal import Journal
from wayfield.sources.scratch import Scratch, task_slots


class Outputs(Mapping):
    """The outputs of a job by name; each is made, once, when it is asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _usable_raster(cost_raster: DataFrame | None, meta: GridMeta, raster_meta: GridMeta | None,
                   options: JobOptions) -> tuple[DataFrame | None, list]:
    """The cost raster, unless it is to be passed over, and what the report says of it."""
    if cost_raster is None:
        return None, []
    if raster_meta is None:
        raise ValueError("raster_meta is missing: rows and columns of a cost raster are its own, not those of the elevation grid")
    row = checks.check_same_grid(cost_raster, meta, raster_meta).first()
    if not row["ok"] and options.on_mismatch == "raise":
        raise ValueError(f"input check {row['check']!r} failed: {row['status']}")
    return (cost_raster if row["ok"] else None), [("cost_raster", "applied" if row["ok"] else f"skipped: {row['status']}", None)]


def _surfaces(cells: DataFrame, meta: GridMeta, options: JobOptions, lines: DataFrame | None, cost_raster: DataFrame | None,
              raster_meta: GridMeta | None, tiles: StoredTiles | None) -> tuple[dict[str, Callable], Callable[[], DataFrame | None], Callable[[], list]]:
    """Makers of slope, base cost and, when there are modifiers, additional and total cost; of the multipliers; of report lines.

    Only the inputs are checked here. Stencils read ``tiles``, where there are some. Lines are rasterised once, when an output first needs them.
    """
    spark = cells.sparkSession
    cost_raster, said = _usable_raster(cost_raster, meta, raster_meta, options)
    if lines is not None:
        checks.check_line_schema(lines)
    modified = lines is not None or cost_raster is not None

    def facts() -> list:
        out = list(said)
        if modified:
            stats = modifier_stats(made["line_mult"], made["raster"], meta).first()
            out += [(name, None, float(stats[name] or 0)) for name in ("modified_cells", "modified_percent", "applied_raster_cells")]
        if lines is not None:
            covered = line_coverage(lines, meta).first()
            out += [(f"line_{name}", None, float(covered[name] or 0)) for name in ("features", "features_inside", "vertices", "vertices_inside")]
        return out

    made = Outputs({
        "line_mult": lambda: (Scratch(spark, "line-multipliers").save(rasterize_lines(lines, meta, options.line_buffer, options.line_combine), "m")
                              if lines is not None else spark.createDataFrame([], "cell_id long, m double")),
        "raster": lambda: cost_raster if cost_raster is not None else spark.createDataFrame([], COST_RASTER),
        "mult": lambda: (Scratch(spark, "multipliers").save(combine_multipliers(cells, made["line_mult"], cost_raster), "m") if modified else None),
        "base": lambda: base_cost(tiles or cells, options.neighbours, meta, options.cost_function),
        "facts": facts})
    out = {"slope": lambda: slope(tiles or cells, meta, options.slope_units), "base_cost": lambda: made["base"]}
    if modified:
        out["additional_cost"] = lambda: made["mult"].select("cell_id", F.col("m").alias("value"))
        out["total_cost"] = lambda: total_cost(made["base"], made["mult"])
    return out, lambda: made["mult"], lambda: made["facts"]


def _report(spark: SparkSession, facts: list[tuple[str, str | None, float | None]]) -> DataFrame:
    """What a job did with its inputs: ``fact, status, value``."""
    return spark.createDataFrame(facts, "fact string, status string, value double")


def source_passes(samples: DataFrame, meta: GridMeta, passes: int, scratch: Scratch) -> DataFrame:
    """``samples`` with column ``pass``: stretches of equal length along the Z-shaped curve."""
    if passes == 1:
        return samples.withColumn("pass", F.lit(0))
    at = samples.withColumn("_z", z_order(cell_row(F.col("cell_id"), meta), cell_col(F.col("cell_id"), meta)))
    ranked = numbered(at, ["_z"], scratch)
    total = samples.count()
    return scratch.save(ranked.withColumn("pass", F.floor(F.col("rank") * passes / total).cast("int")).drop("_z", "rank"), "passes")


def _for_many(stencil: Stencil, sources: int, slots: int) -> Stencil:
    """The stencil with larger tiles if there are still as many groups of sources as tasks."""
    larger = replace(stencil, size=many_sources_side(stencil.meta, stencil.size))
    together = max(1, min(SOURCES_PER_GROUP, GROUP_CELLS // larger.tile_cells))
    return larger if sources >= slots * together else stencil


def point_density(cells: DataFrame, points: DataFrame, meta: GridMeta, options: JobOptions = JobOptions(),
                  mult: DataFrame | None = None, tiles: StoredTiles | None = None) -> DataFrame:
    """How many least-cost paths between all ordered pairs of points cross each cell.

    Sparse ``cell_id, value`` with the buffer applied. Sources are solved in passes of bounded
    size along a space-filling curve, so the sources of a pass lie close together; each pass leaves one count
    per cell. Points that share a cell are solved once and weighted. A long, narrow grid is searched strip by strip
    (:mod:`wayfield.operators.strips`; not with stored tiles or a resumable job), in one pass.
    The box sum is linear, so it is applied once, after the sum over sources.
    """
    spark = cells.sparkSession
    stencil = Stencil(meta, options.neighbours, options.tile_size, "exponent", options.cost_function)
    folder = f"{options.resume}/density" if options.resume else None
    scratch = Scratch(spark, "density", folder)
    journal = Journal(spark, folder, f"density {stencil} {options.sources_per_pass}") if folder else None
    begun = journal.state if journal else None
    if begun:
        samples, blocks, ordered = (journal.table(begun[name]) for name in ("samples", "blocks", "ordered"))
        passes, parts = begun["passes"], [journal.table(note) for note in begun["parts"]]
    else:
        samples = scratch.save(sample_cells(points, meta), "samples")
        if tiles is None and not journal and (side := strip_side(meta)):
            counts = strip_density(cells, samples, stencil, mult, scratch, side)
            return dilate(scratch.save(counts.groupBy("cell_id").agg(F.sum("n").alias("value")), "counts"), meta, options.buffer, "sum")
        total = samples.count()
        if tiles is None and not journal:
            stencil = _for_many(stencil, total, task_slots(spark))
        blocks = scratch.save(pack_tiles(tiles or cells, stencil, mult, samples), "blocks")
        passes = max(1, -(-total // options.sources_per_pass))
        ordered = source_passes(samples, meta, passes, scratch)
        if journal and passes == 1:
            ordered = scratch.save(ordered, "passes")
        parts = []

    def finished() -> None:
        if journal:
            journal.record(samples=samples, blocks=blocks, ordered=ordered, passes=passes, parts=parts)

    if not begun:
        finished()
    for i in range(len(parts), passes):
        sources = ordered.where(F.col("pass") == i)
        solved = cost_trees(cells, sources, stencil, targets=samples, bounded=True, blocks=blocks,
                            resume=f"{folder}/pass-{i}" if folder else None)
        counts = path_counts(solved, source_weights=samples, per_source=False)
        parts.append(scratch.save(counts.groupBy("cell_id").agg(F.sum("n").alias("value")), "counts"))
        finished()
        solved.scratch.clear()
    if not journal:
        scratch.drop(blocks)
    return dilate(reduce(DataFrame.unionByName, parts), meta, options.buffer, "sum")


def point_path_counts(cells: DataFrame, samples: DataFrame, stencil: Stencil, mult: DataFrame | None = None) -> DataFrame:
    """Paths from each cell of ``samples`` (``cell_id, m``) to all others through each cell: ``source, cell_id, n``."""
    samples = Scratch(cells.sparkSession, "samples").save(samples, "samples")
    if side := strips_for(cells, samples, stencil.meta):
        return strip_path_counts(cells, samples, stencil, mult, side)
    return path_counts(cost_trees(cells, samples, stencil, mult, targets=samples, bounded=True))


def fete(cells: DataFrame, points: DataFrame, meta: GridMeta, options: JobOptions = JobOptions(),
         lines: DataFrame | None = None, cost_raster: DataFrame | None = None,
         raster_meta: GridMeta | None = None, tiles: StoredTiles | None = None) -> Outputs:
    """Movement from everywhere to everywhere: cost surfaces and the density of all paths.

    The DEM is always checked; ``on_outside`` says only whether points off the grid stop the job or
    are passed over. ``raster_meta`` is the cost raster's own grid and needed with one. ``tiles`` are the same
    cells stored by tile, which stencils and path searches then read instead.
    """
    require_north_up(meta)
    found = {r["check"]: r for r in checks.check_inputs(cells, points, meta).collect()}
    for name in ("dem", "points", *(["points_bounds"] if options.on_outside == "raise" else [])):
        if not found[name]["ok"]:
            raise ValueError(f"input check {name!r} failed: {found[name]['status']}")
    bounds = checks.points_bounds(points, meta).first()
    if bounds["without_cell"] == bounds["total"]:
        raise ValueError("input check 'points' failed: no_points on the grid")
    out, mult, facts = _surfaces(cells, meta, options, lines, cost_raster, raster_meta, tiles)
    counted = [("points", None, float(bounds["total"])), ("points_skipped", None, float(bounds["without_cell"]))]
    outputs = Outputs(out | {
        "density": lambda: on_grid(cells, point_density(cells, points, meta, options, mult(), tiles)),
        "summary": lambda: density_summary(outputs["density"], meta),
        "report": lambda: _report(cells.sparkSession, [*counted, *facts()])})
    return outputs


def lcpa(cells: DataFrame, origin: DataFrame, destinations: DataFrame, meta: GridMeta,
         options: JobOptions = JobOptions(), lines: DataFrame | None = None,
         cost_raster: DataFrame | None = None, anchor: str = "corner", raster_meta: GridMeta | None = None,
         tiles: StoredTiles | None = None) -> Outputs:
    """Least-cost paths from one origin to many destinations.

    Rasters and summary come from counts of paths and not from the paths' cells, which are made
    only for ``paths``.
    """
    require_north_up(meta)
    found = sorted(checks.check_path_inputs(cells, origin, destinations, meta).collect(), key=lambda r: r["step"])
    for row in found:
        if not row["ok"]:
            raise ValueError(f"input check {row['check']!r} failed: {row['status']}")
    skipped = found[2]
    out, mult, facts = _surfaces(cells, meta, options, lines, cost_raster, raster_meta, tiles)
    counted = [("destinations", None, float(skipped["total"])), ("destinations_skipped", None, float(skipped["skipped"]))]
    spark = cells.sparkSession
    scratch = Scratch(spark, "lcpa")
    stencil = Stencil(meta, options.neighbours, options.tile_size, "speed", options.cost_function)
    source = points_to_cells(origin, meta).select("cell_id")

    def crossing() -> DataFrame:
        counts = path_counts(made["solved"], per_source=False)
        # A destination in the origin's own cell has that cell as its path.
        own = made["targets"].join(source, "cell_id", "left_semi").select("cell_id", F.col("m").alias("n"))
        return scratch.save(counts.unionByName(own).groupBy("cell_id").agg(F.sum("n").alias("n")), "crossing")

    made = Outputs({
        "dests": lambda: scratch.save(checks.usable_destinations(destinations, meta), "dests"),
        "targets": lambda: scratch.save(made["dests"].groupBy("cell_id").agg(F.count("*").alias("m")), "targets"),
        "solved": lambda: cost_trees(tiles or cells, source, stencil, mult(), made["targets"], bounded=True, with_goals=True,
                                     resume=f"{options.resume}/paths" if options.resume else None),
        "reach": lambda: scratch.save(reachability(target_costs(made["solved"]), made["dests"]), "reach"),
        "crossing": crossing,
        "numbered": lambda: number_paths(made["reach"], scratch)})
    return Outputs(out | {
        "reachability": lambda: made["reach"],
        "paths": lambda: trace_paths(made["solved"], made["targets"], made["numbered"]),
        "path_lines": lambda: path_lines(made["solved"], made["numbered"], anchor),
        "path_raster": lambda: on_grid(cells, path_raster(made["crossing"], meta, options.buffer)),
        "summary": lambda: lcpa_summary(made["reach"], made["crossing"]),
        "report": lambda: _report(spark, [*counted, *facts()])})
