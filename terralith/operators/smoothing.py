"""Discrete smooth interpolation in space: a field on a grid in which free nodes are the mean of their neighbours, and what
it misses at the samples, spread by inverse distance.

Any number of sample sets (problems) is fitted in one course: ``bricks`` settles their grids side by side, and samples and
queries carry the key of their problem through every join.  All gates are typed failures; one problem's failure is recorded
for it alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.scalar import is_finite
from terralith.operators import bricks
from terralith.operators.errors import GeoError
from terralith.operators.grid import AXES, DEFAULT_CELLS, INDEX, Axis, default_axes
from terralith.operators.grouped_neighbors import nearest_by
from terralith.operators.shared import checkpointed

EXACT, KEPT = 1e-12, 1e-8  # a query at a sample; how far a sample's value may be missed
LEAST_SAMPLES = 3
NEIGHBORS = 16


@dataclass
class Fitted:
    """Settled fields (problem, ix, iy, iz, x, y, z, value, is_nodata), what the samples miss there (problem, source_row, x,
    y, z, value), a report for each problem, and the problems themselves. ``powers``: of the inverse distances."""

    field: DataFrame | None
    missed: DataFrame | None
    reports: dict[int, dict]
    problems: dict[int, bricks.Problem]
    powers: dict[int, float] = field(default_factory=dict)


def _param(problems: dict[int, bricks.Problem], value) -> F.Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, p in sorted(problems.items()) for x in (k, value(p)))), F.col("problem"))


def _snapped(samples: DataFrame, problems: dict[int, bricks.Problem]) -> DataFrame:
    """The mean of the samples at each node that is some sample's nearest (a half goes down)."""
    out = samples
    for j, (name, c) in enumerate(zip(INDEX, AXES, strict=True)):
        low, step, last = (_param(problems, f) for f in (lambda p, j=j: float(p.axes[j].low), lambda p, j=j: float(p.axes[j].step), lambda p, j=j: p.axes[j].nodes - 1))
        out = out.withColumn(name, F.greatest(F.lit(0), F.least(last, F.ceil((F.col(c) - low) / step - 0.5))).cast("int"))
    return out.groupBy("problem", *INDEX).agg(F.avg("value").alias("value"))


def _between(grid: DataFrame, problems: dict[int, bricks.Problem], queries: DataFrame) -> DataFrame:
    """(problem, query_id, trend): the weighted corners of the cell; null if a corner has no data, be its weight 0. A place
    on the last node of an axis has that node as both its corners."""
    q = queries.select("problem", "query_id", *AXES)
    for j, (name, c) in enumerate(zip(INDEX, AXES, strict=True)):
        low, step, last = (_param(problems, f) for f in (lambda p, j=j: float(p.axes[j].low), lambda p, j=j: float(p.axes[j].step), lambda p, j=j: p.axes[j].nodes - 1))
        at = F.greatest(F.lit(0.0), F.least(last.cast("double"), (F.col(c) - low) / step))
        base = F.least(F.floor(at), last).cast("int")
        q = q.withColumns({f"_b{name}": base, f"_f{name}": at - base, f"_l{name}": last})
    corners = F.array(*(F.struct(F.lit(i).alias("ix"), F.lit(j).alias("iy"), F.lit(k).alias("iz")) for i in (0, 1) for j in (0, 1) for k in (0, 1)))
    q = q.withColumn("_o", F.explode(corners))
    weight = F.lit(1.0)
    for name in INDEX:
        weight = weight * F.when(F.col(f"_o.{name}") == 1, F.col(f"_f{name}")).otherwise(1 - F.col(f"_f{name}"))
    q = q.select("problem", "query_id", weight.alias("_w"), *(F.least(F.col(f"_b{n}") + F.col(f"_o.{n}"), F.col(f"_l{n}")).alias(n) for n in INDEX))
    met = q.join(grid.select("problem", *INDEX, F.when(~F.col("is_nodata"), F.col("value")).alias("_v")), ["problem", *INDEX], "left")
    return met.groupBy("problem", "query_id").agg(F.when(F.count_if(F.col("_v").isNull()) == 0, F.sum(F.col("_w") * F.col("_v"))).alias("trend"))


def fit(samples: DataFrame, settings: dict[int, dict], axes: dict[int, tuple[Axis, Axis, Axis]] | None = None, cells: int = DEFAULT_CELLS) -> Fitted:
    """``samples``: problem, source_row, x, y, z, value. ``settings`` of a problem: ``neighbor_connectivity`` (6, 18, 26),
    ``smoothing_strength``, ``convergence_tolerance``, ``max_iterations`` and ``init_power``. Without ``axes`` a problem's grid
    spans its samples with at most ``cells`` nodes.

    Failures: DSI_INPUT_INVALID (null or non-finite coordinates or values, no samples), DSI_DUPLICATE_COORDINATES,
    DSI_NO_SUPPORTED_NODES (fewer than three samples), DSI_NON_FINITE, DSI_NOT_CONVERGED, DSI_CONSTRAINT (a sample's value isn't
    met within KEPT).
    """
    samples = checkpointed(samples.select("problem", "source_row", *AXES, "value"))
    good = F.lit(True)
    for c in (*AXES, "value"):
        good = good & F.coalesce(is_finite(F.col(c)), F.lit(False))
    stats = {r["problem"]: r for r in samples.groupBy("problem").agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.avg("value").alias("mean"), *(f(c).alias(f"{c}{i}") for c in AXES for i, f in enumerate((F.min, F.max)))).collect()}
    repeated = {r["problem"] for r in samples.groupBy("problem", *AXES).agg(F.count("*").alias("n")).where("n > 1").select("problem").distinct().collect()}
    reports, problems = {}, {}
    for k, s in settings.items():
        r = stats.get(k)
        error = "DSI_INPUT_INVALID" if r is None or r["bad"] else "DSI_DUPLICATE_COORDINATES" if k in repeated else "DSI_NO_SUPPORTED_NODES" if r["n"] < LEAST_SAMPLES else None
        if error:
            reports[k] = {"error": error, "converged": False, "iterations": 0, "max_delta": None}
            continue
        spans = [(r[f"{c}0"], r[f"{c}1"]) for c in AXES]
        grid = (axes or {}).get(k) or tuple(default_axes(spans, cells))
        problems[k] = bricks.Problem(k, tuple(grid), *(tuple(b[i] for b in spans) for i in (0, 1)), r["mean"], s.get("neighbor_connectivity", 6), s.get("smoothing_strength", 0.5), s.get("convergence_tolerance", 1e-4), s.get("max_iterations", 200), bricks.SIDE, bricks.MOST_COARSE)
    powers = {k: float(s.get("init_power", 2.0)) for k, s in settings.items()}
    if not problems:
        return Fitted(None, None, reports, {}, powers)
    held = samples.where(F.col("problem").isin(*problems))
    nodes, told = bricks.settle(samples.sparkSession, list(problems.values()), _snapped(held, problems))
    reports |= told
    alive = {k: p for k, p in problems.items() if "error" not in reports[k]}
    if not alive:
        return Fitted(None, None, reports, {}, powers)
    nodes = checkpointed(nodes.where(F.col("problem").isin(*alive)))
    held = held.where(F.col("problem").isin(*alive))
    trend = _between(nodes, alive, held.withColumnRenamed("source_row", "query_id")).withColumnRenamed("query_id", "source_row")
    missed = checkpointed(held.join(trend, ["problem", "source_row"]).withColumns({"_given": F.col("value"), "value": F.col("value") - F.col("trend")}))
    off = F.coalesce(~(F.abs(F.col("trend") + F.col("value") - F.col("_given")) <= KEPT), F.lit(True))
    for r in missed.groupBy("problem").agg(F.count_if(off).alias("n"), F.max(F.abs(F.col("trend") + F.col("value") - F.col("_given"))).alias("worst")).collect():
        reports[r["problem"]]["max_observation_error"] = r["worst"]
        if r["n"]:
            reports[r["problem"]] |= {"error": "DSI_CONSTRAINT", "converged": False}
    return Fitted(nodes, missed.select("problem", "source_row", *AXES, "value"), reports, {k: p for k, p in alive.items() if "error" not in reports[k]}, powers)


def predict_many(fitted: Fitted, queries: DataFrame) -> DataFrame:
    """(problem, query_id, value, is_nodata) for ``queries`` (problem, query_id, x, y, z) of problems that were fitted. Beyond the samples' bounds, and beside nodes
    without data: NoData."""
    alive = fitted.problems
    mine = queries.select("problem", "query_id", *AXES).where(F.col("problem").isin(*alive))
    inside = F.lit(True)
    for j, c in enumerate(AXES):
        inside = inside & F.col(c).between(_param(alive, lambda p, j=j: float(p.low[j])), _param(alive, lambda p, j=j: float(p.high[j])))
    inner = checkpointed(mine.where(inside))
    near = nearest_by(inner, fitted.missed, NEIGHBORS, "problem", AXES)
    w = 1 / F.pow("d", F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(fitted.powers.items()) for x in (k, v))), F.col("problem")))
    at = F.when(F.col("d") <= EXACT, F.struct("d", "source_row", "value"))
    apart = F.col("d") > EXACT
    rest = near.groupBy("problem", "query_id").agg(F.min(at).alias("at"), (F.sum(F.when(apart, w * F.col("value"))) / F.sum(F.when(apart, w))).alias("mean"))
    rest = rest.select("problem", "query_id", F.coalesce("at.value", "mean").alias("rest"))
    found = _between(fitted.field, alive, inner).join(rest, ["problem", "query_id"])
    out = mine.select("problem", "query_id").join(found, ["problem", "query_id"], "left")
    value = F.col("trend") + F.col("rest")
    return out.select("problem", "query_id", value.alias("value"), value.isNull().alias("is_nodata"))


def raise_failures(reports: dict[int, dict]) -> None:
    for k, r in sorted(reports.items()):
        if "error" in r:
            raise GeoError(r["error"], **{n: v for n, v in r.items() if n != "error"})


def smooth(points: DataFrame, axes: list[Axis] | None = None, connectivity: int = 6, strength: float = 0.5, tolerance: float = 1e-4, iterations: int = 200) -> tuple[Fitted, dict]:
    """(fitted, report) of one set of samples; any failure is raised."""
    if axes is not None and len(axes) != 3:
        raise GeoError("ALGORITHM_DIMENSION_UNSUPPORTED", axes=len(axes))
    settings = {"neighbor_connectivity": connectivity, "smoothing_strength": strength, "convergence_tolerance": tolerance, "max_iterations": iterations}
    fitted = fit(points.withColumn("problem", F.lit(0)), {0: settings}, {0: tuple(axes)} if axes else None)
    raise_failures(fitted.reports)
    return fitted, fitted.reports[0]


def predict(fitted: Fitted, queries: DataFrame) -> DataFrame:
    """(query_id, value, is_nodata) at any places of the one problem."""
    return predict_many(fitted, queries.withColumn("problem", F.lit(0))).drop("problem")
