"""Regular grids in long form: (ix, iy, iz, x, y, z, value, is_nodata), one row per node.

A node's place follows from its number, so grids are made by arithmetic over a range, never by crossing axes.  NoData is
null.  Neighbours meet in equi-joins on shifted indices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.functions.scalar import is_finite
from terralith.operators.binning import bin_index, edges
from terralith.operators.errors import GeoError

MOST_CELLS = 1_000_000
DEFAULT_CELLS = 100_000
PREVIEW_CELLS = 50_000
INDEX = ["ix", "iy", "iz"]
AXES = ["x", "y", "z"]


@dataclass(frozen=True)
class Axis:
    low: float
    high: float
    nodes: int

    @property
    def step(self) -> float:
        return (self.high - self.low) / (self.nodes - 1) if self.nodes > 1 else 1.0

    def coord(self, i: Column) -> Column:
        return F.when(i == self.nodes - 1, F.lit(self.high)).otherwise(F.lit(self.low) + i * F.lit(self.step))


def axis(low: float, high: float, step: float) -> Axis:
    """Two nodes at least; the number of steps is rounded half to even."""
    return Axis(low, high, max(2, round((high - low) / step) + 1))


def bounds(points: DataFrame, axes: list[str]) -> list[tuple[float, float]]:
    row = points.agg(*(f(a).alias(f"{a}{n}") for a in axes for n, f in (("0", F.min), ("1", F.max)))).first()
    return [(row[f"{a}0"], row[f"{a}1"]) for a in axes]


def default_axes(spans: list[tuple[float, float]], most: int = DEFAULT_CELLS) -> list[Axis]:
    """The finest grid of about equal steps within ``most`` nodes, found by halving; a flat axis counts as 1 wide."""
    widths = [(b - a) or 1.0 for a, b in spans]
    shape = lambda s: [max(2, round(w / max(widths) * s) + 1) for w in widths]
    low, high = 1.0, float(most)
    for _ in range(64):
        middle = (low + high) / 2
        low, high = (middle, high) if np.prod(shape(middle), dtype=float) <= most else (low, middle)
    return [Axis(a, b if b > a else a + w, n) for (a, b), w, n in zip(spans, widths, shape(low), strict=True)]  # the last node is the bound itself


def nodes(spark: SparkSession, axes: list[Axis], most: int = MOST_CELLS) -> DataFrame:
    """All nodes, x slowest; the number of cells is checked first."""
    total = int(np.prod([a.nodes for a in axes], dtype=np.int64))
    if total > most:
        raise GeoError("GRID_TOO_LARGE", cells=total, most=most)
    out, inner = spark.range(total).select(F.col("id").alias("node_id")), total
    for name, coord, a in zip(INDEX, AXES, axes, strict=False):
        inner //= a.nodes
        i = (F.floor(F.col("node_id") / inner) % a.nodes).cast("int")
        out = out.withColumn(name, i).withColumn(coord, a.coord(i))
    return out


def axes_from_points(points: DataFrame, axes: list[str], nodes_each: int = 11) -> list[Axis]:
    """Axes over the points' bounds with eleven nodes each; a flat axis gets a step of 1 (two nodes)."""
    return [axis(a, b if b > a else a, (b - a) / (nodes_each - 1) if b > a else 1.0) for a, b in bounds(points, axes)]


def take_slice(grid: DataFrame, axis_name: str, index: int) -> DataFrame:
    out = grid.where(F.col(f"i{axis_name}") == index)
    if not out.limit(1).count():
        raise GeoError("SLICE_OUT_OF_RANGE", axis=axis_name, index=index)
    return out


def valid(grid: DataFrame) -> DataFrame:
    return grid.where(~F.col("is_nodata") & F.coalesce(is_finite(F.col("value")), F.lit(False)))


def grid_statistics(grid: DataFrame) -> DataFrame:
    q = exact_quantiles(valid(grid), "value", [0.25, 0.5, 0.75]) or [None] * 3
    v = F.when(~F.col("is_nodata"), F.col("value"))
    s = grid.agg(F.count("*").alias("total"), F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    return s.select("total", "valid", (F.col("total") - F.col("valid")).alias("nodata"), "min", "max", "mean", *(F.lit(x).cast("double").alias(n) for n, x in zip(("p25", "median", "p75"), q, strict=True)))


def slice_statistics(grid: DataFrame, axis_name: str, index: int) -> DataFrame:
    """Statistics of a slice (population deviation, 10th, 50th and 90th percentile), and its shares below, between and
    from the quartiles of the whole grid."""
    low, high = exact_quantiles(valid(grid), "value", [0.25, 0.75])
    part = take_slice(grid, axis_name, index)
    v = F.when(~F.col("is_nodata"), F.col("value"))
    ranks = exact_quantiles(valid(part), "value", [0.1, 0.5, 0.9]) or [None] * 3
    return part.agg(F.count("*").alias("total"), F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *(F.lit(q).cast("double").alias(f"p{p}") for p, q in zip((10, 50, 90), ranks, strict=True)), F.count_if(v < low).alias("low"), F.count_if((v >= low) & (v < high)).alias("normal"), F.count_if(v >= high).alias("high"))


# Rows and columns of a slice across an axis.
PLANES = {"x": ("z", "y"), "y": ("z", "x"), "z": ("y", "x")}


def chart_slice(grid: DataFrame, axis_name: str, index: int) -> DataFrame:
    """A slice as a chart reads it: (row, column, row_coord, column_coord, coordinate, relative, value, masked); infinite
    values and NaN are masked like NoData, ``relative`` is the slice's place along its axis from 0 to 1."""
    rows, columns = PLANES[axis_name]
    last = grid.agg(F.max(f"i{axis_name}")).first()[0]
    good = ~F.col("is_nodata") & F.coalesce(is_finite(F.col("value")), F.lit(False))
    relative = F.lit(index / last if last else 0.0)
    return take_slice(grid, axis_name, index).select(F.col(f"i{rows}").alias("row"), F.col(f"i{columns}").alias("column"), F.col(rows).alias("row_coord"), F.col(columns).alias("column_coord"), F.col(axis_name).alias("coordinate"), relative.alias("relative"), F.when(good, F.col("value")).alias("value"), (~good).alias("masked"))


def slice_rows(grid: DataFrame, axis_name: str, index: int) -> DataFrame:
    """A slice for export: (x, y, z, value, is_nodata), rows outside, columns inside; NoData has no value."""
    rows, columns = PLANES[axis_name]
    good = ~F.col("is_nodata") & F.coalesce(is_finite(F.col("value")), F.lit(False))
    return take_slice(grid, axis_name, index).orderBy(f"i{rows}", f"i{columns}").select(*AXES, F.when(good, F.col("value")).alias("value"), (~good).alias("is_nodata"))


def write_slice(grid: DataFrame, axis_name: str, index: int, path: str) -> None:
    """``slice_rows`` as CSV with a header; one slice is one file."""
    slice_rows(grid, axis_name, index).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def bounded(df: DataFrame, most: int, order: str = "source_row", every: int = 1) -> DataFrame:
    """Each s-th row by a dense row number, s the least that keeps ``most`` rows, and at least ``every``."""
    return decimated(df, max(every, -(-df.count() // most), 1), order)


# Scale and palette by the kind of source.
RENDER = {"builtin_legacy": ("log", "native-spectrum"), "candidate_result": ("linear", "viridis")}


def render_profile(grid: DataFrame, kind: str) -> DataFrame:
    """(low, high, log_available, scale, palette): a log scale needs positive values."""
    scale, palette = RENDER[kind]
    s = valid(grid).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return s.select("low", "high", (F.col("low") > 0).alias("log_available"), F.when(F.col("low") > 0, scale).otherwise("linear").alias("scale"), F.lit(palette).alias("palette"))


def composition(grid: DataFrame) -> DataFrame:
    """Nodes below the first quartile (low), from the third on (high), and between."""
    low, high = exact_quantiles(valid(grid), "value", [0.25, 0.75])
    c = F.when(F.col("value") >= high, "high").when(F.col("value") < low, "low").otherwise("normal")
    n = valid(grid).count()
    return valid(grid).groupBy(c.alias("class")).agg(F.count("*").alias("n")).withColumn("ratio", F.col("n") / F.lit(float(n)))


def depth_profile(grid: DataFrame, bins: int = 8) -> DataFrame:
    """Count, mean (0 where empty) and share of high nodes for each bin of z."""
    good = valid(grid)
    (lo, hi), high = bounds(grid, ["z"])[0], exact_quantiles(good, "value", [0.75])[0]
    if lo is None or lo == hi:
        raise GeoError("DEPTH_NOT_APPLICABLE")
    found = good.groupBy(bin_index(F.col("z"), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("value") >= high).alias("n_high"))
    out = edges(grid.sparkSession, lo, hi, bins).join(F.broadcast(found), "bin", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("bin", "lower", "upper", zero("n").alias("n"), zero("mean").alias("mean"), zero(F.col("n_high") / F.col("n")).alias("high_ratio"))


def preview(grid: DataFrame, axes: int, most: int = PREVIEW_CELLS) -> DataFrame:
    """Every s-th node of each axis, s the least that keeps about ``most`` nodes."""
    total = grid.count()
    s = max(1, int(np.ceil((total / most) ** (1 / axes) - 1e-9))) if total > most else 1
    return grid.where(" and ".join(f"{i} % {s} = 0" for i in INDEX[:axes]))


def decimated(points: DataFrame, every: int, order: str = "source_row") -> DataFrame:
    """Each ``every``-th row in the order of a dense row number."""
    return points.where(F.pmod(F.col(order) - 1, F.lit(every)) == 0)


def support(grid: DataFrame, axes: int = 3) -> DataFrame:
    """The grid with each node's measure: the product of its cells' widths between midpoints, cut at the bounds."""
    out = grid.withColumn("measure", F.lit(1.0))
    for i, c in list(zip(INDEX, AXES, strict=True))[:axes]:
        w = Window.orderBy(i)  # over the nodes of one axis
        line = grid.select(i, c).distinct()
        left, right = (F.col(c) + F.lag(c).over(w)) / 2, (F.col(c) + F.lead(c).over(w)) / 2
        line = line.select(i, (F.coalesce(right, F.col(c)) - F.coalesce(left, F.col(c))).alias("_w"))
        out = out.join(F.broadcast(line), i).withColumn("measure", F.col("measure") * F.col("_w")).drop("_w")
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and largest absolute difference over the nodes that both have."""
    both = valid(a).select(*INDEX, F.col("value").alias("a")).join(valid(b).select(*INDEX, F.col("value").alias("b")), INDEX)
    d = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("common"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"))


def same_axes(a: DataFrame, b: DataFrame) -> bool:
    return all(not x.select(i, c).distinct().exceptAll(y.select(i, c).distinct()).limit(1).count() for x, y in ((a, b), (b, a)) for i, c in zip(INDEX, AXES, strict=True))


def snap(points: DataFrame, axes: list[Axis]) -> DataFrame:
    """Node indices of the nearest nodes (a half goes down), and the mean of the points that share one."""
    out = points
    for name, c, a in zip(INDEX, AXES, axes, strict=False):
        i = F.lit(0) if a.high == a.low else F.greatest(F.lit(0), F.least(F.lit(a.nodes - 1), F.ceil((F.col(c) - a.low) / a.step - 0.5)))
        out = out.withColumn(name, i.cast("int"))
    return out.groupBy(*INDEX[: len(axes)]).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def trilinear(grid: DataFrame, axes: list[Axis], queries: DataFrame) -> DataFrame:
    """(query_id, value): the weighted corners of the cell; null if a corner that counts has no data. Places beyond the
    grid are moved to its edge."""
    q, weights = queries.select("query_id", *AXES), []
    for name, c, a in zip(INDEX, AXES, axes, strict=True):
        f = F.greatest(F.lit(0.0), F.least(F.lit(float(a.nodes - 1)), (F.col(c) - a.low) / a.step))
        base = F.least(F.floor(f), F.lit(a.nodes - 2)).cast("int")
        q = q.withColumn(f"_f{name}", f - base).withColumn(f"_b{name}", base)
    corners = F.array(*(F.struct(*(F.lit(o).alias(f"o{n}") for n, o in zip(INDEX, (i, j, k), strict=True))) for i in (0, 1) for j in (0, 1) for k in (0, 1)))
    q = q.withColumn("_c", F.explode(corners))
    for name in INDEX:
        o = F.col(f"_c.o{name}")
        weights.append(F.when(o == 1, F.col(f"_f{name}")).otherwise(1 - F.col(f"_f{name}")))
        q = q.withColumn(name, F.col(f"_b{name}") + o)
    q = q.withColumn("_w", weights[0] * weights[1] * weights[2])
    met = q.join(grid.select(*INDEX, F.when(~F.col("is_nodata"), F.col("value")).alias("_v")), INDEX, "left")
    return met.groupBy("query_id").agg(F.when(F.count_if(F.col("_v").isNull()) == 0, F.sum(F.col("_w") * F.col("_v"))).alias("value"))


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbours in the plane (4, 8) or in space (6, 18, 26)."""
    flat = connectivity in (4, 8)
    most = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}[connectivity]
    steps = (-1, 0, 1)
    return [(i, j, k) for i in steps for j in steps for k in ((0,) if flat else steps) if 0 < abs(i) + abs(j) + abs(k) <= most]


def neighbor_mean(grid: DataFrame, connectivity: int = 6) -> DataFrame:
    """(ix, iy, iz, n, mean) over the neighbours with data; 0 and null where there are none. Each node sends its value to
    its neighbours' places: one grouping, no self-join."""
    sent = valid(grid).select("value", F.explode(F.array(*(F.struct(*((F.col(n) + o).alias(n) for n, o in zip(INDEX, d, strict=True))) for d in offsets(connectivity)))).alias("s")).select("value", "s.*")
    got = sent.groupBy(*INDEX).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grid.select(*INDEX).join(got, INDEX, "left").select(*INDEX, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def import_grid(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """A complete lattice of (x, y, z, value) rows as a grid. Finite coordinates, one row per node, even axes."""
    bad = rows.where(" or ".join(f"{c} is null or isnan({c})" for c in AXES)).count()
    places = rows.select(*AXES).distinct().count()
    total, out, size = rows.count(), rows, 1
    if bad or places != total:
        raise GeoError("GRID_ROWS_INVALID", bad=bad, repeated=total - places)
    for i, c in zip(INDEX, AXES, strict=True):
        w = Window.orderBy(c)  # over the distinct coordinates of one axis
        line = rows.select(c).distinct().withColumn(i, (F.row_number().over(w) - 1).cast("int")).withColumn("_gap", F.col(c) - F.lag(c).over(w))
        s = line.agg(F.count("*").alias("n"), F.min("_gap").alias("lo"), F.max("_gap").alias("hi"), (F.max(c) - F.min(c)).alias("span")).first()
        if s["n"] > 1 and s["hi"] - s["lo"] > tolerance * max(1.0, s["span"]):
            raise GeoError("GRID_AXIS_UNEVEN", axis=c)
        size *= s["n"]
        out = out.join(F.broadcast(line.select(c, i)), c)
    if size != total:
        raise GeoError("GRID_INCOMPLETE", rows=total, nodes=size)
    return out.select(*INDEX, *AXES, "value", F.col("value").isNull().alias("is_nodata"))
