"""Statistics of standardized points: summaries, histograms, spatial and axis aggregates, anomaly shares.

Points are (source_row, x, y, z, value, is_numeric_valid).  Only rows that are declared valid and have a finite value
count; every aggregate is one partial aggregation over the scan, and dense results come from a join with the bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.functions.scalar import is_finite, log10_positive
from terralith.operators.binning import bin_index, edges
from terralith.operators.errors import GeoError
from terralith.operators.shared import checkpointed, group_quantiles

LEVELS = [0.05, 0.25, 0.5, 0.75, 0.95]


def common_valid(points: DataFrame) -> DataFrame:
    return points.where(F.col("is_numeric_valid") & is_finite(F.col("value")))


def axes_of(dimension: str) -> list[str]:
    return ["x", "y", "z"] if dimension == "3d" else ["x", "y"]


def _bounds(df: DataFrame, *cols: str) -> dict[str, tuple[float, float]]:
    row = df.agg(*(f(c).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if row[f"{cols[0]}_lo"] is None:
        raise GeoError("ANALYSIS_EMPTY_COMMON_VALID", columns=cols)
    return {c: (float(row[f"{c}_lo"]), float(row[f"{c}_hi"])) for c in cols}


def quality_summary(points: DataFrame, dimension: str = "2d") -> DataFrame:
    axes = axes_of(dimension)
    ok = F.col("is_numeric_valid") & is_finite(F.col("value"))
    total = points.agg(F.count("*").alias("row_count"), F.count_if(ok).alias("valid_count"), *(f(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in axes for n, f in (("min", F.min), ("max", F.max))))
    distinct = common_valid(points).select(*axes).distinct().agg(F.count("*").alias("places"))
    return total.join(F.broadcast(distinct)).select("row_count", "valid_count", (F.col("row_count") - F.col("valid_count")).alias("invalid_count"), (F.col("valid_count") - F.col("places")).alias("duplicate_coordinate_count"), *(f"{c}_{n}" for c in axes for n in ("min", "max")))


def quantile_row(points: DataFrame, value: str = "value") -> DataFrame:
    found = exact_quantiles(points, value, LEVELS)
    if found is None:
        raise GeoError("ANALYSIS_EMPTY_COMMON_VALID", function="quantiles")
    return points.sparkSession.createDataFrame([tuple(found)], "p05 double, p25 double, p50 double, p75 double, p95 double")


def numeric_summary(points: DataFrame) -> DataFrame:
    """Count, extremes, mean, median, sample deviation (null for one value) and quantiles."""
    valid = common_valid(points)
    basic = valid.agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return basic.join(F.broadcast(quantile_row(valid))).withColumn("median", F.col("p50"))


def histogram(df: DataFrame, value: str = "value", bins: int = 32) -> DataFrame:
    lo, hi = _bounds(df, value)[value]
    counts = df.where(F.col(value).isNotNull()).groupBy(bin_index(F.col(value), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))
    return edges(df.sparkSession, lo, hi, bins).join(F.broadcast(counts), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def log10_histogram(points: DataFrame, bins: int = 32) -> DataFrame:
    """The histogram of log10 of the positive values, and how many valid values were not positive on every row."""
    logs = common_valid(points).select(log10_positive(F.col("value")).alias("log_value"))
    excluded = logs.where("log_value is null").count()
    return histogram(logs.where("log_value is not null"), "log_value", bins).withColumn("excluded", F.lit(excluded))


def spatial_cells(points: DataFrame, size: int = 32) -> DataFrame:
    """Count and mean of every cell of an XY grid; empty cells have a null mean. x runs fastest in (iy, ix)."""
    valid, spark = common_valid(points), points.sparkSession
    b = _bounds(valid, "x", "y")
    found = valid.groupBy(bin_index(F.col("y"), *b["y"], size).alias("iy"), bin_index(F.col("x"), *b["x"], size).alias("ix")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    every = spark.range(size * size).select((F.col("id") / size).cast("int").alias("iy"), (F.col("id") % size).cast("int").alias("ix"))
    return every.join(F.broadcast(found), ["iy", "ix"], "left").select("iy", "ix", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def axis_profile(points: DataFrame, axis: str, bins: int = 32, dimension: str = "3d") -> DataFrame:
    if axis not in axes_of(dimension):
        raise GeoError("ANALYSIS_AXIS_UNAVAILABLE", axis=axis, dimension=dimension)
    valid = common_valid(points)
    lo, hi = _bounds(valid, axis)[axis]
    found = valid.groupBy(bin_index(F.col(axis), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    found = found.join(group_quantiles(valid.withColumn("bin", bin_index(F.col(axis), lo, hi, bins)), ["bin"], "value", {"median": 0.5}), "bin", "left")
    return edges(points.sparkSession, lo, hi, bins).join(F.broadcast(found), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median")


def axis_trends(points: DataFrame, bins: int = 32, dimension: str = "3d") -> DataFrame:
    """The profile of every axis in one pass: the axes are unpivoted and grouped together."""
    valid, spark = common_valid(points), points.sparkSession
    axes = axes_of(dimension)
    b = _bounds(valid, *axes)
    rows = valid.select("value", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), bin_index(F.col(a), *b[a], bins).alias("bin")) for a in axes))).alias("s")).select("value", "s.*")
    found = rows.groupBy("axis", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    found = found.join(group_quantiles(rows, ["axis", "bin"], "value", {"median": 0.5}), ["axis", "bin"], "left")
    every = None
    for a in axes:
        part = edges(spark, *b[a], bins).withColumn("axis", F.lit(a))
        every = part if every is None else every.unionByName(part)
    return every.join(F.broadcast(found), ["axis", "bin"], "left").select("axis", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median")


def gradient_summary(points: DataFrame, size: int = 16) -> DataFrame:
    """Absolute differences of the means of neighbouring cells (+x and +y); pairs with an empty cell are counted apart."""
    cells = checkpointed(spatial_cells(points, size))
    pairs = None
    for di, dj in ((0, 1), (1, 0)):
        a = cells.select(F.col("iy"), F.col("ix"), F.col("mean").alias("a"))
        b = cells.select((F.col("iy") - di).alias("iy"), (F.col("ix") - dj).alias("ix"), F.col("mean").alias("b"))
        part = a.join(b, ["iy", "ix"]).select(F.abs(F.col("b") - F.col("a")).alias("d"))
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.agg(F.count("d").alias("pairs"), F.count_if(F.col("d").isNull()).alias("excluded"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.95)).alias("p95"), F.max("d").alias("max"))


def anomaly_thresholds(points: DataFrame) -> tuple[float, float]:
    """(low, high): the quartiles of the valid values."""
    found = exact_quantiles(common_valid(points), "value", [0.25, 0.75])
    if found is None:
        raise GeoError("ANALYSIS_EMPTY_COMMON_VALID", function="anomaly_thresholds")
    return found[0], found[1]


def depth_slice_ratios(points: DataFrame, bins: int = 16) -> DataFrame:
    valid = common_valid(points)
    low, high = anomaly_thresholds(points)
    lo, hi = _bounds(valid, "z")["z"]
    found = valid.groupBy(bin_index(F.col("z"), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= high).alias("n_high"), F.count_if(F.col("value") <= low).alias("n_low"))
    out = edges(points.sparkSession, lo, hi, bins).join(F.broadcast(found), "bin", "left")
    return out.select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), (F.col("n_high") / F.col("n")).alias("high_ratio"), (F.col("n_low") / F.col("n")).alias("low_ratio"))


def classed_cells(points: DataFrame, size: int = 32) -> DataFrame:
    """Cells with a class: high and low by the quartiles of the cell means, normal, or empty. Where the quartiles
    meet, every cell with rows is normal."""
    cells = checkpointed(spatial_cells(points, size))
    q = cells.agg(F.percentile("mean", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    low, high = q or (None, None)
    return cells.withColumn("class", F.when(F.col("mean").isNull(), "empty").when(F.lit(low == high), "normal").when(F.col("mean") >= F.lit(high), "high").when(F.col("mean") <= F.lit(low), "low").otherwise("normal"))


def spatial_anomaly_summary(points: DataFrame, size: int = 32) -> DataFrame:
    """Cells, rows and the share of rows for each class."""
    found = classed_cells(points, size).groupBy("class").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))
    total = common_valid(points).count()
    return found.select("class", "cells", "n", (F.col("n") / F.lit(float(total))).alias("ratio"))


def export_rows(summary: dict[str, float], sections: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """The long export: section, axis, bin_index, metric, lower, upper, value. ``sections``: (section, axis, bins)."""
    spark = sections[0][2].sparkSession
    out = spark.createDataFrame([("summary", None, None, k, None, None, float(v)) for k, v in sorted(summary.items())], "section string, axis string, bin_index int, metric string, lower double, upper double, value double")
    for section, axis, df in sections:
        metrics = [c for c in df.columns if c not in ("bin", "lower", "upper")]
        stacked: Column = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
        part = df.select(F.lit(section).alias("section"), F.lit(axis).alias("axis"), F.col("bin").alias("bin_index"), "lower", "upper", stacked.alias("s"))
        out = out.unionByName(part.select("section", "axis", "bin_index", "s.metric", "lower", "upper", "s.value"))
    return out
