"""Bins of equal width, with the edge rules of the statistics (right-open) and of the variograms (left-open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def span(low: float, high: float) -> tuple[float, float]:
    """The range that bins divide: a constant one is widened by a half on both sides."""
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def bin_index(v: Column, low: float, high: float, bins: int) -> Column:
    """Right-open bins, the last one closed; exact against the edges low + i * step."""
    low, high = span(low, high)
    step = (high - low) / bins
    i = F.floor((v - low) / step)
    i = i + F.when(v >= F.lit(low) + (i + 1) * step, 1).when(v < F.lit(low) + i * step, -1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), i)).cast("int")


def lag_index(h: Column, width: float) -> Column:
    """Left-open bins of distances: an inner edge belongs to the lower bin; distance 0 to the first."""
    return F.greatest(F.ceil(h / F.lit(float(width))) - 1, F.lit(0)).cast("int")


def edges(spark: SparkSession, low: float, high: float, bins: int) -> DataFrame:
    """(bin, lower, upper) for every bin."""
    low, high = span(low, high)
    step = (high - low) / bins
    i = F.col("id")
    return spark.range(bins).select(i.cast("int").alias("bin"), (F.lit(low) + i * step).alias("lower"), F.when(i == bins - 1, F.lit(high)).otherwise(F.lit(low) + (i + 1) * step).alias("upper"))
