"""Prediction metrics on common valid rows, group metrics, residual summaries and comparisons.

Predictions are long: (candidate, source_row, observed, predicted, is_nodata).  The common rows of all candidates are a
grouped boolean, so nothing is pivoted and any number of candidates costs one shuffle on source_row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.scalar import is_finite
from terralith.operators.shared import group_quantiles


def usable() -> Column:
    return ~F.col("is_nodata") & F.coalesce(is_finite(F.col("predicted")) & is_finite(F.col("observed")), F.lit(False))


def common_rows(predictions: DataFrame) -> DataFrame:
    """source_row of rows that every candidate predicts."""
    n = predictions.select("candidate").distinct().count()
    good = predictions.groupBy("source_row").agg(F.bool_and(usable()).alias("ok"), F.count_distinct("candidate").alias("n"))
    return good.where(F.col("ok") & (F.col("n") == n)).select("source_row")


def with_errors(predictions: DataFrame) -> DataFrame:
    e = F.when(usable(), F.col("predicted") - F.col("observed"))
    return predictions.withColumn("residual", e).withColumn("absolute_error", F.abs(e)).withColumn("squared_error", e * e)


def _summary(df: DataFrame, by: list[str]) -> DataFrame:
    """mae, rmse, r2, bias. R2 on a constant truth is 1 without error and 0 otherwise; the spread is taken about the mean
    in a second look at the same groups."""
    centre = df.groupBy(*by).agg(F.avg("observed").alias("_mean")) if by else df.agg(F.avg("observed").alias("_mean"))
    both = df.join(F.broadcast(centre), by) if by else df.join(F.broadcast(centre))
    d = F.col("observed") - F.col("_mean")
    out = (both.groupBy(*by) if by else both.groupBy()).agg(F.count("*").alias("n"), F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("residual").alias("bias"), F.sum("squared_error").alias("sse"), F.sum(d * d).alias("sst"))
    r2 = F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("sse") / F.col("sst"))
    return out.select(*by, "n", "mae", "rmse", r2.alias("r2"), "bias")


def metrics(predictions: DataFrame, common: bool = True) -> DataFrame:
    """For each candidate: its metrics on the common (or its own) rows, its own coverage, and what was excluded."""
    rows = with_errors(predictions)
    own = rows.groupBy("candidate").agg(F.count("*").alias("rows"), F.count_if(usable()).alias("own_valid"), F.count_if(F.col("is_nodata")).alias("nodata"))
    kept = rows.where(usable())
    if common:
        kept = kept.join(common_rows(predictions), "source_row", "left_semi")
    out = own.join(_summary(kept, ["candidate"]), "candidate", "left")
    return out.select("candidate", F.coalesce("n", F.lit(0)).alias("n"), "mae", "rmse", "r2", "bias", (F.col("own_valid") / F.col("rows")).alias("coverage"), "nodata", (F.col("rows") - F.coalesce("n", F.lit(0))).alias("excluded"))


def nine_metrics(predictions: DataFrame) -> DataFrame:
    """The long summary on the common rows: also median absolute error, mean and median relative error (the absolute
    error by the truth with its sign; infinite where only the truth is 0, left out where both are), the deviation of log10
    over positive pairs, and the 90th percentile of the absolute error; R2 is null on a constant truth."""
    kept = with_errors(predictions).where(usable()).join(common_rows(predictions), "source_row", "left_semi")
    kept = kept.withColumn("relative", F.when(F.col("observed") != 0, F.col("absolute_error") / F.col("observed")).when(F.col("absolute_error") > 0, float("inf")))
    logs = F.when((F.col("observed") > 0) & (F.col("predicted") > 0), F.log10("predicted") - F.log10("observed"))
    more = kept.groupBy("candidate").agg(
        F.avg("relative").alias("mean_relative"), F.sqrt(F.avg(logs * logs)).alias("log10_rmse"), F.var_pop("observed").alias("_spread"),
    )
    ranks = group_quantiles(kept, ["candidate"], "absolute_error", {"median_ae": 0.5, "p90_ae": 0.9}).join(group_quantiles(kept, ["candidate"], "relative", {"median_relative": 0.5}), "candidate", "left")
    return _summary(kept, ["candidate"]).join(more, "candidate").join(ranks, "candidate").withColumn("r2", F.when(F.col("_spread") > 0, F.col("r2"))).drop("_spread")


def group_metrics(predictions: DataFrame, group: str, common: bool = True) -> DataFrame:
    """Metrics by candidate and group on the rows that all candidates predict (or that each does)."""
    rows = with_errors(predictions)
    if common:
        rows = rows.join(common_rows(predictions).withColumn("_common", F.lit(True)), "source_row", "left")
    use = F.coalesce("_common", F.lit(False)) if common else usable()
    of = lambda c: F.avg(F.when(use, F.col(c)))
    out = rows.groupBy("candidate", group).agg(F.count("*").alias("n_total"), F.count_if(use).alias("n_valid"), of("absolute_error").alias("mae"), F.sqrt(of("squared_error")).alias("rmse"), of("residual").alias("bias"))
    return out.select("candidate", group, "n_total", "n_valid", (F.col("n_valid") / F.col("n_total")).alias("coverage"), "mae", "rmse", "bias")


def grouping_diagnostics(predictions: DataFrame, provenance: DataFrame) -> DataFrame:
    """Metrics by survey line and by point on the common rows, from one pass with grouping sets."""
    kept = with_errors(predictions).join(common_rows(predictions).withColumn("common", F.lit(True)), "source_row", "left").join(provenance, "source_row", "left")
    use = F.coalesce("common", F.lit(False))
    rows = kept.groupingSets([[F.col("candidate"), F.col("line_id")], [F.col("candidate"), F.col("point_id")]], F.col("candidate"), F.col("line_id"), F.col("point_id"))
    return rows.agg(F.count_if(use).alias("n"), F.avg(F.when(use, F.col("absolute_error"))).alias("mae"), F.sqrt(F.avg(F.when(use, F.col("squared_error")))).alias("rmse"), F.avg(F.when(use, F.col("residual"))).alias("bias"))


def residual_summary(predictions: DataFrame) -> DataFrame:
    """Residuals by candidate: mean, population deviation, extremes, absolute percentiles, and rows without data."""
    rows = with_errors(predictions)
    out = rows.groupBy("candidate").agg(F.count("residual").alias("n"), F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std"), F.min("residual").alias("min"), F.max("residual").alias("max"), F.count_if(~usable()).alias("nodata"))
    ranks = group_quantiles(rows, ["candidate"], "absolute_error", {f"abs_p{p}": p / 100 for p in (50, 90, 95, 99)})
    return out.join(ranks, "candidate", "left").select("candidate", "n", "mean", "std", "min", "max", *(f"abs_p{p}" for p in (50, 90, 95, 99)), "nodata")


def ranking(summary: DataFrame) -> DataFrame:
    """rmse up, mae up, r2 down, then the candidate's name. Candidates are few: they are a configured list."""
    order = [F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(), F.col("r2").desc_nulls_last(), F.col("candidate")]
    from pyspark.sql import Window

    return summary.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def pair_deltas(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """first - second for mae, rmse, r2 and bias, on the rows that both predict."""
    s = metrics(predictions.where(F.col("candidate").isin(first, second)))
    keys = ["mae", "rmse", "r2", "bias"]
    a = s.where(F.col("candidate") == first).select(F.col("n"), *(F.col(k).alias(f"a_{k}") for k in keys))
    b = s.where(F.col("candidate") == second).select(*(F.col(k).alias(f"b_{k}") for k in keys))
    return a.join(F.broadcast(b)).select("n", *((F.col(f"a_{k}") - F.col(f"b_{k}")).alias(f"d_{k}") for k in keys))


def baseline_check(summary: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """(candidate, metric, value, expected, delta, within): both sides unpivoted and joined in full."""
    keys = ["mae", "rmse", "r2", "bias"]
    long = lambda df, name: df.select("candidate", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias(name)) for k in keys))).alias("s")).select("candidate", "s.*")
    both = long(summary, "value").join(long(baseline, "expected"), ["candidate", "metric"], "full_outer")
    d = F.abs(F.col("value") - F.col("expected"))
    return both.select("candidate", "metric", "value", "expected", d.alias("delta"), F.coalesce(d <= tolerance, F.lit(False)).alias("within"))
