"""Forests on spatial features, and kriging with a forest on its out-of-fold residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators import candidates, kriging, validation
from terralith.operators.errors import GeoError
from terralith.operators.forests import Settings, predict_forests

LEAST_RESIDUALS, LEAST_COVERAGE = 30, 0.8


class Forest:
    """Mean and spread (population deviation) of the trees' predictions. The trees are grown where a prediction asks for them, so
    that none has to travel."""

    def __init__(self, trees: int = 160, depth: int = 18, leaf: int = 2, share: float = 0.8, seed: int = 20260813) -> None:
        self.settings = Settings(trees, depth, leaf, share, seed)

    def fit(self, points: DataFrame, axes: list[str], value: str = "value") -> Forest:
        self.axes = axes
        self.points = points.select("source_row", *axes, F.col(value).alias("value"))
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        one = F.lit(0).alias("problem")
        found = predict_forests(self.points.select(one, "*"), queries.select(one, "query_id", *self.axes), {0: self.settings}, self.axes)
        return found.select("query_id", "value", "spread")


def cross_validate(points: DataFrame, assignments: DataFrame, axes: list[str], settings: Settings | None = None) -> DataFrame:
    """Out-of-fold predictions (candidate, fold_index, source_row, observed, predicted, is_nodata) of a forest. The forests of
    all folds are grown together."""
    rows = points.select("source_row", *axes, "value").join(assignments.select(F.col("fold_index").alias("problem"), "source_row", "role"), "source_row")
    held = rows.where("role = 'validation'")
    folds = [r["problem"] for r in assignments.select(F.col("fold_index").alias("problem")).distinct().collect()]
    found = predict_forests(rows.where("role = 'training'"), held.withColumnRenamed("source_row", "query_id"), dict.fromkeys(folds, settings or Settings(80)), axes)
    met = held.join(found.select("problem", F.col("query_id").alias("source_row"), F.col("value").alias("predicted")), ["problem", "source_row"], "left")
    return met.select(F.lit("forest").alias("candidate"), F.col("problem").alias("fold_index"), "source_row", F.col("value").alias("observed"), "predicted", F.col("predicted").isNull().alias("is_nodata"))


def kriging_with_forest(points: DataFrame, queries: DataFrame, model: dict, axes: list[str], folds: int = 3, k: int = 12, forest: Forest | None = None) -> DataFrame:
    """(query_id, baseline, correction, value, is_nodata): kriging from all samples and a forest's estimate of the
    residuals that kriging leaves in inner spatial folds. Either missing: NoData."""
    dimension = "3d" if "z" in axes else "2d"
    plan = validation.fold_assignments(points, dimension, folds)
    oof, _ = candidates.evaluate(points, plan, [{"name": "k", "algorithm": "kriging", "variogram": model, "k": k}], axes)
    left = oof.where("not is_nodata").join(points.select("source_row", *axes), "source_row").withColumn("residual", F.col("observed") - F.col("predicted"))
    n, total = left.count(), points.count()
    if n < LEAST_RESIDUALS or n < LEAST_COVERAGE * total:
        raise GeoError("RESIDUALS_INSUFFICIENT", residuals=n, rows=total)
    correction = (forest or Forest()).fit(left, axes, "residual").predict(queries).select("query_id", F.col("value").alias("correction"))
    base = kriging.krige(queries, points, model, k, axes=axes).select("query_id", F.col("value").alias("baseline"))
    both = base.join(correction, "query_id")
    value = F.col("baseline") + F.col("correction")
    return both.select("query_id", "baseline", "correction", value.alias("value"), value.isNull().alias("is_nodata"))
