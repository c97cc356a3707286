"""Ordinary kriging: neighbours by a Spark join, systems solved in batches inside tasks.

The neighbour join leaves a few rows per target, dealt over tasks by a hash of the target; a task stacks the targets
with equal numbers of neighbours and solves them together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.scalar import in_space, variogram_shape
from terralith.operators import neighbors
from terralith.operators.errors import GeoError

CLAMP = 1e-10
TARGETS_PER_TASK = 20_000


def gamma(h: np.ndarray, model: dict) -> np.ndarray:
    return model["nugget"] + model["partial_sill"] * variogram_shape(h / model["range"], model["model"], np.exp, np.where)


def check_model(model: dict) -> None:
    if model["model"] not in ("spherical", "exponential", "gaussian"):
        raise GeoError("VARIOGRAM_MODEL_UNKNOWN", model=model["model"])
    if not (model["nugget"] >= 0 and model["partial_sill"] > 0 and model["range"] > 0 and math.isfinite(model["nugget"] + model["partial_sill"])):
        raise GeoError("VARIOGRAM_PARAMETERS_INVALID", **model)


def solve(places: np.ndarray, values: np.ndarray, targets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances (NaN where invalid) of m targets with n neighbours each: places m x n x d. Weights add up
    to 1; singular systems fall back to least squares; variances just under 0 become 0."""
    m, n, _ = places.shape
    a = np.ones((m, n + 1, n + 1))
    a[:, :n, :n] = gamma(np.linalg.norm(places[:, :, None] - places[:, None], axis=3), model)
    a[:, n, n] = 0.0
    b = np.ones((m, n + 1))
    b[:, :n] = gamma(np.linalg.norm(places - targets[:, None], axis=2), model)
    try:
        x = np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        x = np.stack([np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(a, b, strict=True)])
    variance = (x[:, :n] * b[:, :n]).sum(axis=1) + x[:, n]
    variance = np.where((variance < 0) & (variance >= -CLAMP), 0.0, variance)
    estimate = (x[:, :n] * values).sum(axis=1)
    bad = ~np.isfinite(variance) | (variance < 0) | ~np.isfinite(estimate)
    return np.where(bad, np.nan, estimate), np.where(bad, np.nan, variance)


def krige(queries: DataFrame, samples: DataFrame, model: dict, k: int = 12, min_neighbors: int = 3, axes: list[str] | None = None, near: DataFrame | None = None, matrix: list[list[float]] | None = None, radius: float | None = None) -> DataFrame:
    """(query_id, value, variance, n, is_nodata). ``near``: neighbours from another operator (query_id, source_row), for
    sector neighbourhoods. ``matrix``: the space in which distances count, for neighbours and model alike."""
    check_model(model)
    axes = axes or ["x", "y"]
    queries, samples = in_space(queries.select("query_id", *axes), axes, matrix), in_space(samples, axes, matrix)
    near = near if near is not None else neighbors.nearest(queries, samples, k, axes, radius)
    met = near.select("query_id", "source_row").join(samples.select("source_row", *axes, "value"), "source_row").join(queries.select("query_id", *(F.col(a).alias(f"q_{a}") for a in axes)), "query_id")
    tasks = max(1, -(-queries.count() // TARGETS_PER_TASK))
    cols = [*axes, "value", *(f"q_{a}" for a in axes)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["query_id", "source_row"])
        ids, start, count = np.unique(group["query_id"].to_numpy(), return_index=True, return_counts=True)
        data = group[cols].to_numpy(float)
        value, variance = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
        for n in np.unique(count[count >= min_neighbors]):
            at = np.flatnonzero(count == n)
            for part in np.array_split(at, max(1, len(at) * int(n) ** 2 // 4_000_000)):
                rows = data[start[part][:, None] + np.arange(n)]
                d = len(axes)
                value[part], variance[part] = solve(rows[:, :, :d], rows[:, :, d], rows[:, 0, d + 1 :], model)
        return pd.DataFrame({"query_id": ids, "value": value, "variance": variance, "n": count})

    found = met.withColumn("_t", F.pmod(F.xxhash64("query_id"), F.lit(tasks))).groupBy("_t").applyInPandas(run, "query_id bigint, value double, variance double, n bigint")
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    out = queries.select("query_id").join(found, "query_id", "left").select("query_id", clean("value").alias("value"), clean("variance").alias("variance"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("is_nodata", F.col("value").isNull())
