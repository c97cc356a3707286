"""Every gate of the conditional evaluation, and that nothing behind a failed gate is asked."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.operators import anomalies, conditional, grid
from terralith.operators.errors import GeoError

POINT = "source_row bigint, x double, y double, z double, value double"


def test_later_gates_are_not_asked():
    asked = []

    def gate(name, reason=None):
        def run():
            asked.append(name)
            return reason

        return run

    assert conditional.chain([gate("a"), gate("b", "stop"), gate("c")]) == ("stop", 2) and asked == ["a", "b"]
    assert conditional.chain([gate("d")]) == (None, 1) and conditional.chain([]) == (None, 0)


def test_each_gate(spark):
    rng = np.random.RandomState(3)
    p = rng.rand(80, 3) * [8, 6, 4]
    value = np.sin(p[:, 0]) + p[:, 1]
    df = spark.createDataFrame([(i, *map(float, a), float(v)) for i, (a, v) in enumerate(zip(p, value, strict=True))], POINT)
    plan = spark.createDataFrame([(f, i, int(p[i, 0]), "validation" if int(p[i, 0]) % 2 == f else "training") for i in range(80) for f in (0, 1)], "fold_index int, source_row bigint, group_key bigint, role string")
    axes = tuple(grid.axes_from_points(df, ["x", "y", "z"], 5))
    found = [
        {"name": "good", "algorithm": "dsi_like", "parameters": {}},
        {"name": "slow", "algorithm": "dsi_like", "parameters": {"max_iterations": 1, "convergence_tolerance": 1e-12}},
        {"name": "nowhere", "algorithm": "idw", "parameters": {"search_radius": 1e-9}},
        {"name": "forest", "algorithm": "random_forest", "parameters": {"n_estimators": 3}},
        {"name": "near", "algorithm": "idw", "parameters": {"search_radius": 1.6, "min_neighbors": 1}},
        {"name": "far", "algorithm": "idw", "parameters": {}},
    ]
    reference = [{"name": "reference", "algorithm": "idw", "parameters": {"power": 1.0}}]
    out = {r["candidate"]: r for r in conditional.evaluate_conditionally(df, plan, found, reference, axes).collect()}
    assert {k: (r["status"], r["reason"], r["gates"]) for k, r in out.items()} == {
        "good": ("evaluated", None, 6), "slow": ("excluded", "cross_validation:DSI_NOT_CONVERGED", 1), "nowhere": ("excluded", "empty_common_valid", 2),
        "forest": ("excluded", "materialization_fit:ALGORITHM_UNKNOWN", 4), "near": ("excluded", "materialization_nodata", 5), "far": ("excluded", "materialization_outside_leak", 6),
    }
    assert out["good"]["node_count"] == out["good"]["finite_node_count"] == 125 and out["near"]["finite_node_count"] < 125 and out["slow"]["rmse"] is None
    assert 0 < out["good"]["coverage"] < 1 and out["good"]["common_valid_count"] == round(out["good"]["coverage"] * 80) and out["far"]["rmse"] > 0


def test_missing_layers_are_failures(spark):
    g = grid.nodes(spark, [grid.Axis(0.0, 1.0, 2)] * 3).select(*grid.INDEX, "x", "y", "z", F.col("x").alias("value"), F.lit(False).alias("is_nodata"), F.lit(1.0).alias("err"))
    assert anomalies.anomaly_nodes(g, 0.5, gates={"err": 1.0}).count() == 4
    with pytest.raises(GeoError, match="ANOMALY_UNCERTAINTY_UNAVAILABLE"):
        anomalies.anomaly_nodes(g, 0.5, gates={"err": 1.0, "kriging_std": 2.0})
