"""Conditional evaluation: a candidate counts only if it passes every gate, and the first gate that fails is the reason.

Gates are asked one after the other and each is a plan of one row, so what stands behind a failed gate never runs.  The
out-of-fold predictions of all candidates come from one course (``candidates.evaluate``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.scalar import is_finite
from terralith.operators import candidates, metrics, neighbors, smoothing
from terralith.operators.errors import GeoError
from terralith.operators.grid import AXES, Axis, nodes

MEASURES = ("rmse", "mae", "r2", "bias")
SCHEMA = "candidate string, status string, reason string, gates int, rmse double, mae double, r2 double, bias double, coverage double, common_valid_count bigint, node_count bigint, finite_node_count bigint"


def chain(gates: list[Callable[[], str | None]]) -> tuple[str | None, int]:
    """(reason, gates asked): the reason of the first gate that gives one; later gates aren't asked."""
    for asked, gate in enumerate(gates, 1):
        reason = gate()
        if reason is not None:
            return reason, asked
    return None, len(gates)


def _fitted(candidate: dict, points: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The candidate fitted to all points, as a function of queries (query_id, x, y, z) to (query_id, value, is_nodata)."""
    p = candidates.settled(candidate["algorithm"], dict(candidate["parameters"]), "3d")
    if candidate["algorithm"] == "dsi_like":
        fitted = smoothing.fit(points.withColumn("problem", F.lit(0)), {0: p})
        smoothing.raise_failures(fitted.reports)
        return lambda q: smoothing.predict(fitted, q)
    if candidate["algorithm"] == "idw":
        return lambda q: neighbors.inverse_distance(q, points, p["neighbor_count"], p["power"], p["min_neighbors"], AXES, p["search_radius"])
    raise GeoError("ALGORITHM_UNKNOWN", algorithm=candidate["algorithm"])


def probes(low: list[float], high: list[float]) -> list[tuple]:
    """A place beyond each of the six faces of the samples' bounds, by the bounds' own width (1 if they have none)."""
    middle, out = [(a + b) / 2 for a, b in zip(low, high, strict=True)], []
    for j, (a, b) in enumerate(zip(low, high, strict=True)):
        width = b - a if b > a else 1.0
        for at in (a - width, b + width):
            out.append((len(out), *(at if i == j else m for i, m in enumerate(middle))))
    return out


def evaluate_conditionally(points: DataFrame, assignments: DataFrame, conditional: list[dict], reference: list[dict], axes: tuple[Axis, Axis, Axis]) -> DataFrame:
    """A row for each of the ``conditional`` candidates: ``status`` evaluated or excluded, the ``reason``, how many ``gates`` were asked, its metrics on the
    rows that it and all ``reference`` candidates predict (null where it is excluded before they are known), and the nodes of the grid over ``axes``.

    Gates: cross_validation (a fold fails), empty_common_valid, non_finite_metrics, materialization_fit (it can't be fitted to
    all points), materialization_nodata (a node of the grid has no finite value), materialization_outside_leak (a value beyond the bounds).
    """
    spark = points.sparkSession
    oof, failures = candidates.evaluate(points, assignments, [*reference, *conditional], AXES)
    shared = oof.where(F.col("candidate").isin(*[c["name"] for c in reference if c["name"] not in failures]) if reference else F.lit(False))
    mask = metrics.common_rows(shared) if reference else None
    every = nodes(spark, list(axes)).select(F.col("node_id").alias("query_id"), *AXES)
    out = []
    for c in conditional:
        seen: dict = {}

        def measured(c=c, seen=seen) -> str | None:
            mine = oof.where(F.col("candidate") == c["name"])
            rows = mine if mask is None else mine.join(mask, "source_row", "left_semi")
            usable = mine.agg(F.count("*").alias("rows"), F.count_if(metrics.usable()).alias("own")).first()
            found = metrics.metrics(rows).first()
            if found is None or not found["n"]:
                return "empty_common_valid"
            seen |= {k: found[k] for k in MEASURES} | {"common_valid_count": found["n"], "coverage": usable["own"] / usable["rows"]}
            return None

        def finite(seen=seen) -> str | None:
            bad = any(seen[k] is None or seen[k] != seen[k] or abs(seen[k]) == float("inf") for k in MEASURES)
            return "non_finite_metrics" if bad else None

        def fitted(c=c, seen=seen) -> str | None:
            try:
                seen["predict"] = _fitted(c, points)
            except GeoError as e:
                return f"materialization_fit:{e.code}"
            return None

        def materialized(seen=seen) -> str | None:
            good = ~F.col("is_nodata") & F.coalesce(is_finite(F.col("value")), F.lit(False))
            r = seen["predict"](every).agg(F.count("*").alias("n"), F.count_if(good).alias("good")).first()
            seen |= {"node_count": r["n"], "finite_node_count": r["good"]}
            return "materialization_nodata" if r["good"] < r["n"] else None

        def outside(seen=seen) -> str | None:
            b = points.agg(*(f(a).alias(f"{a}{i}") for a in AXES for i, f in enumerate((F.min, F.max)))).first()
            at = spark.createDataFrame(probes([b[f"{a}0"] for a in AXES], [b[f"{a}1"] for a in AXES]), "query_id bigint, x double, y double, z double")
            return "materialization_outside_leak" if seen["predict"](at).where(~F.col("is_nodata")).limit(1).count() else None

        folds = lambda c=c: f"cross_validation:{failures[c['name']]}" if c["name"] in failures else None
        reason, asked = chain([folds, measured, finite, fitted, materialized, outside])
        out.append((c["name"], "excluded" if reason else "evaluated", reason, asked, *(seen.get(k) for k in (*MEASURES, "coverage", "common_valid_count", "node_count", "finite_node_count"))))
    return spark.createDataFrame(out, SCHEMA)
