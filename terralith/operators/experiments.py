"""Experiments: search spaces, runs over spatial folds, fingerprints, gates, presets and confirmed anisotropy."""

from __future__ import annotations

import hashlib
import json
import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators import candidates, metrics, validation
from terralith.operators.errors import GeoError
from terralith.operators.shared import numbered

BLOCK = 10_000  # rows that one hash covers

# The capabilities in their order, and what each algorithm supports of them.
CAPABILITIES = [
    "empirical_variogram", "model_anisotropy", "z_scale_weight_distance", "search_neighborhood", "sector_neighbor_limits", "native_kriging_std",
    "spatial_fold_inspection", "empirical_error_scale", "anomaly_extraction", "candidate_comparison",
]
SUPPORTED = {
    "idw": ["z_scale_weight_distance", "search_neighborhood", "sector_neighbor_limits", "spatial_fold_inspection", "empirical_error_scale", "anomaly_extraction", "candidate_comparison"],
    "ordinary_kriging": CAPABILITIES,
    "dsi_like": ["spatial_fold_inspection", "empirical_error_scale", "anomaly_extraction", "candidate_comparison"],
}
LEARNED = ("random_forest", "kriging_rf_residual")

# The official candidates of each preset case, in their order.
PRESETS = {
    "resistivity": [("idw", {"power": [2.0], "neighbor_count": [24]}), ("ordinary_kriging", {"variogram_model": ["spherical", "exponential"], "neighbor_count": [16, 24]}), ("dsi_like", {"neighbor_connectivity": [6, 26]})],
    "microseismic": [("ordinary_kriging", {"variogram_model": ["spherical", "exponential", "gaussian"], "neighbor_count": [12, 24, 36], "z_scale": [0.5, 1.0, 2.0]})],
    "gas": [("idw", {"power": [1.5, 2.0, 3.0], "neighbor_count": [16, 24, 32]}), ("ordinary_kriging", {"variogram_model": ["spherical", "exponential"], "neighbor_count": [16, 24]})],
}


def capabilities(points: DataFrame) -> DataFrame:
    """(algorithm, capability, state, samples): supported or not_applicable, and the samples that an algorithm can be asked
    about; smooth interpolation is asked about samples with a depth only."""
    rows = [(a, f, "supported" if f in own else "not_applicable") for a, own in SUPPORTED.items() for f in CAPABILITIES]
    good = F.col("is_numeric_valid")
    n = points.agg(F.count_if(good).alias("all"), F.count_if(good & F.col("z").isNotNull()).alias("deep"))
    every = points.sparkSession.createDataFrame(rows, "algorithm string, capability string, state string").join(F.broadcast(n))  # one row
    return every.select("algorithm", "capability", "state", F.when(F.col("algorithm") == "dsi_like", F.col("deep")).otherwise(F.col("all")).alias("samples"))


def canonical(payload: dict) -> str:
    return json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(**payload) -> str:
    """SHA-256 of the canonical text of a small configuration."""
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def rows_fingerprint(df: DataFrame, order: list[str]) -> str:
    """SHA-256 of all rows in an order: blocks of BLOCK rows are hashed, then blocks of these hashes, until one is left.
    No task holds more than a block."""
    text = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    rows = numbered(df.select(*order, text.alias("_h")), [*order, "_h"], "_i").select("_i", "_h")
    while True:
        block = rows.groupBy(F.floor(F.col("_i") / BLOCK).alias("_i")).agg(F.array_sort(F.collect_list(F.struct("_i", "_h"))).alias("l"))
        rows = block.select("_i", F.sha2(F.array_join(F.transform("l", lambda s: s["_h"]), ","), 256).alias("_h"))
        top = rows.limit(2).collect()
        if len(top) < 2:
            return top[0]["_h"] if top else hashlib.sha256(b"").hexdigest()


def plan_fingerprint(assignments: DataFrame, dataset_fingerprint: str, contract: dict) -> str:
    """The identity of a fold plan: the data, the contract and every assignment."""
    rows = rows_fingerprint(assignments.select("fold_index", "source_row", "group_key", "role"), ["fold_index", "source_row"])
    return fingerprint(dataset=dataset_fingerprint, validation=contract, assignments=rows)


def preset_candidates(case: str) -> list[dict]:
    return [{"algorithm": a, "parameters": dict(zip(space, values, strict=True))} for a, space in PRESETS[case] for values in product(*space.values())]


def definitions(algorithm: str, base: dict, space: dict[str, list], mode: str = "grid", contract: dict | None = None) -> list[dict]:
    """The candidates of a search, numbered and named by their fingerprints."""
    out = []
    for i, chosen in enumerate(validation.expand_search(space, mode)):
        parameters = base | chosen
        out.append({"index": i, "algorithm": algorithm, "parameters": parameters, "fingerprint": fingerprint(algorithm=algorithm, parameters=parameters, validation=contract)})
    return out


def run(points: DataFrame, assignments: DataFrame, found: list[dict], axes: list[str] | None = None) -> DataFrame:
    """(candidate, n, mae, rmse, r2, bias, coverage, status, error, rank): every candidate over all folds, measured on the
    rows that all successful ones predict. Candidates fail alone, with an error; without any valid prediction it is
    NO_VALID_PREDICTION. The best one has rank 1."""
    oof, failures = candidates.evaluate(points, assignments, found, axes)
    good = oof.groupBy("candidate").agg(F.count_if(metrics.usable()).alias("n_own"))
    kept = oof.join(good.where("n_own > 0").select("candidate"), "candidate", "left_semi")
    scored = metrics.ranking(metrics.metrics(kept)).select("candidate", "n", "mae", "rmse", "r2", "bias", "coverage", "rank")
    asked = points.sparkSession.createDataFrame([(c["name"], failures.get(c["name"])) for c in found], "candidate string, error string")
    error = F.coalesce("error", F.when(F.coalesce("n_own", F.lit(0)) == 0, "NO_VALID_PREDICTION"))
    every = asked.join(good, "candidate", "left").select("candidate", error.alias("error")).join(scored, "candidate", "left")
    return every.select("candidate", F.coalesce("n", F.lit(0)).alias("n"), "mae", "rmse", "r2", "bias", "coverage", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error", "rank")


def check_learned(points: DataFrame, dimension: str, algorithm: str, confirmed: bool) -> None:
    """The gate of the learning algorithms by samples and spatial groups."""
    if algorithm not in LEARNED:
        return
    s = validation.ml_suitability(points, dimension).first()
    if s["level"] == "not_recommended" or (algorithm == "kriging_rf_residual" and s["level"] != "supported"):
        raise GeoError("ML_DATASET_TOO_SMALL", samples=s["samples"], groups=s["groups"])
    if s["level"] == "experimental" and not confirmed:
        raise GeoError("ML_EXPERIMENTAL_CONFIRMATION_REQUIRED", samples=s["samples"], groups=s["groups"])


def check_dimension(algorithm: str, dimension: str) -> None:
    if algorithm == "dsi_like" and dimension != "3d":
        raise GeoError("ALGORITHM_DIMENSION_MISMATCH", algorithm=algorithm, dimension=dimension)


def with_professional(algorithm: str, parameters: dict, professional: dict | None) -> dict:
    """A candidate's parameters with the confirmed search neighbourhood, and for kriging the confirmed model: its values if
    they were set by hand, else a fit in each fold; and the confirmed anisotropy."""
    if professional is None:
        return parameters
    out = parameters | {k: professional[k] for k in ("neighborhood",) if professional.get(k) is not None}
    if algorithm != "ordinary_kriging" or not professional.get("confirmation_id"):
        return out
    by_hand = professional.get("parameter_strategy") == "manual"
    out = {k: v for k, v in out.items() if by_hand or k not in ("nugget", "sill", "range")}
    out |= {"variogram_model": professional["model"], "variogram_mode": "manual" if by_hand else "auto"} | (professional["manual_parameters"] if by_hand else {})
    return out | ({"anisotropy": professional["anisotropy"]} if professional.get("anisotropy") is not None else {})


def confirmed_anisotropy(choice: dict, dimension: str) -> dict:
    """Angles and scales from a confirmed choice: the main direction keeps its scale, the others are one by their ratio."""
    def number(key: str, default: float | None = None, positive: bool = False) -> float:
        v = default if choice.get(key) is None else choice[key]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or (positive and v <= 0):
            raise GeoError("PROFESSIONAL_CONFIG_INVALID", parameter=key)
        return float(v)

    plain = bool(choice.get("keep_isotropic"))
    out = {"azimuth": 0.0 if plain else number("azimuth_deg"), "major_scale": 1.0, "minor_scale": 1.0 if plain else 1 / number("major_minor_ratio", positive=True)}
    if dimension == "3d":
        out |= {"dip": 0.0 if plain else number("dip_deg", 0.0), "roll": 0.0 if plain else number("roll_deg", 0.0), "vertical_scale": 1.0 if plain else 1 / number("major_vertical_ratio", 1.0, True)}
    return out
