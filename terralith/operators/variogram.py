"""Empirical variograms (all directions and by direction), bounded pair sampling, fits and anisotropy suggestions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.functions.scalar import in_space, variogram_shape
from terralith.operators.binning import lag_index
from terralith.operators.errors import GeoError
from terralith.operators.neighbors import place_pairs, places
from terralith.operators.shared import checkpointed, largest_remainders, numbered

MODELS = ("spherical", "exponential", "gaussian")
ANGLE_GUARD = 1e-9
FLOOR = 1e-9


def binned(pairs: DataFrame, width: float, bins: int, min_pairs: int = 30, direction: str | None = None, reach: float | None = None) -> DataFrame:
    """One row per bin: bounds, mean distance, semivariance, pairs, whether it is fit for a fit, and why not.
    ``pairs``: h, gamma; or the sums of ``neighbors.place_pairs``. Pairs beyond the last bin (or ``reach``) are left out; inner
    edges belong to the lower bin."""
    near = pairs.where(F.col("h") <= (width * bins if reach is None else reach)).groupBy(F.least(lag_index(F.col("h"), width), F.lit(bins - 1)).alias("bin"))
    if "pairs" in pairs.columns:
        found = near.agg((F.sum(F.col("h") * F.col("pairs")) / F.sum("pairs")).alias("mean_distance"), (F.sum("gamma") / F.nullif(F.sum("gammas"), F.lit(0))).alias("semivariance"), F.sum("pairs").alias("pair_count"))
    else:
        found = near.agg(F.avg("h").alias("mean_distance"), F.avg("gamma").alias("semivariance"), F.count("*").alias("pair_count"))
    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") * width).alias("lower"), ((F.col("id") + 1) * width).alias("upper"))
    out = every.join(F.broadcast(found), "bin", "left").withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))
    used = F.col("pair_count") >= min_pairs
    reason = F.lit("unsupported_direction") if direction else F.when(F.col("pair_count") == 0, "empty_bin").otherwise("insufficient_pairs")
    return out.select(F.lit(direction).alias("direction"), "bin", "lower", "upper", ((F.col("lower") + F.col("upper")) / 2).alias("center"), "mean_distance", "semivariance", "pair_count", used.alias("used_for_fit"), F.when(~used, reason).alias("exclusion_reason"))


def along(pairs: DataFrame, azimuth: float, tolerance: float, dip: float | None = None, dip_tolerance: float = 90.0) -> DataFrame:
    """Pairs whose undirected azimuth (and dip) is within the tolerance. ``pairs``: dx, dy (dz)."""
    a = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    keep = F.abs(F.pmod(a - azimuth + 90.0, F.lit(180.0)) - 90.0) <= tolerance + ANGLE_GUARD
    if dip is not None:
        length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
        slope = F.degrees(F.asin(F.least(F.lit(1.0), F.when(length > 0, F.abs("dz") / length).otherwise(0.0))))
        keep = keep & (F.abs(slope - abs(dip)) <= dip_tolerance + ANGLE_GUARD)
    return pairs.where(keep)


def directional(pairs: DataFrame, directions: list[tuple[str, float, float]], width: float, bins: int, min_pairs: int = 30) -> DataFrame:
    """All directions and each of ``directions`` (name, azimuth, tolerance)."""
    out = binned(pairs, width, bins, min_pairs)
    for name, azimuth, tolerance in directions:
        out = out.unionByName(binned(along(pairs, azimuth, tolerance), width, bins, min_pairs, name))
    return out


def sampled_pairs(points: DataFrame, most: int, seed: int = 7, oversample: int = 4, strata: int = 8, axes: list[str] | None = None) -> DataFrame:
    """(i, j, h, gamma, dx, dy[, dz], stratum): a bounded sample of pairs, even over ``strata`` quantiles of the distance.

    Pairs are drawn by their rank among all pairs (no pair table is made), at most ``oversample * most`` of them; each
    stratum gives its share by largest remainders, ties to the lower stratum. ``most`` is the method's bound.
    """
    spark, axes = points.sparkSession, axes or ["x", "y"]
    rows = numbered(points.select("source_row", *axes, "value"), ["source_row"], "_i")
    n = rows.count()
    total = n * (n - 1) // 2
    if total < 1:
        raise GeoError("VARIOGRAM_INPUT_INVALID", points=n)
    rng = np.random.default_rng(seed)
    want = min(total, most * oversample)
    ranks = np.arange(total) if total == want else np.unique(rng.integers(0, total, int(want * 1.1)))
    if len(ranks) > want:
        ranks = np.sort(rng.choice(ranks, want, replace=False))
    j = np.floor((1 + np.sqrt(1 + 8.0 * ranks)) / 2).astype(np.int64)
    j -= j * (j - 1) // 2 > ranks
    j += (j + 1) * j // 2 <= ranks
    i = ranks - j * (j - 1) // 2
    import pandas as pd

    drawn = spark.createDataFrame(pd.DataFrame({"_a": i, "_b": j, "rank": ranks}))
    side = lambda p: rows.select(F.col("_i").alias(f"_{p}"), *(F.col(c).alias(f"{p}_{c}") for c in ("source_row", *axes, "value")))
    met = drawn.join(side("a"), "_a").join(side("b"), "_b")
    d = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in (*axes, "value")}
    h = F.sqrt(sum((d[c] * d[c] for c in axes[1:]), d[axes[0]] * d[axes[0]]))
    pairs = checkpointed(met.select("rank", F.col("a_source_row").alias("i"), F.col("b_source_row").alias("j"), h.alias("h"), (0.5 * d["value"] * d["value"]).alias("gamma"), *(d[c].alias(f"d{c}") for c in axes)))
    cuts = exact_quantiles(pairs, "h", [k / strata for k in range(1, strata)])
    stratum = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    pairs = pairs.withColumn("stratum", stratum)
    sizes = {r["stratum"]: r["n"] for r in pairs.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    quota = largest_remainders(sizes, most)
    allowed = F.create_map(*(x for s, q in sorted(quota.items()) for x in (F.lit(s), F.lit(q))))
    placed = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("stratum").orderBy("rank")))
    return placed.where(F.col("_k") <= allowed[F.col("stratum")]).drop("_k", "rank")


def fit(h: np.ndarray, gamma: np.ndarray, pairs: np.ndarray, model: str, cap: float | None = None) -> dict:
    """Nugget, partial sill and range by least squares weighted with the pairs.

    For a range the other two follow in closed form (within [0, ``cap``], as a rule 4 max gamma); the range is searched in
    one dimension, on a grid and then by golden section, up to twice the span.
    """
    if model not in MODELS:
        raise GeoError("VARIOGRAM_MODEL_UNKNOWN", model=model)
    good = np.isfinite(h) & np.isfinite(gamma) & (pairs > 0)
    h, gamma, w = h[good], gamma[good], pairs[good].astype(float)
    if len(h) < 3:
        raise GeoError("VARIOGRAM_TOO_FEW_BINS", bins=len(h))
    cap, top = cap or max(4 * float(gamma.max()), 1e-6), max(2 * float(h.max()), 1e-6)

    def best(reach: float) -> tuple[float, float, float]:
        s = variogram_shape(h / reach, model, np.exp, np.where)
        tries = []
        a = np.array([[w.sum(), (w * s).sum()], [(w * s).sum(), (w * s * s).sum()]])
        b = np.array([(w * gamma).sum(), (w * s * gamma).sum()])
        if abs(np.linalg.det(a)) > 1e-12:
            tries.append(np.linalg.solve(a, b))
        for c0 in (0.0, cap):
            tries.append(np.array([c0, ((w * s * (gamma - c0)).sum()) / max((w * s * s).sum(), 1e-300)]))
        for c1 in (FLOOR, cap):
            tries.append(np.array([(w * (gamma - c1 * s)).sum() / w.sum(), c1]))
        found = []
        for c0, c1 in tries:
            c0, c1 = min(max(c0, 0.0), cap), min(max(c1, FLOOR), cap)
            found.append((float((w * (c0 + c1 * s - gamma) ** 2).sum()), float(c0), float(c1)))
        return min(found)

    grid = np.geomspace(max(top / 2000, FLOOR), top, 120)
    at = int(np.argmin([best(r)[0] for r in grid]))
    low, high = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    for _ in range(60):
        a, b = high - (high - low) * 0.6180339887498949, low + (high - low) * 0.6180339887498949
        low, high = (low, b) if best(a)[0] <= best(b)[0] else (a, high)
    reach = (low + high) / 2
    sse, nugget, sill = best(reach)
    if sill <= FLOOR or sill <= 1e-6 * (nugget + sill) or reach <= FLOOR:
        raise GeoError("VARIOGRAM_FIT_FAILED", nugget=nugget, partial_sill=sill, range=reach)
    return {"model": model, "nugget": nugget, "partial_sill": sill, "sill": nugget + sill, "range": float(reach), "weighted_sse": sse}


def fit_bins(bins: DataFrame, model: str) -> dict:
    """A fit to the bins that are fit for it. Bins are a few dozen rows."""
    rows = bins.where("used_for_fit").select("mean_distance", "semivariance", "pair_count").collect()
    h, g, n = (np.array([r[i] for r in rows], float) for i in range(3))
    return fit(h, g, n, model)


LAGS, MOST_PAIRS = 12, 50_000


def lag_bins(points: DataFrame, bins: int = LAGS, most: int | None = MOST_PAIRS, axes: list[str] | None = None) -> DataFrame:
    """(bin, center, semivariance, pair_count): lags of equal width up to the longest distance, over all pairs or, where
    these are more, a sample of ``most``; None: over all pairs, however many. Lags without a pair take the line between
    their neighbours, by lag number."""
    pairs = place_pairs(checkpointed(places(points, axes)), None, axes) if most is None else sampled_pairs(points, most, oversample=1, axes=axes)
    top = pairs.agg(F.max("h")).first()[0]
    if top is None:
        raise GeoError("VARIOGRAM_INPUT_INVALID")
    reach, top = top, top or 1.0
    rows = {r["bin"]: r for r in binned(pairs, top / bins, bins, 1, reach=reach).collect()}  # as many rows as bins
    seen = [i for i in range(bins) if rows[i]["pair_count"]]
    filled = np.interp(np.arange(bins), seen, [rows[i]["semivariance"] for i in seen])
    return points.sparkSession.createDataFrame([(i, rows[i]["center"], float(filled[i]), rows[i]["pair_count"]) for i in range(bins)], "bin int, center double, semivariance double, pair_count bigint")


def fit_points(points: DataFrame, model: str, axes: list[str] | None = None, matrix: list[list[float]] | None = None) -> dict:
    """A model fitted to ``lag_bins`` of the points, each lag with the same weight and no bound above the sill."""
    rows = lag_bins(in_space(points, axes or ["x", "y"], matrix), axes=axes).orderBy("bin").collect()
    g = np.array([r["semivariance"] for r in rows])
    return fit(np.array([r["center"] for r in rows]), g, np.ones(len(rows)), model, cap=1e6 * max(float(g.max()), 1e-6))


def check_manual(model: str, nugget: float, sill: float, reach: float) -> dict:
    """A model whose values were set by hand; ``sill`` is the whole one."""
    if model not in MODELS or not all(math.isfinite(v) for v in (nugget, sill, reach)) or nugget < 0 or sill <= nugget or reach <= 0:
        raise GeoError("VARIOGRAM_FIT_FAILED", model=model, nugget=nugget, sill=sill, range=reach)
    return {"model": model, "nugget": float(nugget), "partial_sill": float(sill - nugget), "sill": float(sill), "range": float(reach)}


def diagnose(pairs: DataFrame, directions: list[dict], width: float, bins: int, min_pairs: int = 30, dimension: str = "2d") -> dict:
    """The whole diagnosis over sampled pairs: the bins and the three fits of all directions together, the best fit of each
    direction (none where too few bins have pairs enough), and the anisotropy that these suggest. ``directions``: a
    configured handful of {"id", "azimuth", "tolerance"[, "dip", "dip_tolerance"]}."""
    every = checkpointed(binned(pairs, width, bins, min_pairs))
    fits = []
    for m in MODELS:
        try:
            fits.append(fit_bins(every, m))
        except GeoError as e:
            fits.append({"model": m, "failed": str(e)})
    found, tables = [], every
    for d in directions:
        part = checkpointed(binned(along(pairs, d["azimuth"], d["tolerance"], d.get("dip"), d.get("dip_tolerance", 90.0)), width, bins, min_pairs, d["id"]))
        try:
            best = best_fit(part)
        except GeoError:
            best = {"range": None}
        found.append({"id": d["id"], "azimuth": d["azimuth"], "dip": d.get("dip"), "range": best["range"], "bound": range_bound(part), "pairs": used_pairs(part)})
        tables = tables.unionByName(part)
    return {"bins": tables, "fits": fits, "directions": found, "suggestion": suggest_anisotropy(found, dimension)}


def range_bound(bins: DataFrame) -> float:
    """The longest range that a fit to these bins may have."""
    return max(2 * float(bins.where("used_for_fit").agg(F.max("mean_distance")).first()[0] or 0.0), 1e-6)


def used_pairs(bins: DataFrame) -> int:
    return int(bins.where("used_for_fit").agg(F.sum("pair_count")).first()[0] or 0)


def best_fit(bins: DataFrame) -> dict:
    """The model with the smallest weighted error; on ties the first."""
    found = []
    for m in MODELS:
        try:
            found.append(fit_bins(bins, m))
        except GeoError:
            continue
    if not found:
        raise GeoError("VARIOGRAM_FIT_FAILED")
    return min(found, key=lambda f: f["weighted_sse"])


# Fixed values of the suggestion: how many candidates, the dip from which a direction is vertical, the ratio under which
# ranges hardly differ, how near to its bound a range counts as at it, and the names of the warnings.
MOST_CANDIDATES, VERTICAL_DIP, WEAK_RATIO, AT_BOUND = 3, 45.0, 1.25, 1e-9
NO_DIRECTION, ONE_DIRECTION, NO_VERTICAL, AT_UPPER_BOUND, WEAK_CONTRAST = "no_supported_direction", "single_supported_direction", "vertical_direction_unsupported", "range_at_disclosed_upper_bound", "weak_range_contrast"


def suggest_anisotropy(directions: list[dict], dimension: str = "2d") -> dict:
    """Up to three candidates from fitted directions, a configured handful: {"candidates", "compared", "skipped",
    "warnings"}.

    A direction is {"id", "azimuth", "dip" (or none), "range", "bound", "pairs"}; ``range`` is None where it had too few
    pairs. Candidates follow the longest range (then the id). Each is held against the level direction nearest to a right
    angle to it (then the shorter range, then the id) and, in 3-D, against the steepest vertical one; ratios are its range
    by theirs.
    """
    fitted = [d for d in directions if d.get("range") is not None]
    out = {"candidates": [], "compared": [d["id"] for d in fitted], "skipped": [d["id"] for d in directions if d.get("range") is None], "warnings": [] if fitted else [NO_DIRECTION]}
    dip = lambda d: abs(d.get("dip") or 0.0)
    off = lambda d, a: abs((d["azimuth"] - a) % 180.0 - 90.0)  # noqa: E731  from a right angle to a
    for major in sorted(fitted, key=lambda d: (-d["range"], d["id"]))[:MOST_CANDIDATES]:
        rest = [d for d in fitted if d is not major]
        level = sorted((d for d in rest if dip(d) < VERTICAL_DIP), key=lambda d: (off(d, major["azimuth"]), d["range"], d["id"]))[:1]
        steep = sorted((d for d in rest if dip(d) >= VERTICAL_DIP), key=lambda d: (-dip(d), d["id"]))[:1] if dimension == "3d" else []
        used, ratios = [major, *level, *steep], [major["range"] / d["range"] for d in (*level, *steep)]
        said = {ONE_DIRECTION: len(fitted) == 1, NO_VERTICAL: dimension == "3d" and not steep, AT_UPPER_BOUND: any(d["range"] >= d["bound"] * (1 - AT_BOUND) for d in used), WEAK_CONTRAST: bool(ratios) and max(ratios) < WEAK_RATIO}
        first = lambda part, key: part[0][key] if part else None
        out["candidates"].append({
            "rank": len(out["candidates"]) + 1, "major": major["id"], "azimuth": float(major["azimuth"]), "range": major["range"],
            "secondary": first(level, "id"), "secondary_range": first(level, "range"), "vertical": first(steep, "id"), "vertical_range": first(steep, "range"),
            "minor_ratio": major["range"] / level[0]["range"] if level else None, "vertical_ratio": major["range"] / steep[0]["range"] if steep else None,
            "pairs": sum(d["pairs"] for d in used), "warnings": [w for w, there in said.items() if there],
        })
    return out
