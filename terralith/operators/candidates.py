"""All candidates of an experiment over all folds in one course.

Candidates are rows of a plan, folds a join key.  Samples are held in *sets*, one for each space in which distances count (and
one for each outer fold of a forest on kriging residuals); a share of a set, as a rule the fold that a row is held out
with, isn't seen by the queries of that share.  One neighbour search covers all sets with the most neighbours that any
candidate asks for; inverse distances are one grouping, kriging systems one grouped solve, variograms are fitted from one
sample of pairs for each set; smooth fields are settled side by side (``smoothing``), forests grown together (``forests``).
The number of Spark jobs doesn't depend on the number of candidates.  Rows of one share at one place get the same answer: the
place is asked about once, by the name of its least row, so that the work of a search follows the places, not the rows.

A candidate that fails, by its parameters, its fit, a gate or a system, is recorded with its error and leaves the others alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.scalar import affine, distance, space
from terralith.operators import forests, neighbors, smoothing, variogram
from terralith.operators.errors import GeoError
from terralith.operators.grouped_neighbors import nearest_by
from terralith.operators.kriging import TARGETS_PER_TASK, solve
from terralith.operators.shared import checkpointed, numbered

NOBODY = -1

# Parameters of each algorithm and what they are if a candidate doesn't say.
_SEARCH = {"neighbor_count": 16, "search_radius": None, "min_neighbors": 3, "z_scale": 1.0, "neighborhood": None}
_FOREST = {"n_estimators": 160, "max_depth": 18, "min_samples_leaf": 2, "max_features": 0.8, "random_state": 20260813}
DEFAULTS = {
    "idw": {"power": 2.0} | _SEARCH,
    "ordinary_kriging": {"variogram_model": "spherical", "variogram_mode": "auto", "nugget": None, "sill": None, "range": None} | _SEARCH | {"neighbor_count": 24, "min_neighbors": 4, "anisotropy": None},
    "dsi_like": {"init_power": 2.0, "neighbor_connectivity": 6, "smoothing_strength": 0.5, "max_iterations": 200, "convergence_tolerance": 1e-4},
    "random_forest": _FOREST,
    "kriging_rf_residual": {"kriging": {}, "random_forest": {}, "inner_folds": 3, "min_oof_residuals": 30, "min_oof_coverage": 0.8, "inner_seed": 20260813},
}
SAME = {"kriging": "ordinary_kriging", "random_forest_spatial": "random_forest"}


@dataclass
class _Task:
    """An inverse-distance or kriging candidate on a set."""

    name: str
    number: int
    kind: str
    set: int
    search: int
    parameters: dict
    models: dict[int, dict] = field(default_factory=dict)  # by share


def settled(algorithm: str, parameters: dict, dimension: str) -> dict:
    """A candidate's parameters with the defaults; GeoError where one is unknown or out of its range."""
    known = DEFAULTS.get(algorithm)
    if known is None:
        raise GeoError("ALGORITHM_UNKNOWN", algorithm=algorithm)
    odd = sorted(set(parameters) - set(known))
    if odd:
        raise GeoError("PARAMETER_UNKNOWN", algorithm=algorithm, parameters=odd)
    p = known | parameters
    number = lambda k, low, high: not isinstance(p[k], bool) and isinstance(p[k], (int, float)) and low <= p[k] <= high
    ranges = {  # fixed values
        "idw": {"power": (1e-9, 8), "neighbor_count": (1, 128), "min_neighbors": (1, 32), "z_scale": (1e-9, 20)},
        "ordinary_kriging": {"neighbor_count": (1, 128), "min_neighbors": (1, 32), "z_scale": (1e-9, 20)},
        "dsi_like": {"init_power": (1e-9, 8), "smoothing_strength": (1e-9, 1), "max_iterations": (1, 10_000), "convergence_tolerance": (1e-15, 1)},
        "random_forest": {"n_estimators": (1, 400), "max_depth": (1, 40), "min_samples_leaf": (1, 20), "max_features": (0.01, 1)},
        "kriging_rf_residual": {"inner_folds": (2, 5), "min_oof_residuals": (1, 10_000), "min_oof_coverage": (0.01, 1)},
    }[algorithm]
    wrong = [k for k, (low, high) in ranges.items() if not number(k, low, high)]
    if algorithm in ("idw", "ordinary_kriging") and (p["z_scale"] != 1 and (dimension != "3d" or p.get("anisotropy") is not None)):
        wrong.append("z_scale")
    if algorithm == "dsi_like" and p["neighbor_connectivity"] not in (6, 18, 26):
        wrong.append("neighbor_connectivity")
    if wrong:
        raise GeoError("PARAMETER_INVALID", algorithm=algorithm, parameters=wrong)
    if algorithm == "dsi_like" and dimension != "3d":
        raise GeoError("ALGORITHM_DIMENSION_MISMATCH", algorithm=algorithm, dimension=dimension)
    if algorithm == "ordinary_kriging":
        if p["variogram_model"] not in variogram.MODELS:
            raise GeoError("VARIOGRAM_MODEL_UNKNOWN", model=p["variogram_model"])
        if p["variogram_mode"] == "manual":
            if any(p[k] is None for k in ("nugget", "sill", "range")):
                raise GeoError("PARAMETER_INVALID", algorithm=algorithm, parameters=["nugget", "sill", "range"])
            variogram.check_manual(p["variogram_model"], p["nugget"], p["sill"], p["range"])
    if algorithm == "kriging_rf_residual":
        p = p | {"kriging": settled("ordinary_kriging", p["kriging"], dimension), "random_forest": settled("random_forest", p["random_forest"], dimension)}
    return p


def _matrix(p: dict, dimension: str) -> list[list[float]] | None:
    if p.get("anisotropy"):
        spec = {k.removesuffix("_deg"): v for k, v in p["anisotropy"].items() if k != "dimension" and v is not None}
        return space(spec, dimension)
    return space({"z_scale": p["z_scale"]}, dimension) if p["z_scale"] != 1 else None


def _placed(df: DataFrame, sets: dict[int, list | None], axes: list[str]) -> DataFrame:
    """``df`` once for each set that is a space, with its axes in that space."""
    images = F.array(*(F.struct(F.lit(k).alias("set"), *(c.cast("double").alias(a) for a, c in zip(axes, affine([F.col(a) for a in axes], m) if m else [F.col(a) for a in axes], strict=True))) for k, m in sorted(sets.items())))
    return df.withColumn("_p", F.explode(images)).select(*(c for c in df.columns if c not in axes), "_p.*")


def _asked(rows: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """(keys, axes, query_id): each place of ``rows`` once, by the name of its least row."""
    return checkpointed(rows.groupBy(*keys, *axes).agg(F.min("source_row").alias("query_id")))


def _fits(samples: DataFrame, wanted: dict[int, set[str]], shares: dict[int, list[int]], axes: list[str]) -> dict[tuple[int, int, str], dict | GeoError]:
    """Models fitted to each set without each share: LAGS lags of equal width over all pairs, or where these are more a
    sample of about MOST_PAIRS. ``samples``: set, source_row, axes, value, share."""
    if not wanted:
        return {}
    rows = numbered(samples.where(F.col("set").isin(*wanted)).select("set", "source_row", *axes, "value", "share"), ["set", "source_row"], "_i")
    spans = {r["set"]: (r["first"], r["n"]) for r in rows.groupBy("set").agg(F.min("_i").alias("first"), F.count("*").alias("n")).collect()}
    drawn = []
    for k, (first, n) in sorted(spans.items()):
        total = n * (n - 1) // 2
        want = min(total, int(variogram.MOST_PAIRS * (1.0 if len(shares[k]) < 2 else (1 - 1 / len(shares[k])) ** -2 * 1.05)))
        ranks = np.arange(total) if want == total else np.unique(np.random.default_rng(7 + k).integers(0, total, int(want * 1.02)))
        j = np.floor((1 + np.sqrt(1 + 8.0 * ranks)) / 2).astype(np.int64)
        j -= j * (j - 1) // 2 > ranks
        j += (j + 1) * j // 2 <= ranks
        drawn.append(pd.DataFrame({"_a": first + ranks - j * (j - 1) // 2, "_b": first + j}))
    pairs = samples.sparkSession.createDataFrame(pd.concat(drawn))  # a bounded sample for each set
    side = lambda s: rows.select(F.col("_i").alias(f"_{s}"), F.col("set").alias(f"{s}_set"), *(F.col(c).alias(f"{s}_{c}") for c in (*axes, "value", "share")))
    met = pairs.join(side("a"), "_a").join(side("b"), "_b")
    d = F.col("b_value") - F.col("a_value")
    met = checkpointed(met.select(F.col("a_set").alias("set"), distance([F.col(f"b_{a}") for a in axes], [F.col(f"a_{a}") for a in axes]).alias("h"), (0.5 * d * d).alias("gamma"), "a_share", "b_share"))
    cases = samples.sparkSession.createDataFrame([(k, s) for k in spans for s in (shares[k] or [NOBODY])], "set int, without int")
    seen = met.join(F.broadcast(cases), "set").where("a_share <> without and b_share <> without")  # as many cases as sets and shares
    top = seen.groupBy("set", "without").agg(F.max("h").alias("top")).withColumn("width", F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) / variogram.LAGS)
    lag = F.greatest(F.lit(0), F.least(F.lit(variogram.LAGS - 1), F.ceil(F.col("h") / F.col("width")) - 1)).cast("int")
    bins = seen.join(F.broadcast(top), ["set", "without"]).groupBy("set", "without", "width", lag.alias("bin")).agg(F.avg("gamma").alias("g")).collect()
    found: dict[tuple[int, int], dict[int, float]] = {}
    width = {}
    for r in bins:
        found.setdefault((r["set"], r["without"]), {})[int(r["bin"])] = r["g"]
        width[r["set"], r["without"]] = r["width"]
    out: dict[tuple[int, int, str], dict | GeoError] = {}
    for k, models in wanted.items():
        for share in shares.get(k) or [NOBODY]:
            for model in models:
                held = found.get((k, share))
                try:
                    if not held:
                        raise GeoError("VARIOGRAM_INPUT_INVALID", set=k)
                    lags = np.arange(variogram.LAGS)
                    g = np.interp(lags, sorted(held), [held[b] for b in sorted(held)])
                    out[k, share, model] = variogram.fit((lags + 0.5) * width[k, share], g, np.ones(len(lags)), model, cap=1e6 * max(float(g.max()), 1e-6))
                except GeoError as e:
                    out[k, share, model] = e
    return out


def _solved(near: DataFrame, samples: DataFrame, queries: DataFrame, tasks: list[_Task], axes: list[str]) -> DataFrame:
    """(number, query_id, value, error) of all kriging tasks: neighbours (search, set, query_id, source_row, k, d) with their places, dealt
    by a hash of the query."""
    places = samples.select("set", "source_row", *axes, "value")
    asked = queries.select("set", "query_id", F.col("share").alias("q_share"), *(F.col(a).alias(f"q_{a}") for a in axes))
    met = near.select("search", "set", "query_id", "source_row", "k", "d").join(places, ["set", "source_row"]).join(asked, ["set", "query_id"])
    parts = max(1, -(-queries.count() // TARGETS_PER_TASK))
    cols = [*axes, "value", *(f"q_{a}" for a in axes)]
    by_search: dict[int, list[_Task]] = {}
    for t in tasks:
        by_search.setdefault(t.search, []).append(t)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for search, part in group.groupby("search"):
            part = part.sort_values(["query_id", "k"])
            for t in by_search.get(int(search), []):
                mine = part[(part["k"] <= t.parameters["neighbor_count"]) & (part["d"] < (t.parameters["search_radius"] or math.inf))]
                ids, start, count = np.unique(mine["query_id"].to_numpy(), return_index=True, return_counts=True)
                data, share = mine[cols].to_numpy(float), mine["q_share"].to_numpy()
                value, error = np.full(len(ids), np.nan), np.full(len(ids), None, object)
                for s in np.unique(share[start]) if len(start) else []:
                    try:
                        for n in np.unique(count[(share[start] == s) & (count >= t.parameters["min_neighbors"])]):
                            at = np.flatnonzero((count == n) & (share[start] == s))
                            for chunk in np.array_split(at, max(1, len(at) * int(n) ** 2 // 4_000_000)):
                                rows = data[start[chunk][:, None] + np.arange(n)]
                                k = len(axes)
                                value[chunk] = solve(rows[:, :, :k], rows[:, :, k], rows[:, 0, k + 1 :], t.models[int(s)])[0]
                    except Exception as e:  # noqa: BLE001  one candidate's trouble is recorded as its own
                        error[share[start] == s] = f"SYSTEM_FAILED {type(e).__name__}"
                out.append(pd.DataFrame({"number": t.number, "query_id": ids, "value": value, "error": error}))
        return pd.concat(out) if out else pd.DataFrame({"number": [], "query_id": [], "value": [], "error": []})

    return met.withColumn("_t", F.pmod(F.xxhash64("query_id"), F.lit(parts))).groupBy("_t").applyInPandas(run, "number int, query_id bigint, value double, error string")


def _weighted(near: DataFrame, tasks: list[_Task]) -> DataFrame:
    """(number, query_id, value) of all inverse-distance tasks: one grouping."""
    rows = near.sparkSession.createDataFrame([(t.number, t.search, float(t.parameters["power"]), t.parameters["neighbor_count"], t.parameters["search_radius"], t.parameters["min_neighbors"]) for t in tasks], "number int, search int, power double, most int, reach double, least int")
    met = near.join(F.broadcast(rows), "search").where("k <= most and (reach is null or d < reach)")  # a row for each candidate
    at = F.min(F.when(F.col("d") <= neighbors.EXACT, F.struct("d", "source_row", "value")))
    found = met.groupBy("number", "least", "query_id").agg(F.count("*").alias("n"), at.alias("at"), neighbors.weighted_mean(F.col("power")).alias("mean"))
    return found.select("number", "query_id", F.when(F.col("n") >= F.col("least"), F.coalesce("at.value", "mean")).alias("value"))


def _distances(near: DataFrame, samples: DataFrame, queries: DataFrame, axes: list[str]) -> DataFrame:
    """Neighbours from sectors (set, query_id, source_row, k) with their values and their distances in the set's space."""
    met = near.join(samples.select("set", "source_row", *axes, "value"), ["set", "source_row"]).join(queries.select("set", "query_id", *(F.col(a).alias(f"q_{a}") for a in axes)), ["set", "query_id"])
    return met.select("search", "set", "query_id", "source_row", "value", distance([F.col(f"q_{a}") for a in axes], [F.col(a) for a in axes]).alias("d"), "k")


def _predict(samples: DataFrame, queries: DataFrame, tasks: list[_Task], shares: dict[int, list[int]], axes: list[str], failures: dict[str, str], sectors: dict[int, tuple[int, dict]]) -> DataFrame | None:
    """(number, query_id, value) of all tasks; ``samples``: set, source_row, axes, value, share; ``queries``: set, query_id, axes,
    share. ``sectors``: searches by sector neighbourhoods (set, specification) in plain space."""
    wanted: dict[int, set[str]] = {}
    for t in tasks:
        if t.kind == "ordinary_kriging" and t.parameters["variogram_mode"] == "auto":
            wanted.setdefault(t.set, set()).add(t.parameters["variogram_model"])
    fits = _fits(samples, wanted, shares, axes)
    for t in tasks:
        for share in (shares.get(t.set) or [NOBODY]) if t.kind == "ordinary_kriging" else []:
            p = t.parameters
            model = fits[t.set, share, p["variogram_model"]] if p["variogram_mode"] == "auto" else variogram.check_manual(p["variogram_model"], p["nugget"], p["sill"], p["range"])
            if isinstance(model, GeoError):
                failures[t.name] = model.code
            t.models[share] = model
    tasks = [t for t in tasks if t.name not in failures]
    if not tasks:
        return None
    plain = sorted({t.set for t in tasks if t.search not in sectors})
    near = None
    if plain:
        most = max(t.parameters["neighbor_count"] for t in tasks if t.search not in sectors)
        near = nearest_by(queries.where(F.col("set").isin(*plain)), samples.where(F.col("set").isin(*plain)), most, "set", axes, "share").withColumn("search", F.col("set"))
    for search, (base, spec) in sectors.items():
        if not any(t.search == search for t in tasks):
            continue
        s, q = samples.where(F.col("set") == base), queries.where(F.col("set") == base)
        sets = sorted({t.set for t in tasks if t.search == search})
        found = neighbors.sector_neighbors(q, s, tuple(spec["radii"]), spec.get("azimuth_deg", 0.0), spec.get("sector_count", 4), spec.get("max_per_sector", 8), spec.get("min_neighbors", 3), spec.get("max_neighbors", 24), True, spec.get("dip_deg") or 0.0, spec.get("roll_deg") or 0.0, "share")
        found = found.select(F.lit(search).alias("search"), F.explode(F.array(*map(F.lit, sets))).alias("set"), "query_id", "source_row", "k")
        part = _distances(found, samples, queries, axes)
        near = part if near is None else near.unionByName(part)
    near = checkpointed(near)
    out = None
    weighted, kriged = [t for t in tasks if t.kind == "idw"], [t for t in tasks if t.kind != "idw"]
    if weighted:
        out = _weighted(near, weighted).withColumn("error", F.lit(None).cast("string"))
    if kriged:
        part = _solved(near, samples, queries, kriged, axes)
        out = part if out is None else out.unionByName(part)
    out = checkpointed(out)
    names = {t.number: t.name for t in tasks}
    for r in out.where("error is not null").groupBy("number").agg(F.min("error").alias("error")).collect():  # a row for each candidate
        failures[names[r["number"]]] = r["error"]
    return out.select("number", "query_id", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def _key(value) -> str:
    return json.dumps(value, sort_keys=True)


def _renamed(candidate: dict, dimension: str) -> tuple[str, dict]:
    """(algorithm, parameters) of a candidate, given as {"algorithm", "parameters"} or in the short form of one level."""
    algorithm = SAME.get(candidate["algorithm"], candidate["algorithm"])
    if "parameters" in candidate:
        return algorithm, dict(candidate["parameters"])
    short = {"k": "neighbor_count", "radius": "search_radius"}
    p = {short.get(k, k): v for k, v in candidate.items() if k not in ("name", "algorithm", "variogram", "space")}
    model = candidate.get("variogram")
    if isinstance(model, dict):
        p |= {"variogram_model": model["model"], "variogram_mode": "manual", "nugget": model["nugget"], "sill": model["nugget"] + model["partial_sill"], "range": model["range"]}
    elif model:
        p["variogram_model"] = model
    if candidate.get("space"):
        p |= candidate["space"] if "z_scale" in candidate["space"] else {"anisotropy": candidate["space"]}
    if algorithm in ("idw", "ordinary_kriging"):
        p = {"neighbor_count": 12, "min_neighbors": 1 if algorithm == "idw" else 3} | p
    return algorithm, p


def evaluate(points: DataFrame, assignments: DataFrame, candidates: list[dict], axes: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(out-of-fold predictions, failures). Predictions: candidate, fold_index, source_row, observed, predicted, is_nodata, a row for
    each candidate that didn't fail and each row that validates; failures: the error of each that did.

    ``candidates``: {"name", "algorithm", "parameters"}; the algorithms and parameters are those of DEFAULTS. ``assignments``
    hold a role for every row in every fold; a row that never validates trains in all.
    """
    axes = axes or ["x", "y"]
    dimension = "3d" if len(axes) == 3 else "2d"
    own = assignments.where("role = 'validation'").select("source_row", F.col("fold_index").cast("int").alias("share"), F.col("group_key"))
    grouped = assignments.groupBy("source_row").agg(F.first("group_key").alias("group_key"))
    rows = points.select("source_row", *(F.col(a).cast("double") for a in axes), F.col("value").cast("double").alias("value")).join(grouped, "source_row").join(own.drop("group_key"), "source_row", "left")
    rows = checkpointed(rows.withColumn("share", F.coalesce("share", F.lit(NOBODY))))
    folds = [r["share"] for r in rows.where(F.col("share") != NOBODY).select("share").distinct().orderBy("share").collect()]
    spots = _asked(rows.where(F.col("share") != NOBODY), ["share"], axes)
    told = assignments.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "training").alias("train")).first()
    n, held = rows.count(), rows.where(F.col("share") != NOBODY).count()
    if told["train"] != n * len(folds) - held:
        raise GeoError("PLAN_INCOMPLETE", rows=n, folds=len(folds), training=told["train"])

    failures: dict[str, str] = {}
    spaces: dict[str, int] = {_key(None): 0}
    matrices: dict[int, list | None] = {0: None}
    searches: dict[str, int] = {}
    tasks: list[_Task] = []
    smooth: dict[str, dict] = {}
    grown: dict[str, dict] = {}
    mixed: dict[str, dict] = {}
    names = [c["name"] for c in candidates]
    for i, c in enumerate(candidates):
        try:
            algorithm, p = _renamed(c, dimension)
            p = settled(algorithm, p, dimension)
            if algorithm == "dsi_like":
                smooth[c["name"]] = p
            elif algorithm == "random_forest":
                grown[c["name"]] = p
            elif algorithm == "kriging_rf_residual":
                mixed[c["name"]] = p
            else:
                m = _matrix(p, dimension)
                k = spaces.setdefault(_key(m), len(spaces))
                matrices[k] = m
                search = k
                if p["neighborhood"]:
                    search = 10_000 + searches.setdefault(_key(p["neighborhood"]), len(searches))
                    p = p | {"neighbor_count": p["neighborhood"].get("max_neighbors", 24), "min_neighbors": p["neighborhood"].get("min_neighbors", 3)}
                tasks.append(_Task(c["name"], i, algorithm, k, search, p))
        except GeoError as e:
            failures[c["name"]] = e.code
        except (ValueError, TypeError, KeyError):
            failures[c["name"]] = "PARAMETER_INVALID"
    for name, p in mixed.items():  # the outer kriging of a forest on residuals
        m = _matrix(p["kriging"], dimension)
        k = spaces.setdefault(_key(m), len(spaces))
        matrices[k] = m
        tasks.append(_Task(name, names.index(name), "ordinary_kriging", k, k, p["kriging"]))
    parts: list[DataFrame] = []  # number, query_id, value
    outer = None
    if tasks:
        used = {k: matrices[k] for k in {t.set for t in tasks} | ({0} if searches else set())}
        placed = checkpointed(_placed(rows.select("source_row", *axes, "value", "share"), used, axes))
        queries = checkpointed(_placed(spots, used, axes))
        sectors = {10_000 + j: (0, json.loads(spec)) for spec, j in searches.items()}
        outer = _predict(placed, queries, tasks, dict.fromkeys(used, folds), axes, failures, sectors)
        if outer is not None:
            parts.append(outer.where(~F.col("number").isin(*([names.index(m) for m in mixed] or [NOBODY]))))
    each = F.array(*(F.lit(f) for f in folds))
    if smooth:
        keys = {name: i for i, name in enumerate(smooth)}
        training = rows.withColumn("fold", F.explode(each)).where("share <> fold").withColumn("c", F.explode(F.array(*map(F.lit, keys.values()))))
        training = training.select((F.col("c") * 1000 + F.col("fold")).cast("int").alias("problem"), "source_row", *axes, "value")
        fitted = smoothing.fit(training, {i * 1000 + f: smooth[name] for name, i in keys.items() for f in folds})
        for k, r in sorted(fitted.reports.items()):
            if "error" in r:
                failures[list(keys)[k // 1000]] = r["error"]
        if fitted.problems:
            asked = spots.withColumn("c", F.explode(F.array(*map(F.lit, keys.values()))))
            asked = asked.select((F.col("c") * 1000 + F.col("share")).cast("int").alias("problem"), "query_id", *axes)
            numbers = F.array(*(F.lit(names.index(name)) for name in keys))
            parts.append(smoothing.predict_many(fitted, asked).select(F.get(numbers, F.floor(F.col("problem") / 1000).cast("int")).alias("number"), "query_id", "value"))
    if mixed:
        found = _residual_forests(rows, spots, mixed, names, folds, axes, dimension, outer, failures)
        if found is not None:
            parts.append(found)
    if grown:
        settings, training, asked = {}, None, None
        keys = {name: i for i, name in enumerate(grown)}
        c = F.explode(F.array(*map(F.lit, keys.values())))
        training = rows.withColumn("fold", F.explode(each)).where("share <> fold").withColumn("c", c).select((F.col("c") * 1000 + F.col("fold")).cast("int").alias("problem"), "source_row", *axes, "value")
        asked = spots.withColumn("c", c).select((F.col("c") * 1000 + F.col("share")).cast("int").alias("problem"), "query_id", *axes)
        settings = {i * 1000 + f: _forest(grown[name]) for name, i in keys.items() for f in folds}
        numbers = F.array(*(F.lit(names.index(name)) for name in keys))
        parts.append(forests.predict_forests(training, asked, settings, axes).select(F.get(numbers, F.floor(F.col("problem") / 1000).cast("int")).alias("number"), "query_id", "value"))
    good = [(i, c["name"]) for i, c in enumerate(candidates) if c["name"] not in failures]
    spark = points.sparkSession
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "number int, query_id bigint, value double")
    answers = found.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "value"))).alias("told"))  # as many as candidates
    answers = spots.join(answers, "query_id").select("share", *axes, "told")
    every = rows.where(F.col("share") != NOBODY).join(answers, ["share", *axes], "left")
    every = every.join(F.broadcast(spark.createDataFrame(good, "number int, candidate string")), F.lit(True))  # a row for each candidate
    predicted = F.try_element_at("told", F.col("number"))
    return checkpointed(every.select("candidate", F.col("share").alias("fold_index"), "source_row", F.col("value").alias("observed"), predicted.alias("predicted"), predicted.isNull().alias("is_nodata"))), failures


def _forest(p: dict) -> forests.Settings:
    return forests.Settings(p["n_estimators"], p["max_depth"], p["min_samples_leaf"], p["max_features"], p["random_state"])


def _residual_forests(rows: DataFrame, spots: DataFrame, mixed: dict[str, dict], names: list[str], folds: list[int], axes: list[str], dimension: str, outer: DataFrame | None, failures: dict[str, str]) -> DataFrame | None:
    """Kriging from a fold's training rows, and a forest on what kriging misses in inner folds of these. A set is a candidate's
    outer fold, its shares are the inner folds: spatial groups dealt round in the order of a hash."""
    alive = [m for m in mixed if m not in failures]
    if not alive or outer is None:
        return None
    keys = {name: i for i, name in enumerate(alive)}
    training = rows.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).where("share <> fold").withColumn("c", F.explode(F.array(*map(F.lit, keys.values()))))
    training = training.withColumn("set", (F.col("c") * 1000 + F.col("fold")).cast("int"))
    seeds, inner = (F.array(*(F.lit(mixed[m][k]) for m in alive)) for k in ("inner_seed", "inner_folds"))
    groups = training.select("set", "c", "group_key").distinct().withColumn("_h", F.xxhash64(F.get(seeds, F.col("c")), "set", "group_key"))
    groups = numbered(groups, ["set", "_h", "group_key"], "_i").select("set", "group_key", F.pmod("_i", F.get(inner, F.col("c"))).cast("int").alias("part"))
    samples = checkpointed(training.join(groups, ["set", "group_key"]).select("set", "source_row", *axes, "value", F.col("part").alias("share")))
    tasks, matrices = [], {}
    for name, i in keys.items():
        p = mixed[name]["kriging"]
        for f in folds:
            matrices[i * 1000 + f] = _matrix(p, dimension)
            tasks.append(_Task(name, i * 1000 + f, "ordinary_kriging", i * 1000 + f, i * 1000 + f, p))
    if any(m is not None for m in matrices.values()):
        of = {k: m or [[float(i == j) for j in range(len(axes))] for i in range(len(axes))] for k, m in matrices.items()}
        weight = lambda i, j: F.element_at(F.create_map(*(F.lit(x) for k, m in sorted(of.items()) for x in (k, float(m[i][j])))), F.col("set"))
        turned = lambda df: df.withColumns({a: sum((weight(i, j) * F.col(b) for j, b in enumerate(axes)), F.lit(0.0)) for i, a in enumerate(axes)})
    else:
        turned = lambda df: df
    shares = {i * 1000 + f: list(range(mixed[m]["inner_folds"])) for m, i in keys.items() for f in folds}
    inside = _asked(samples, ["set", "share"], axes)
    found = _predict(turned(samples), turned(inside), tasks, shares, axes, failures, {})
    if found is None:
        return None
    answers = inside.join(found.select(F.col("number").alias("set"), "query_id", F.col("value").alias("p")), ["set", "query_id"]).select("set", "share", *axes, "p")
    met = samples.join(answers, ["set", "share", *axes], "left")
    for r in met.groupBy("set").agg(F.count("*").alias("n"), F.count("p").alias("good")).collect():  # a row for each candidate and fold
        p = mixed[alive[r["set"] // 1000]]
        if r["good"] < p["min_oof_residuals"] or r["good"] < p["min_oof_coverage"] * r["n"]:
            failures[alive[r["set"] // 1000]] = "RESIDUALS_INSUFFICIENT"
    residuals = met.where("p is not null").select(F.col("set").alias("problem"), "source_row", *axes, (F.col("value") - F.col("p")).alias("value"))
    asked = spots.withColumn("c", F.explode(F.array(*map(F.lit, keys.values())))).select((F.col("c") * 1000 + F.col("share")).cast("int").alias("problem"), "query_id", *axes)
    corrections = forests.predict_forests(residuals, asked, {i * 1000 + f: _forest(mixed[m]["random_forest"]) for m, i in keys.items() for f in folds}, axes)
    numbers = F.array(*(F.lit(names.index(m)) for m in alive))
    corrections = corrections.select(F.get(numbers, F.floor(F.col("problem") / 1000).cast("int")).alias("number"), "query_id", F.col("value").alias("correction"))
    return outer.join(corrections, ["number", "query_id"]).select("number", "query_id", (F.col("value") + F.col("correction")).alias("value"))
