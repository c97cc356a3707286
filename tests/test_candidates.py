"""Every algorithm in one run against plain loops over candidates and folds; presets by their own parameter names; failures alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions.scalar import space
from terralith.operators import candidates, experiments, forests, variogram
from terralith.operators.errors import GeoError
from terralith.operators.kriging import solve

POINT = "source_row bigint, x double, y double, z double, value double, is_numeric_valid boolean"
AXES = ["x", "y", "z"]


def data(spark, n=150, seed=1, folds=3):
    rng = np.random.RandomState(seed)
    p = rng.rand(n, 3) * [10, 8, 5]
    v = np.sin(p[:, 0]) + p[:, 1] * 0.5 + rng.randn(n) * 0.05
    own = (p[:, 0] * 3).astype(int) % folds
    df = spark.createDataFrame([(i, *map(float, a), float(b), True) for i, (a, b) in enumerate(zip(p, v, strict=True))], POINT)
    rows = [(f, i, int(p[i, 0] * 3), "validation" if own[i] == f else "training", False) for i in range(n) for f in range(folds)]
    plan = spark.createDataFrame(rows, "fold_index int, source_row bigint, group_key bigint, role string, leakage_detected boolean")
    return df, plan, p, v, own


def near(p, q, train, k, radius=None):
    d = np.sqrt(((p[train] - q) ** 2).sum(axis=1))
    order = sorted(range(len(train)), key=lambda i: (d[i], train[i]))
    order = [i for i in order if radius is None or d[i] < radius][:k]
    return train[order], d[order]


def brute(p, v, own, predict):
    out = np.full(len(v), np.nan)
    for i in range(len(v)):
        out[i] = predict(i, np.flatnonzero(own != own[i]))
    return out


def test_all_algorithms_in_one_run(spark):
    df, plan, p, v, own = data(spark)
    model = {"model": "exponential", "nugget": 0.05, "partial_sill": 2.0, "range": 4.0}
    manual = {"variogram_model": "exponential", "variogram_mode": "manual", "nugget": 0.05, "sill": 2.05, "range": 4.0}
    sector = {"radii": (4.0, 3.0, 3.0), "azimuth_deg": 20.0, "sector_count": 4, "max_per_sector": 2, "min_neighbors": 2, "max_neighbors": 6}
    found = [
        {"name": "idw", "algorithm": "idw", "parameters": {"power": 1.5, "neighbor_count": 6}},
        {"name": "near", "algorithm": "idw", "parameters": {"neighbor_count": 9, "search_radius": 1.2, "min_neighbors": 3}},
        {"name": "stretched", "algorithm": "idw", "parameters": {"z_scale": 3.0, "neighbor_count": 5}},
        {"name": "kriging", "algorithm": "ordinary_kriging", "parameters": manual | {"neighbor_count": 8}},
        {"name": "turned", "algorithm": "ordinary_kriging", "parameters": manual | {"neighbor_count": 5, "anisotropy": {"azimuth_deg": 30.0, "dip_deg": 0.0, "roll_deg": 0.0, "major_scale": 1.0, "minor_scale": 0.5, "vertical_scale": 0.25}}},
        {"name": "auto", "algorithm": "ordinary_kriging", "parameters": {"variogram_model": "spherical", "neighbor_count": 7}},
        {"name": "sectors", "algorithm": "idw", "parameters": {"neighborhood": sector}},
        {"name": "dsi", "algorithm": "dsi_like", "parameters": {"neighbor_connectivity": 6}},
        {"name": "forest", "algorithm": "random_forest", "parameters": {"n_estimators": 10}},
        {"name": "mixed", "algorithm": "kriging_rf_residual", "parameters": {"kriging": manual | {"neighbor_count": 8}, "random_forest": {"n_estimators": 10}}},
        {"name": "sill", "algorithm": "ordinary_kriging", "parameters": manual | {"sill": 0.01}},
        {"name": "typo", "algorithm": "idw", "parameters": {"pwr": 2}},
        {"name": "poor", "algorithm": "kriging_rf_residual", "parameters": {"min_oof_residuals": 5000, "random_forest": {"n_estimators": 3}}},
        {"name": "short", "algorithm": "dsi_like", "parameters": {"max_iterations": 1, "convergence_tolerance": 1e-12}},
        {"name": "none", "algorithm": "idw", "parameters": {"search_radius": 1e-9}},
    ]
    oof, failures = candidates.evaluate(df, plan, found, AXES)
    assert failures == {"sill": "VARIOGRAM_FIT_FAILED", "typo": "PARAMETER_UNKNOWN", "poor": "RESIDUALS_INSUFFICIENT", "short": "DSI_NOT_CONVERGED"}
    got = {}
    for r in oof.collect():
        assert r["fold_index"] == own[r["source_row"]] and r["observed"] == v[r["source_row"]]
        got.setdefault(r["candidate"], np.full(len(v), np.nan))[r["source_row"]] = np.nan if r["is_nodata"] else r["predicted"]
    assert all(len(x) == len(v) for x in got.values()) and set(got) == {c["name"] for c in found} - set(failures)

    def idw(q, power, k, radius=None, least=3):
        def one(i, train):
            rows, d = near(q, q[i], train, k, radius)
            return (v[rows] / d**power).sum() / (1 / d**power).sum() if len(rows) >= least else np.nan

        return brute(q, v, own, one)

    def kriging(q, k, models):
        def one(i, train):
            rows, _ = near(q, q[i], train, k)
            return solve(q[rows][None], v[rows][None], q[i][None], models[own[i]])[0][0]

        return brute(q, v, own, one)

    same = lambda a, b: np.allclose(a, b, atol=1e-8, equal_nan=True)
    assert same(got["idw"], idw(p, 1.5, 6)) and same(got["near"], idw(p, 2.0, 9, 1.2)) and np.isnan(got["near"]).any()
    assert same(got["stretched"], idw(p * [1, 1, 3], 2.0, 5)) and np.isnan(got["none"]).all()
    assert same(got["kriging"], kriging(p, 8, [model] * 3))
    turned = p @ np.array(space({"azimuth": 30.0, "minor_scale": 0.5, "vertical_scale": 0.25}, "3d")).T
    assert same(got["turned"], kriging(turned, 5, [model] * 3))
    fits = [variogram.fit_points(df.where(F.col("source_row").isin(*np.flatnonzero(own != f).tolist())), "spherical", AXES) for f in range(3)]
    assert same(got["auto"], kriging(p, 7, fits))
    local = (p[:, None] - p[None]) @ np.array(space({"azimuth": 20.0}, "3d")).T

    def by_sector(i, train):
        o = local[train, i]
        d = np.sqrt(((o / sector["radii"]) ** 2).sum(axis=1))
        turn = np.arctan2(o[:, 2], o[:, 1]) % (2 * np.pi)
        kept = []
        for s in range(4):
            kept += sorted((d[j], train[j]) for j in range(len(train)) if d[j] <= 1 and min(3, int(turn[j] // (np.pi / 2))) == s)[:2]
        rows = [r for _, r in sorted(kept)][:6] if len(kept) >= 2 else []
        w = 1 / ((p[rows] - p[i]) ** 2).sum(axis=1) if rows else None
        return (w * v[rows]).sum() / w.sum() if rows else np.nan

    assert same(got["sectors"], brute(p, v, own, by_sector)) and np.isfinite(got["sectors"]).sum() > 50
    for f in range(3):
        train, ask = np.flatnonzero(own != f), np.flatnonzero(own == f)
        low, high = p[train].min(axis=0), p[train].max(axis=0)
        inside = np.all((p[ask] >= low) & (p[ask] <= high), axis=1)
        assert (np.isfinite(got["dsi"][ask]) == inside).all()
        asked = spark.createDataFrame([(f, int(i), *map(float, p[i])) for i in ask], "problem int, query_id bigint, x double, y double, z double")
        alone = forests.predict_forests(df.where(F.col("source_row").isin(*train.tolist())).withColumn("problem", F.lit(f)), asked, {f: forests.Settings(10)}, AXES)
        assert all(abs(got["forest"][r["query_id"]] - r["value"]) < 1e-9 for r in alone.collect())
    rmse = {k: np.sqrt(np.nanmean((x - v) ** 2)) for k, x in got.items() if k != "none"}
    assert all(rmse[k] < 0.8 * v.std() for k in ("idw", "kriging", "auto", "dsi", "forest", "mixed")), rmse


def test_presets_run_by_their_own_names(spark):
    df, plan, _, _, _ = data(spark, 60, 4, 2)
    for case, many in (("resistivity", 7), ("microseismic", 27), ("gas", 13)):
        found = [c | {"name": f"{i:02d}"} for i, c in enumerate(experiments.preset_candidates(case))]
        out = experiments.run(df, plan, found, AXES).collect()
        assert len(out) == len(found) == many and {r["status"] for r in out} == {"succeeded"}, [(r["candidate"], r["error"]) for r in out]
        assert sorted(r["rank"] for r in out) == list(range(1, many + 1)) and len({r["n"] for r in out}) == 1


def test_jobs_do_not_grow_with_candidates(spark):
    df, plan, _, _, _ = data(spark, 40, 5, 2)
    used = []
    for many in (2, 12):
        found = [{"name": f"c{i}", "algorithm": "idw", "parameters": {"neighbor_count": 4 + i % 3, "power": 1.0 + i}} for i in range(min(many, 7))]
        found += [{"name": f"k{i}", "algorithm": "ordinary_kriging", "parameters": {"neighbor_count": 5 + i}} for i in range(many - len(found))] or [{"name": "k", "algorithm": "ordinary_kriging", "parameters": {}}]
        spark.sparkContext.setJobGroup(f"many{many}", "")
        candidates.evaluate(df, plan, found, AXES)[0].collect()
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many{many}")))
    spark.sparkContext.setJobGroup("", "")
    assert used[1] <= used[0] + 2, used


def test_plans_must_be_whole(spark):
    df, plan, _, _, _ = data(spark, 40, 6, 2)
    with pytest.raises(GeoError, match="PLAN_INCOMPLETE"):
        candidates.evaluate(df, plan.where("source_row > 2 or role = 'validation'"), [{"name": "a", "algorithm": "idw", "parameters": {}}], AXES)


def test_a_place_is_searched_once(spark, monkeypatch):
    """Rows of one fold at one place share a search and its answers; rows of another fold there have their own."""
    rng = np.random.RandomState(5)
    p = np.repeat(rng.rand(12, 2) * [8, 6], 20, axis=0)
    own, v = np.arange(240) // 5 % 3, rng.randn(240)
    df = spark.createDataFrame([(i, *map(float, a), None, float(b), True) for i, (a, b) in enumerate(zip(p, v, strict=True))], POINT)
    plan = spark.createDataFrame([(f, i, i, "validation" if own[i] == f else "training", False) for i in range(240) for f in range(3)], "fold_index int, source_row bigint, group_key bigint, role string, leakage_detected boolean")
    asked, search = [], candidates.nearest_by
    monkeypatch.setattr(candidates, "nearest_by", lambda q, *a: (asked.append(q.count()), search(q, *a))[1])
    oof, failures = candidates.evaluate(df, plan, [{"name": "idw", "algorithm": "idw", "k": 30}, {"name": "few", "algorithm": "idw", "k": 3}, {"name": "odd", "algorithm": "idw", "k": 0}])
    assert asked == [36] and set(failures) == {"odd"}
    got = {(r["candidate"], r["source_row"]): r for r in oof.collect()}
    for name, k in (("idw", 30), ("few", 3)):
        def predict(i, train, k=k):
            rows, d = near(p, p[i], train, k)
            return v[rows[0]]  # the least row at the place

        want = brute(p, v, own, predict)
        assert [got[name, i]["predicted"] for i in range(240)] == want.tolist() and all(got[name, i]["fold_index"] == own[i] and got[name, i]["observed"] == v[i] for i in range(240))
    assert len(got) == 480
