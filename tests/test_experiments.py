"""Experiments, stored tables, survey contracts, spaces and diagnosis on small cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions.scalar import in_space, rotation_3d, space
from terralith.operators import catalog, experiments, grid, neighbors, result_analysis, smoothing, survey, variogram, voxels
from terralith.operators.errors import GeoError
from terralith.sources import stored

POINT = "source_row bigint, x double, y double, z double, value double, is_numeric_valid boolean"


def points(spark, rows):
    return spark.createDataFrame([(i + 1, float(x), float(y), float(z), float(v), True) for i, (x, y, z, v) in enumerate(rows)], POINT)


def test_spaces(spark):
    m = np.array(rotation_3d(30, 20, -10))
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) > 0
    assert np.allclose(m[0], [math.cos(math.radians(20)) * math.cos(math.radians(30)), math.cos(math.radians(20)) * math.sin(math.radians(30)), math.sin(math.radians(20))])
    assert np.allclose(space({"azimuth": 90.0, "minor_scale": 0.5}, "2d"), [[0, 1], [-2, 0]]) and np.allclose(rotation_3d(40)[0][:2] + rotation_3d(40)[1][:2], np.ravel(space({"azimuth": 40.0}, "2d")))
    r = in_space(points(spark, [(1, 2, 3, 0)]), ["x", "y", "z"], space({"z_scale": 4.0}, "3d")).first()
    assert (r["x"], r["y"], r["z"]) == (1.0, 2.0, 12.0)
    for spec, dimension in (({"z_scale": 2.0}, "2d"), ({"z_scale": 21.0}, "3d"), ({"z_scale": 2.0, "azimuth": 1.0}, "3d"), ({"minor_scale": 0.0}, "2d")):
        with pytest.raises(ValueError):
            space(spec, dimension)


def test_confirmed_choices():
    flat = experiments.confirmed_anisotropy({"azimuth_deg": 30, "major_minor_ratio": 4}, "2d")
    assert flat == {"azimuth": 30.0, "major_scale": 1.0, "minor_scale": 0.25}
    deep = experiments.confirmed_anisotropy({"azimuth_deg": 30, "major_minor_ratio": 2, "major_vertical_ratio": None}, "3d")
    assert (deep["dip"], deep["roll"], deep["vertical_scale"], deep["minor_scale"]) == (0.0, 0.0, 1.0, 0.5)
    assert experiments.confirmed_anisotropy({"keep_isotropic": True}, "3d")["minor_scale"] == 1.0
    for bad in ({}, {"azimuth_deg": 1}, {"azimuth_deg": float("nan"), "major_minor_ratio": 2}, {"azimuth_deg": 1, "major_minor_ratio": -2}):
        with pytest.raises(GeoError):
            experiments.confirmed_anisotropy(bad, "2d")
    base = {"variogram_model": "gaussian", "nugget": 1, "k": 8}
    assert experiments.with_professional("idw", base, None) is base
    auto = experiments.with_professional("ordinary_kriging", base, {"confirmation_id": 1, "model": "spherical", "neighborhood": {"radii": [1]}, "anisotropy": flat})
    assert auto == {"variogram_model": "spherical", "variogram_mode": "auto", "k": 8, "neighborhood": {"radii": [1]}, "anisotropy": flat}
    hand = experiments.with_professional("ordinary_kriging", base, {"confirmation_id": 1, "model": "spherical", "parameter_strategy": "manual", "manual_parameters": {"nugget": 0, "sill": 2, "range": 3}})
    assert hand == {"variogram_model": "spherical", "variogram_mode": "manual", "k": 8, "nugget": 0, "sill": 2, "range": 3}


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(experiments, "BLOCK", 7)
    df = spark.createDataFrame([(i, float(i % 5), None if i % 4 else "x") for i in range(100)], "i bigint, v double, t string")
    one = experiments.rows_fingerprint(df, ["i"])
    assert one == experiments.rows_fingerprint(df.repartition(5), ["i"]) and len(one) == 64
    assert one != experiments.rows_fingerprint(df.withColumn("v", F.when(F.col("i") == 50, 9.0).otherwise(F.col("v"))), ["i"])
    assert experiments.rows_fingerprint(df.limit(0), ["i"])
    a = experiments.definitions("idw", {"power": 2}, {"k": [4, 8]}, contract={"folds": 5})
    assert [d["parameters"] for d in a] == [{"power": 2, "k": 4}, {"power": 2, "k": 8}] and len({d["fingerprint"] for d in a}) == 2
    assert a[0]["fingerprint"] == experiments.fingerprint(validation={"folds": 5}, parameters={"k": 4, "power": 2}, algorithm="idw")
    with pytest.raises(GeoError):
        experiments.check_dimension("dsi_like", "2d")
    few = points(spark, [(i, i % 3, 0, i) for i in range(20)])
    experiments.check_learned(few, "2d", "idw", False)
    with pytest.raises(GeoError):
        experiments.check_learned(few, "2d", "random_forest", True)


def test_failed_candidates_fail_alone(spark):
    rng = random.Random(1)
    df = points(spark, [(rng.random() * 9, rng.random() * 9, 0, rng.random()) for _ in range(60)])
    plan = df.select("source_row", (F.col("source_row") % 6).alias("group_key"), (F.col("source_row") % 2).cast("int").alias("own"))
    from terralith.operators import validation

    found = [{"name": "good", "algorithm": "idw", "k": 4}, {"name": "none", "algorithm": "idw", "k": 4, "radius": 1e-6}, {"name": "auto", "algorithm": "kriging", "variogram": "exponential", "k": 6}]
    out = {r["candidate"]: r for r in experiments.run(df, validation.with_roles(plan, 2), found).collect()}
    assert (out["none"]["status"], out["none"]["n"], out["none"]["rank"]) == ("failed", 0, None)
    assert out["good"]["n"] == out["auto"]["n"] == 60 and {out["good"]["rank"], out["auto"]["rank"]} == {1, 2}


def test_stored_tables(spark, tmp_path):
    axes = [grid.Axis(0.0, 2.0, 3), grid.Axis(0.0, 1.0, 2), grid.Axis(0.0, 1.0, 2)]
    g = grid.nodes(spark, axes).select(*grid.INDEX, "x", "y", "z", F.when(F.col("node_id") != 3, F.col("x") + F.col("z")).alias("value"), (F.col("node_id") == 3).alias("is_nodata"))
    path = f"file://{tmp_path}/g"
    told = stored.write_grid(g, path, algorithm="idw")
    back, meta = stored.load_grid(spark, path)
    assert back.count() == 12 and meta == told and (meta["rows"], meta["nodata"], meta["algorithm"]) == (12, 1, "idw")
    assert stored.write_grid(g, path) | {"algorithm": "idw"} == told
    with pytest.raises(GeoError):
        stored.load_grid(spark, f"file://{tmp_path}/absent")
    grid.write_slice(g, "x", 1, f"{path}/slice")
    lines = [r[0] for r in spark.read.text(f"{path}/slice").collect()]
    assert lines[0] == "x,y,z,value,is_nodata" and len(lines) == 5
    got = [(r["row"], r["column"], r["relative"]) for r in grid.chart_slice(g, "x", 1).collect()]
    assert sorted(got) == [(i, j, 0.5) for i in (0, 1) for j in (0, 1)]
    parts = result_analysis.analyze(g, "RHO", "Ω·m")
    assert {"grid", "composition", "depth", "components", "cards", "findings"} == set(parts) and parts["cards"].count() > 0
    result_analysis.write_json(parts, f"{path}/json")
    with pytest.raises(GeoError):
        result_analysis.analyze(g.withColumn("is_nodata", F.lit(True)), "RHO", "Ω·m")
    raw = spark.createDataFrame([("1", "2", "3", "x"), ("1", "2", "4", "5")], "a string, b string, c string, v string")
    for columns, rows in ((["a", "b"], 2), (["a", "b", "c", "v"], 3), (["a", "b", "c", "v"], 2)):
        with pytest.raises(GeoError):
            stored.check_preset(raw, columns, rows)
    with pytest.raises(GeoError):
        stored.check_preset(raw.drop("v"), ["a", "b", "c"], 2, 2)
    assert stored.check_preset(raw.drop("v"), ["a", "b", "c"], 2).count() == 2
    baseline = {"sha256": "h", "rows": 3, "rule": ["rmse_asc", "mae_asc", "r2_desc", "canonical_params_asc"], "validation": {"folds": 2}, "winner": {"k": 1}, "metrics": {"rmse": 1.0}, "common_valid": 3, "grid": {"nodes": [2, 2, 2], "bounds": [(0, 2), (0, 2), (0, 2)]}}
    df = points(spark, [(0, 0, 0, 1), (1, 1, 1, 1), (2, 2, 2, 1)])
    assert all(r["passed"] for r in stored.verify_baseline(df, baseline, "h", [{"k": 1}]).collect())
    worse = baseline | {"grid": {"nodes": [2, 2, 2], "bounds": [(0, 1), (0, 2), (0, 2)]}, "metrics": {"rmse": float("nan")}}
    assert {r["check"] for r in stored.verify_baseline(df, worse, "g", []).where("not passed").collect()} == {"source_sha256", "winner", "metrics", "bounds"}


def test_survey_contracts(spark):
    pts = spark.createDataFrame([("A", "p1", 1, None, 0.0, True, 0.0, 0.0), ("A", "p2", 2, 5.0, 5.0, True, 5.0, 0.0), ("B", "p3", 1, None, 0.0, True, 0.0, 9.0), ("B", "p9", None, 4.0, None, False, None, None)], "line_id string, point_id string, seq int, interval double, distance double, formal boolean, x double, y double")
    files = spark.createDataFrame([("p1.dat", "p1", 2, 1, 1), ("p2.dat", "p2", 1, 1, 1), ("p3.dat", "p3", 1, 1, 1)], "file string, point_id string, source_records bigint, valid bigint, nul bigint")
    samples = spark.createDataFrame([("s1", "p1.dat", 2, "p1", "0.1", "1.#QNAN0", None, "v_msvc_special", None), ("s2", "p1.dat", 3, "p1", "0.2", "3", 3.0, "", None), ("s3", "p2.dat", 2, "p2", "0.1", "4", 4.0, "", None), ("s4", "p3.dat", 2, "p3", "0.1", "5", 5.0, "", None)], "sample_id string, file string, line_no bigint, point_id string, wl_raw string, v_raw string, v double, flags string, z double")
    hashes = spark.createDataFrame([(f"p{i}.dat", "h", "h") for i in (1, 2, 3)], "file string, before string, after string")
    expected = {"files": 3, "line_points": {"A": 2, "B": 1}, "source_records": {"A": 3, "B": 1}, "valid": {"A": 2, "B": 1}, "invalid": 1, "special_point": "p1", "special_token": "1.#QNAN0", "nul": 3, "excluded": ["p9"]}
    report = survey.contract_report(expected, files, samples, pts, hashes).collect()
    assert len(report) == 15 and all(r["passed"] for r in report), [r for r in report if not r["passed"]]
    bad = survey.contract_report(expected | {"nul": 2}, files, samples.withColumn("sample_id", F.lit("s")), pts.withColumn("distance", F.lit(0.0)), hashes.withColumn("after", F.lit("g")))
    assert {r["check"] for r in bad.where("not passed").collect()} == {"nul_terminators_excluded", "sample_id_unique", "cumulative_distance_monotonic_traceable", "source_sha256_unchanged"}
    totals = {r["line_id"]: (r["points"], r["source_records"]) for r in survey.line_totals(pts.where("formal"), files.where("point_id <> 'p3'")).collect()}
    assert totals == {"A": (2, 3), "B": (1, 0)}
    rows = spark.createDataFrame([("L", i, 0.0, 0.0, float(i), 100.0 if i == 19 else 1.0) for i in range(20)] + [("M", 20, 0.0, 0.0, 0.0, 2.0)], "line_id string, sample bigint, x double, y double, z double, value double")
    kept = survey.three_sigma(rows, ["value"])
    nodes = survey.aggregate_places(kept.where("accepted"), "sample", "sample")
    want = {"accepted_count": 20, "rejected_count": 1, "per_line_accepted_counts": {"L": 19, "M": 1}, "conflict_group_count": 1, "conflict_row_count": 2, "modeling_node_count": 19}
    gate = survey.golden_gate(kept, nodes, want | {"accepted_sha256": experiments.rows_fingerprint(kept.where("accepted").drop("accepted"), ["sample"])})
    assert all(r["passed"] for r in gate.collect()) and gate.count() == 8
    assert {r["check"] for r in survey.golden_gate(kept, nodes, want | {"rejected_count": 2}).where("not passed").collect()} == {"rejected_count"}


def test_field_at_any_place(spark):
    """Samples keep their values, and places beyond them have none."""
    axes = [grid.Axis(0.0, 4.0, 5)] * 3
    rng = random.Random(3)
    df = points(spark, [(0, 0, 0, 0.5), (4, 4, 4, 0.25)] + [(rng.random() * 4, rng.random() * 4, rng.random() * 4, rng.random()) for _ in range(30)])
    fitted, _ = smoothing.smooth(df, axes)
    at = df.select(F.col("source_row").alias("query_id"), "x", "y", "z").unionByName(spark.createDataFrame([(99, 9.0, 1.0, 1.0)], "query_id bigint, x double, y double, z double"))
    got = {r["query_id"]: r for r in smoothing.predict(fitted, at).collect()}
    assert got[99]["is_nodata"] and all(abs(got[r["source_row"]]["value"] - r["value"]) < 1e-9 for r in df.collect())


def test_diagnosis_finds_the_long_direction(spark):
    rng = np.random.RandomState(2)
    p = rng.rand(500, 2) * 100
    df = points(spark, [(x, y, 0, math.sin(x / 40) + math.sin(y / 8)) for x, y in p])
    pairs = variogram.sampled_pairs(df, 20_000)
    out = variogram.diagnose(pairs, [{"id": f"az{a:03d}", "azimuth": float(a), "tolerance": 22.5} for a in (0, 45, 90, 135)], 4.0, 10)
    assert out["suggestion"]["candidates"][0]["major"] == "az000" and len(out["fits"]) == 3 and out["bins"].count() == 50
    assert variogram.check_manual("spherical", 0.0, 2.0, 3.0)["partial_sill"] == 2.0
    with pytest.raises(GeoError):
        variogram.check_manual("spherical", 2.0, 2.0, 3.0)


def test_crowded_places(spark, monkeypatch):
    """Most samples in a hundredth of the area: finer cells give the same neighbours."""
    monkeypatch.setattr(neighbors, "CROWDED", 4)
    rng = np.random.RandomState(8)
    p = np.concatenate((rng.rand(1500, 2), rng.rand(100, 2) * 1000))
    q = np.concatenate((rng.rand(15, 2), rng.rand(15, 2) * 1000))
    queries = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "query_id bigint, x double, y double")
    got = {}
    for r in neighbors.nearest(queries, points(spark, [(x, y, 0, 0) for x, y in p]), 5).collect():
        got.setdefault(r["query_id"], []).append((r["k"], r["source_row"]))
    for i, a in enumerate(q):
        order = sorted(range(len(p)), key=lambda j: (math.sqrt(((p[j] - a) ** 2).sum()), j))[:5]
        assert [s for _, s in sorted(got[i])] == [j + 1 for j in order]


def test_voxels_and_catalog(spark):
    cells = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 5.0), ("b", 1.0001, 1.0, 1.0, 5.00001), ("a", 2.0, 1.0, 1.0, 7.0)], "tile string, x double, y double, z double, weight double")
    assert voxels.distinct_cells(cells).count() == 2 and voxels.summary(cells).first()["weight_max"] == 7.0
    with pytest.raises(GeoError):
        voxels.distinct_cells(cells.withColumn("weight", F.col("weight") * F.when(F.col("tile") == "b", 2).otherwise(1)))
    box = {"x": (0.0, 3.0), "y": (0.0, 3.0), "z": (0.0, 3.0)}
    assert voxels.violations(cells, 3, (0.9, 1.1), 10, (0.0, 9.0, 0.1), box, 0.5).count() == 0
    assert {r["rule"] for r in voxels.violations(cells.limit(0), 3, (0.9, 1.1), 10, (0.0, 9.0, 0.1), box, 0.5).collect()} == {"empty"}
    few = spark.createDataFrame([(1, "d1"), (1, "d1")], "candidate_id bigint, dataset string").withColumns({c: F.lit(1.0) for c in (*catalog.CONTRACT, *catalog.SCORES, "fold_fingerprint", "population_fingerprint", "common_valid_count")}).withColumn("selectable", F.lit(True))
    with pytest.raises(GeoError):
        catalog.mismatches(few)
    with pytest.raises(GeoError):
        catalog.mismatches(few.withColumns({"candidate_id": F.monotonically_increasing_id(), "dataset": F.monotonically_increasing_id()}))
    two = few.withColumn("candidate_id", F.monotonically_increasing_id())
    assert catalog.mismatches(two).count() == 0 and catalog.mismatches(two.withColumn("rmse", F.lit(None).cast("double"))).count() == 2
