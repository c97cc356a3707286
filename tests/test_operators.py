"""Hand cases of the library's operators: edges of bins, ties, degenerate inputs, invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.functions.scalar import coerced, column_id, property_unit
from terralith.operators import anomalies, grid, interpretation, kriging, metrics, neighbors, quality, shared, smoothing, statistics, survey, validation, variogram
from terralith.operators.errors import GeoError
from terralith.sources import points as sources

POINT = "source_row bigint, x double, y double, z double, value double, is_numeric_valid boolean"


def points(spark, rows):
    return spark.createDataFrame([(i + 1, float(x), float(y), float(z), v, True) for i, (x, y, z, v) in enumerate(rows)], POINT)


def test_histogram_edges_and_constant(spark):
    df = points(spark, [(0, 0, 0, float(v)) for v in (0, 1, 2, 4)])
    assert [r["n"] for r in statistics.histogram(df, bins=4).orderBy("bin").collect()] == [1, 1, 1, 1]
    flat = points(spark, [(0, 0, 0, 3.0)] * 5)
    got = statistics.histogram(flat, bins=2).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in got] == [(2.5, 3.0, 0), (3.0, 3.5, 5)]
    with pytest.raises(GeoError):
        statistics.histogram(df.limit(0))


def test_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr("terralith.functions.quantiles.LISTED", 100)
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 5.0, -2.0]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(exact_quantiles(df, "v", probs), np.quantile(values, probs))
    assert exact_quantiles(df.limit(0), "v", probs) is None


def test_standardize_and_inspect(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿x,Northing,rho\n1,2,3\n4,abc,6\n7,8,\n9,1e400,2\n")
    raw = sources.read_source(spark, f"file://{tmp_path}/p.csv")
    assert sources.role_candidates(raw.columns) == {"x": "x", "y": "Northing", "value": "rho"}
    kinds = dict(tuple(r) for r in sources.column_types(raw).collect())
    assert kinds == {"x": "numeric", "Northing": "text", "rho": "text"}
    out = sources.standardize(raw, sources.Mapping("x", "Northing", "rho")).orderBy("source_row").collect()
    assert [(r["source_row"], r["is_numeric_valid"]) for r in out] == [(1, True), (2, False), (3, False), (4, False)]
    with pytest.raises(GeoError):
        sources.standardize(raw, sources.Mapping("x", "Northing", "rho", coordinate_kind="geographic"))


def test_quality_rules(spark):
    rows = [(i, i * i, 0, float(i)) for i in range(12)] + [(3, 9, 0, 99.0), (1, 1, 0, -9999.0), (5e7, 1, 0, 2.0)]
    codes = {r["code"] for r in quality.quality_issues(points(spark, rows)).collect()}
    assert {"CONFLICTING_COORDINATE", "NODATA_VALUE", "SUSPICIOUS_MAGNITUDE", "EXTREME_VALUES"} <= codes
    few = quality.quality_issues(points(spark, [(1, 1, 0, 1.0)] * 4))
    assert {r["code"] for r in few.collect()} == {"INSUFFICIENT_VALID_POINTS", "DEGENERATE_EXTENT", "DUPLICATE_ROWS", "SPARSE_DISTRIBUTION"}
    assert quality.quality_status(few) == "blocked"
    with pytest.raises(GeoError):
        quality.check_confirmation(few, ["DUPLICATE_ROWS"])


def test_constant_truth(spark):
    rows = [("a", i, 5.0, 5.0, False) for i in range(3)] + [("b", i, 5.0, 6.0, False) for i in range(3)] + [("c", i, 5.0, None, True) for i in range(3)]
    schema = "candidate string, source_row bigint, observed double, predicted double, is_nodata boolean"
    df = spark.createDataFrame(rows, schema)
    got = {r["candidate"]: r for r in metrics.metrics(df.where("candidate <> 'c'")).collect()}
    assert (got["a"]["r2"], got["b"]["r2"], got["b"]["bias"]) == (1.0, 0.0, 1.0)
    with_empty = {r["candidate"]: r["n"] for r in metrics.metrics(df).collect()}
    assert with_empty == {"a": 0, "b": 0, "c": 0}


def test_folds_keep_columns_together(spark):
    rng = random.Random(2)
    df = points(spark, [(x, y, z, rng.random()) for x in range(6) for y in range(4) for z in range(5)])
    plan = validation.fold_assignments(df, "3d", 4)
    validation.check_assignments(plan)
    whole = plan.where("role = 'validation'").join(df, "source_row").groupBy("x", "y").agg(F.count_distinct("fold_index").alias("n"))
    assert {r["n"] for r in whole.collect()} == {1}
    with pytest.raises(GeoError):
        validation.fold_assignments(df.where("x = 0 and y < 2"), "3d", 4)


def test_nearest_matches_brute_force(spark):
    rng = np.random.RandomState(3)
    p = np.concatenate((rng.rand(200, 2), [[0.5, 0.5]] * 20, [[40.0, 40.0]]))
    df = points(spark, [(x, y, 0, float(i)) for i, (x, y) in enumerate(p)])
    q = np.concatenate((rng.rand(20, 2) * 1.5, [[0.5, 0.5], [-30.0, 9.0]]))
    queries = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "query_id bigint, x double, y double")
    got = {}
    for r in neighbors.nearest(queries, df, 7).collect():
        got.setdefault(r["query_id"], []).append((r["k"], r["source_row"]))
    for i, a in enumerate(q):
        order = sorted(range(len(p)), key=lambda j: (math.sqrt(((p[j] - a) ** 2).sum()), j))[:7]
        assert [s for _, s in sorted(got[i])] == [j + 1 for j in order]


def test_kriging_is_exact_and_unbiased(spark):
    rng = np.random.RandomState(5)
    p = rng.rand(40, 2) * 10
    df = points(spark, [(x, y, 0, 7.0 if i else 7.0) for i, (x, y) in enumerate(p)])
    queries = df.select(F.col("source_row").alias("query_id"), "x", "y").unionByName(spark.createDataFrame([(1000, 3.3, 4.4)], "query_id bigint, x double, y double"))
    model = {"model": "spherical", "nugget": 0.2, "partial_sill": 2.0, "range": 5.0}
    rows = kriging.krige(queries, df, model, 8).collect()
    assert all(abs(r["value"] - 7.0) < 1e-8 for r in rows)
    assert all(r["variance"] >= 0 for r in rows)


def test_variogram_fit_recovers_the_model():
    h = np.linspace(1, 30, 15)
    for model in variogram.MODELS:
        gamma = 2 + 5 * variogram.variogram_shape(h / 11.0, model, np.exp, np.where)
        fit = variogram.fit(h, gamma, np.full(15, 100), model)
        assert abs(fit["nugget"] - 2) < 1e-3 and abs(fit["partial_sill"] - 5) < 1e-2 and abs(fit["range"] - 11) < 1e-2
    assert shared.largest_remainders({0: 5, 1: 5, 2: 1}, 4) == {0: 2, 1: 2, 2: 0}


def test_components_do_not_join_diagonally(spark):
    axes = [grid.Axis(0.0, 3.0, 4), grid.Axis(0.0, 3.0, 4), grid.Axis(0.0, 1.0, 2)]
    high = {(0, 0, 0), (0, 1, 0), (1, 2, 0), (3, 3, 1), (3, 3, 0), (3, 2, 1)}
    g = grid.nodes(spark, axes)
    value = F.lit(0.0)
    for i, j, k in high:
        value = F.when((F.col("ix") == i) & (F.col("iy") == j) & (F.col("iz") == k), 9.0).otherwise(value)
    g = g.withColumn("value", value).withColumn("is_nodata", F.lit(False))
    got = anomalies.components(g, 5.0).orderBy("component_id").collect()
    assert [(r["support_node_count"], r["touches_grid_boundary"]) for r in got] == [(2, True), (1, True), (3, True)]
    assert anomalies.components(g, 5.0, min_nodes=3).count() == 1


def test_smoothing_keeps_observations(spark):
    axes = [grid.Axis(0.0, 2.0, 3)] * 3
    df = points(spark, [(0, 0, 0, 1.0), (2, 2, 2, 3.0), (0, 2, 0, 2.0), (2, 0, 2, 2.0)])
    fitted, report = smoothing.smooth(df, axes)
    got = {(r["ix"], r["iy"], r["iz"]): r["value"] for r in fitted.field.collect()}
    assert report["converged"] and report["max_delta"] < 1e-4 and report["max_observation_error"] <= 1e-8
    assert len(got) == 27 and got[0, 0, 0] == 1.0 and got[2, 2, 2] == 3.0 and all(1.0 <= v <= 3.0 for v in got.values())


def test_survey_flags(spark):
    lines = [("a", 1, "WL Vx"), ("a", 2, " 0.1 200 "), ("a", 3, "0.2 1.#QNAN0"), ("a", 4, ""), ("a", 5, "x 1"), ("a", 6, "0.3"), ("a", 7, "nan inf"), ("b", 1, "  ")]
    rows = survey.parse(spark.createDataFrame(lines, "file string, line_no bigint, text string")).orderBy("line_no").collect()
    assert [(r["line_no"], r["flags"]) for r in rows] == [(2, ""), (3, "v_msvc_special"), (5, "wl_not_numeric"), (6, "column_count;v_empty"), (7, "wl_nan;v_infinite")]
    with pytest.raises(GeoError):
        survey.three_sigma(spark.createDataFrame([(1.0,)], "v double"), ["v"])


def test_numbers_as_text(spark):
    values = [0.0, 1.0, 100000.0, 1234567.0, 0.0001, 0.00001234, 12.3456789, -7.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(column_id(F.col("v"), F.lit(2.0))).collect()]
    assert got == [f"X{v:g}_Y2" for v in values]
    bad = spark.createDataFrame([("1e3",), ("x",), ("",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in bad.select(coerced(F.col("t"))).collect()] == [1000.0, None, None, None, None]


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_whole_columns_by_one_tolerance(spark):
    """Places nearer to each other than 1e-9 of the wider axis are one column."""
    df = points(spark, [(0, 0, 0, 1.0), (0, 0.5, 1, 2.0), (1e9, 1, 0, 3.0), (5, 0, 0, 4.0)])
    got = {(r["x"], r["y"]): r["group_key"] for r in validation.groups_3d(df).collect()}
    assert got == {(0.0, 0.0): 0, (0.0, 0.5): 0, (5.0, 0.0): 1, (1e9, 1.0): 2}


def test_folds_dealt_by_all_tasks(spark):
    df = points(spark, [(x, y, z, 1.0) for x in range(6) for y in range(4) for z in range(5)])
    plan = validation.fold_assignments(df, "3d", 4, dealt=True)
    validation.check_assignments(plan)
    sizes = [r["n"] for r in plan.where("role = 'validation'").groupBy("fold_index").agg(F.count("*").alias("n")).collect()]
    assert sizes == [30] * 4
    assert validation.fold_table(df, "3d", holdout=0.25, dealt=True).count() == 6
    torn = plan.where("role = 'validation'").select("source_row", "group_key", F.when(F.col("source_row") == 1, (F.col("fold_index") + 1) % 4).otherwise(F.col("fold_index")).alias("own"))
    with pytest.raises(GeoError):
        validation.check_assignments(validation.with_roles(torn, 4))


def test_group_quantiles_match_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([1.0, rng.random()])) for _ in range(3000)] + [("d", 2.0), ("e", None), (None, 5.0)]
    out = {r["k"]: (r["low"], r["high"]) for r in shared.group_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.13, "high": 0.9}).collect()}
    for k in ("a", "b", "c"):
        assert np.allclose(out.pop(k), np.quantile([v for g, v in rows if g == k], [0.13, 0.9]))
    assert out == {"d": (2.0, 2.0), None: (5.0, 5.0)}


def test_relative_errors_keep_the_sign(spark):
    rows = [("a", 1, -2.0, -1.0, False), ("a", 2, 4.0, 5.0, False), ("a", 3, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "candidate string, source_row bigint, observed double, predicted double, is_nodata boolean")
    r = metrics.nine_metrics(df).first()
    assert (r["mean_relative"], r["median_relative"], r["median_ae"]) == (-0.125, -0.125, 1.0)
    zero = metrics.nine_metrics(df.withColumn("observed", F.lit(0.0))).first()
    assert zero["mean_relative"] == float("inf") and zero["r2"] is None


def test_anisotropy_candidates():
    one = lambda name, azimuth, reach, dip=None, bound=1000.0: {"id": name, "azimuth": azimuth, "dip": dip, "range": reach, "bound": bound, "pairs": 10}
    found = variogram.suggest_anisotropy([one("az000", 0.0, 60.0), one("az045", 45.0, 30.0), one("az090", 90.0, 20.0), one("az135", 135.0, None)])
    best = found["candidates"][0]
    assert (best["major"], best["secondary"], best["minor_ratio"], best["warnings"], best["pairs"]) == ("az000", "az090", 3.0, [], 20)
    assert found["skipped"] == ["az135"] and len(found["candidates"]) == 3
    tie = variogram.suggest_anisotropy([one("a", 0.0, 50.0), one("b", 60.0, 45.0), one("c", 120.0, 44.0)])["candidates"][0]
    assert tie["secondary"] == "c" and tie["warnings"] == ["weak_range_contrast"]
    space = variogram.suggest_anisotropy([one("a", 0.0, 50.0, bound=50.0), one("b", 90.0, 10.0), one("v", 0.0, 5.0, 80.0), one("w", 0.0, 4.0, -90.0)], "3d")["candidates"][0]
    assert (space["vertical"], space["vertical_ratio"], space["warnings"]) == ("w", 12.5, ["range_at_disclosed_upper_bound"])
    alone = variogram.suggest_anisotropy([one("a", 0.0, 50.0)], "3d")["candidates"][0]
    assert alone["warnings"] == ["single_supported_direction", "vertical_direction_unsupported"] and alone["minor_ratio"] is None
    assert variogram.suggest_anisotropy([one("a", 0.0, None)])["warnings"] == ["no_supported_direction"]


def test_profiles_and_units(spark):
    for name, unit, want in (("RHO", "Ω·m", "resistivity"), (" rho ", "ohm_m", "resistivity"), ("rho", "ohm.m", "generic_3d"), ("Vx", "km / s", "microseismic_velocity"), ("vx", "m/s", "generic_3d"), ("CH4_content", "mL/g", "gas_content"), ("ch4", "m3/t", "generic_3d")):
        assert interpretation.resolve_profile(name, unit) == want
    told = spark.createDataFrame([("RHO", None, "3d"), (" RHO ", "", None), ("RHO", "", "2d"), ("rho", "Ω·m", "3D"), ("Vx", "km/s", "3d"), ("Vx", "m/s", "3d"), ("CH4_content", None, "3d"), (None, None, None)], "value_name string, value_unit string, dimension string")
    got = [(r["profile"], [x["missing"] for x in r["disabled"]] if r["disabled"] else None) for r in interpretation.analysis_profiles(told).collect()]
    name, velocity, gas = interpretation.NEEDED.values()
    assert got == [("resistivity", None), ("resistivity", None), ("generic_3d", ["dimension=3d", velocity, gas]), ("generic_3d", [name, velocity, gas]), ("microseismic_velocity", None), ("generic_3d", [name, "value_unit=km/s", gas]), ("gas_content", None), ("generic_3d", [name, velocity, gas])]
    rows = [("resistivity", "builtin_preset", "RHO", None), ("resistivity", "upload", "RHO", "ohm*m"), (None, None, "RHO", None)]
    df = spark.createDataFrame(rows, "case string, kind string, name string, unit string")
    assert [r[0] for r in df.select(property_unit(F.col("case"), F.col("kind"), F.col("name"), F.col("unit"))).collect()] == ["Ω·m", "ohm*m", None]


def test_byte_limit(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y\n" * 100)
    sources.check_byte_limit(spark, f"file://{tmp_path}/p.csv")
    with pytest.raises(GeoError):
        sources.check_byte_limit(spark, f"file://{tmp_path}/p.csv", 100)
    assert sources.role_candidates(["Easting", "纬度", "ALT", "val"]) == {"x": "Easting", "y": "纬度", "z": "ALT", "value": "val"}
