"""Interpolators, cross-validation, survey lines and findings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions.scalar import rotation_3d, space
from terralith.operators import anomalies, candidates, conditional, experiments, grid, interpretation, kriging, learned, metrics, neighbors, result_analysis, smoothing, survey, validation, variogram
from terralith.operators.forests import Settings
from terralith.plans.evaluation_queries import predictions
from terralith.plans.grid_queries import LABELS, RANKED, event_grid
from terralith.plans.spatial_queries import TARGETS, targets
from terralith.plans.statistics_queries import rounded
from terralith.sources.points import SQL_2D, SQL_3D, points_2d, points_3d

MODEL = {"model": "exponential", "nugget": 50.0, "partial_sill": 800.0, "range": 12.0}


def i02(spark, d):
    return rounded(kriging.krige(targets(spark), points_2d(spark, d), MODEL, 12), "value", "variance", digits=4)


def i02_two(spark, d):
    """Two neighbours, whose system has a solution that SQL can write down."""
    return rounded(kriging.krige(targets(spark), points_2d(spark, d), MODEL, 2, 2), "value", "variance", digits=4)


def i02_space(spark, d):
    """The same in a space that is turned by 30 degrees and in which distances across count twice."""
    return rounded(kriging.krige(targets(spark), points_2d(spark, d), MODEL, 2, 2, matrix=space({"azimuth": 30.0, "minor_scale": 0.5}, "2d")), "value", "variance", digits=4)


def targets_3d(spark):
    i = F.col("id")
    return spark.range(120).select(i.alias("query_id"), ((i % 10) * 4.3).alias("x"), ((F.floor(i / 10) % 4) * 3.1 + 0.7).alias("y"), (F.floor(i / 40) * 9.7 + 1.3).alias("z"))


def measured_3d(spark, d):
    return points_3d(spark, d).where("is_numeric_valid")


def i01_z(spark, d):
    found = neighbors.inverse_distance(targets_3d(spark), measured_3d(spark, d), 8, axes=["x", "y", "z"], matrix=space({"z_scale": 2.5}, "3d"))
    return found.withColumn("value", F.round(F.col("value") * 10_000) / 10_000)  # means of eight equal weights often end in a half there


def n01_space(spark, d):
    near = neighbors.sector_neighbors(targets_3d(spark), measured_3d(spark, d), (5.0, 3.0, 4.0), 30.0, 4, 2, 3, 6, dip=20.0, roll=-10.0)
    return rounded(near, "value", "d")


def i01_sectors(spark, d):
    """Neighbours from sectors, weights by plain distance."""
    near = neighbors.sector_neighbors(targets_3d(spark), measured_3d(spark, d), (5.0, 3.0, 4.0), 30.0, 4, 2, 3, 6, dip=20.0, roll=-10.0)
    return rounded(neighbors.inverse_distance(targets_3d(spark), measured_3d(spark, d), axes=["x", "y", "z"], near=near), "value", digits=4)


def x01(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    p = s.select(F.col("s_suppkey").alias("source_row"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 13).cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.col("s_acctbal").alias("value"), F.lit(True).alias("is_numeric_valid"))
    return rounded(variogram.lag_bins(p, most=None), "center", "semivariance", digits=4)


def g16(spark, d):
    """The whole analysis of a result, as the rows of its export."""
    return rounded(result_analysis.as_rows(result_analysis.analyze(event_grid(spark, d), "RHO", "Ω·m")), "value")


def i03(spark, d):
    """Every node's value on a grid over the samples, settled, with the report that the gates go by."""
    g = event_grid(spark, d).where("not is_nodata").select((F.col("ix") * 72 + F.col("iy") * 6 + F.col("iz")).cast("long").alias("source_row"), "x", "y", "z", "value")
    fitted, report = smoothing.smooth(g, tolerance=1e-6)
    field = rounded(fitted.field.select("ix", "iy", "iz", "x", "y", "z", "value", "is_nodata"), "x", "y", "z", "value", digits=3)
    return field.select("*", F.lit(report["converged"]).alias("converged"), F.lit(report["max_delta"] < 1e-6).alias("within"))


def i04(spark, d):
    return rounded(learned.Forest().fit(points_2d(spark, d), ["x", "y"]).predict(targets(spark)), "value", "spread")


def i04_folds(spark, d):
    """A forest of 80 trees of depth 18 over five spatial folds."""
    p = points_2d(spark, d)
    oof = learned.cross_validate(p, validation.fold_assignments(p, "2d", 5), ["x", "y"], Settings(80))
    return rounded(metrics.metrics(oof), "mae", "rmse", "r2", "bias", "coverage", digits=4)


def i05(spark, d):
    return rounded(learned.kriging_with_forest(points_2d(spark, d), targets(spark), MODEL, ["x", "y"], 3, 24, learned.Forest()), "baseline", "correction", "value")


def v07(spark, d):
    p = points_2d(spark, d)
    plan = validation.fold_assignments(p, "2d", 2)
    found = [{"name": "idw-2", "algorithm": "idw", "k": 8, "power": 2.0}, {"name": "kriging-exp", "algorithm": "kriging", "variogram": MODEL, "k": 8}]
    oof, _ = candidates.evaluate(p, plan, found)
    return rounded(metrics.ranking(metrics.metrics(oof)), "mae", "rmse", "r2", "bias", "coverage", digits=4)


def survey_lines(spark, d):
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    v = F.when(k % 29 == 0, "1.#QNAN0").when(k % 31 == 0, "abc").otherwise(F.floor("value").cast("string"))
    wl = F.concat(F.lit("0."), F.lpad((k % 200).cast("string"), 3, "0"))
    text = F.when(k % 53 == 0, "  ").when(k % 41 == 0, wl).otherwise(F.concat(F.lit(" "), wl, F.lit("   "), v))
    return e.select(F.concat(F.lit("L"), F.col("user_id") % 9, F.lit(".dat")).alias("file"), (k + 1).alias("line_no"), text.alias("text"))


def parsed_values(spark, d):
    return survey.parse(survey_lines(spark, d)).where("is_valid").withColumn("value", F.col("v"))


def s09(spark, d):
    return survey.parse(survey_lines(spark, d)).select("file", "line_no", "wl", "v", "flags", "is_valid")


def f06(spark, d):
    return survey.three_sigma(parsed_values(spark, d), ["wl", "v"], 2.0).groupBy("file", "reasons").agg(F.count("*").alias("n"))


def a21(spark, d):
    rows = parsed_values(spark, d).select((F.col("line_no") % 7).cast("double").alias("x"), (F.col("line_no") % 5).cast("double").alias("y"), (-F.col("wl") * 1000).alias("z"), "value", "line_no", "file")
    return rounded(survey.aggregate_places(rows, "line_no", "line_no"), "mean", "std", "spread", "z")


def line_places(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 9).alias("line_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 100).cast("double").alias("x"), F.hour("ts").cast("double").alias("y"))


def w05(spark, d):
    return rounded(survey.line_checks(survey.line_distances(line_places(spark, d))), "length", digits=4)


def s12(spark, d):
    expected = spark.range(3, 12).select(F.concat(F.lit("L"), F.col("id"), F.lit(".dat")).alias("file"))
    return survey.inventory(expected, survey_lines(spark, d))


def r01(spark, d):
    g = event_grid(spark, d)
    t = anomalies.exact_quantiles(grid.valid(g), "value", [0.75])[0]
    best = metrics.ranking(metrics.metrics(predictions(spark, d))).where("rank = 1").select("candidate", "n")
    return interpretation.findings(grid.depth_profile(g), anomalies.components(g, t), best)


def f13(spark, d):
    """Properties as customers might have mapped them, and the analysis that fits each."""
    k = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k, pick(["RHO", "Vx", " CH4_content ", "Gas", "rho", "grade"], k).alias("value_name"), pick(["km/s", "ml/g", None, " km/s"], F.floor(k / 6)).alias("value_unit"), pick(["3d", "2D", None], F.floor(k / 24)).alias("dimension"))
    out = interpretation.analysis_profiles(rows)
    return out.select("c_custkey", "profile", "specialized", F.array_join(F.transform("disabled", lambda x: F.concat_ws(":", x["profile"], x["missing"])), ";").alias("disabled"))


def r02(spark, d):
    return interpretation.rule_cards(anomalies.ranked_components(event_grid(spark, d), 2, 5), interpretation.resolve_profile("RHO", "Ω·m")).select("direction", "rank", "letter", "title", "meaning", "limitation")


def places_3d(spark, d):
    """The measured places, each with the mean of its values and the least row number; x cells of odd and even number are the folds."""
    p = measured_3d(spark, d).groupBy("x", "y", "z").agg(F.min("source_row").alias("source_row"), F.avg("value").alias("value"))
    return p.withColumn("group_key", F.floor(F.col("x") / 4).cast("long"))


def two_folds(p):
    return validation.with_roles(p.select("source_row", "group_key", F.pmod("group_key", F.lit(2)).cast("int").alias("own")), 2)


def v14(spark, d):
    """Candidates of two algorithms by their own parameter names over two folds, in one run; one of them fails."""
    hand = {"variogram_model": MODEL["model"], "variogram_mode": "manual", "nugget": MODEL["nugget"], "sill": MODEL["nugget"] + MODEL["partial_sill"], "range": MODEL["range"]}
    found = [{"name": f"idw-{p:g}-{k}", "algorithm": "idw", "parameters": {"power": p, "neighbor_count": k}} for p in (1.5, 2.0, 3.0) for k in (16, 24, 32)]
    found += [{"name": f"kriging-{z:g}", "algorithm": "ordinary_kriging", "parameters": hand | {"neighbor_count": 2, "min_neighbors": 2, "z_scale": z}} for z in (0.5, 1.0, 2.0)]
    found += [{"name": "sill-too-small", "algorithm": "ordinary_kriging", "parameters": hand | {"sill": 1.0}}]
    p = places_3d(spark, d)
    return rounded(experiments.run(p, two_folds(p), found, ["x", "y", "z"]), "mae", "rmse", "r2", "bias", "coverage", digits=3)


def v15(spark, d):
    """Smooth interpolation and inverse distance behind the gates; the latter has values beyond the samples' bounds."""
    p = places_3d(spark, d)
    axes = tuple(grid.axes_from_points(p, ["x", "y", "z"]))
    found = [{"name": "smooth", "algorithm": "dsi_like", "parameters": {}}, {"name": "distance", "algorithm": "idw", "parameters": {}}]
    reference = [{"name": "reference", "algorithm": "idw", "parameters": {"power": 3.0}}]
    return rounded(conditional.evaluate_conditionally(p, two_folds(p), found, reference, axes), "rmse", "mae", "r2", "bias", "coverage", digits=4)


QUERIES = {
    "v14_candidate_matrix": v14, "v15_conditional": v15,
    "i02_kriging": i02, "i02_kriging_two": i02_two, "i02_kriging_anisotropic": i02_space, "i01_inverse_distance_z_scale": i01_z, "n01_sector_ellipsoid": n01_space, "i01_inverse_distance_sectors": i01_sectors, "x01_lag_bins": x01, "g16_result_analysis": g16, "i03_smooth_interpolation": i03, "i04_forest": i04, "i04_forest_folds": i04_folds, "i05_kriging_forest": i05, "v07_candidates": v07, "s09_survey_parse": s09, "f06_three_sigma": f06,
    "a21_exact_places": a21, "w05_line_checks": w05, "s12_inventory": s12, "r01_findings": r01, "f13_analysis_profiles": f13, "r02_rule_cards": r02,
}

LINES = """l AS (SELECT 'L' || (user_id % 9) || '.dat' AS file, event_id + 1 AS line_no, CASE WHEN event_id % 53 = 0 THEN '  ' WHEN event_id % 41 = 0 THEN '0.' || lpad((event_id % 200)::VARCHAR, 3, '0')
        ELSE ' 0.' || lpad((event_id % 200)::VARCHAR, 3, '0') || '   ' || CASE WHEN event_id % 29 = 0 THEN '1.#QNAN0' WHEN event_id % 31 = 0 THEN 'abc' ELSE floor(value)::BIGINT::VARCHAR END END AS text FROM events),
    b AS (SELECT *, min(line_no) OVER (PARTITION BY file) AS header FROM l WHERE trim(text) <> ''), t AS (SELECT file, line_no, regexp_split_to_array(trim(text), '\\s+') AS t FROM b WHERE line_no > header),
    p AS (SELECT file, line_no, try_cast(t[1] AS DOUBLE) AS wl, try_cast(t[2] AS DOUBLE) AS v, concat_ws(';', CASE WHEN len(t) <> 2 THEN 'column_count' END, CASE WHEN len(t) < 2 THEN 'v_empty' WHEN t[2] = '1.#QNAN0' THEN 'v_msvc_special' WHEN t[2] = 'abc' THEN 'v_not_numeric' END) AS flags FROM t),
    g AS (SELECT *, flags = '' AS is_valid FROM p)"""


def _two(u: str, v: str) -> str:
    """Ordinary kriging from two samples in closed form; (u, v) is the space in which distances count."""
    gamma = lambda h: f"(50 + 800 * (1 - exp(-{h} / 12)))"
    return f"""WITH {SQL_2D}, {TARGETS}, p AS (SELECT source_row, value, {u} AS u, {v} AS v FROM pts), t AS (SELECT query_id, {u} AS u, {v} AS v FROM q),
        n AS (SELECT query_id, p.source_row, p.value, p.u, p.v, sqrt(power(p.u - t.u, 2) + power(p.v - t.v, 2)) AS d, row_number() OVER (PARTITION BY query_id ORDER BY sqrt((t.u - p.u) * (t.u - p.u) + (t.v - p.v) * (t.v - p.v)), p.source_row) AS k FROM t CROSS JOIN p),
        s AS (SELECT a.query_id, a.value AS va, b.value AS vb, {gamma('a.d')} AS ga, {gamma('b.d')} AS gb, {gamma('sqrt(power(a.u - b.u, 2) + power(a.v - b.v, 2))')} AS g FROM n a JOIN n b ON a.query_id = b.query_id AND a.k = 1 AND b.k = 2),
        w AS (SELECT *, 0.5 + coalesce((ga - gb) / CASE WHEN g <> 50 THEN 50 - g END, 0) / 2 AS w FROM s)
        SELECT query_id, round(w * va + (1 - w) * vb, 4) AS value, round(w * ga + (1 - w) * gb + (ga + gb - 50 - g) / 2, 4) AS variance, 2::BIGINT AS n, false AS is_nodata FROM w"""


TARGETS_3D = "q AS (SELECT i AS query_id, (i % 10) * 4.3::DOUBLE AS x, ((i // 10) % 4) * 3.1::DOUBLE + 0.7::DOUBLE AS y, (i // 40) * 9.7::DOUBLE + 1.3::DOUBLE AS z FROM range(120) t(i))"
_LOCAL = [" + ".join(f"({m!r}) * o{c}" for m, c in zip(row, "xyz", strict=True)) for row in rotation_3d(30.0, 20.0, -10.0)]
SECTORS_3D = f"""o AS (SELECT query_id, source_row, value, p.x - q.x AS ox, p.y - q.y AS oy, p.z - q.z AS oz FROM q JOIN pts p ON ok AND abs(p.x - q.x) <= 5 AND abs(p.y - q.y) <= 5 AND abs(p.z - q.z) <= 5),
    l AS (SELECT *, {_LOCAL[0]} AS u, {_LOCAL[1]} AS v, {_LOCAL[2]} AS w FROM o),
    e AS (SELECT *, sqrt((u / 5) * (u / 5) + (v / 3) * (v / 3) + (w / 4) * (w / 4)) AS d, least(3, floor((atan2(w, v) + CASE WHEN atan2(w, v) < 0 THEN 2 * pi() ELSE 0 END) / (pi() / 2)))::INT AS sector FROM l WHERE (u / 5) * (u / 5) + (v / 3) * (v / 3) + (w / 4) * (w / 4) <= 1),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id, sector ORDER BY d, source_row) AS r FROM e),
    m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, source_row)::INT AS k, count(*) OVER (PARTITION BY query_id) AS n FROM s WHERE r <= 2),
    f AS (SELECT * FROM m WHERE n >= 3 AND k <= 6)"""
PLACES = f"""{SQL_3D}, p AS MATERIALIZED (SELECT x, y, z, min(source_row) AS row, avg(value) AS value, (floor(x / 4)::BIGINT % 2 + 2) % 2 AS own FROM pts WHERE ok GROUP BY x, y, z),
    m AS (SELECT * FROM (VALUES (0.5), (1.0), (2.0)) t(zs)),
    d AS MATERIALIZED (SELECT zs, q.row, q.own, q.value AS observed, s.row AS source, s.value, sqrt(power(s.x - q.x, 2) + power(s.y - q.y, 2) + power(zs * s.z - zs * q.z, 2)) AS d, row_number() OVER (PARTITION BY zs, q.row ORDER BY sqrt(power(s.x - q.x, 2) + power(s.y - q.y, 2) + power(zs * s.z - zs * q.z, 2)), s.row) AS k
        FROM m CROSS JOIN p q JOIN p s ON q.own <> s.own QUALIFY k <= CASE WHEN zs = 1 THEN 32 ELSE 2 END)"""
GAMMA = lambda h: f"(50 + 800 * (1 - exp(-{h} / 12)))"
ORACLE = {
    "v14_candidate_matrix": f"""WITH {PLACES}, w AS (SELECT printf('idw-%g-%d', power, most) AS candidate, power::DOUBLE AS power, most FROM (VALUES (1.5), (2.0), (3.0)) a(power), (VALUES (16), (24), (32)) b(most)),
        i AS (SELECT candidate, row, any_value(observed) AS observed, sum(value / pow(d, power)) / sum(1 / pow(d, power)) AS predicted FROM d JOIN w ON k <= most WHERE zs = 1 GROUP BY ALL),
        t AS (SELECT a.zs, a.row, a.observed, a.value AS va, b.value AS vb, {GAMMA('a.d')} AS ga, {GAMMA('b.d')} AS gb, {GAMMA('sqrt(power(u.x - v.x, 2) + power(u.y - v.y, 2) + power(a.zs * u.z - a.zs * v.z, 2))')} AS g
            FROM d a JOIN d b ON a.zs = b.zs AND a.row = b.row AND a.k = 1 AND b.k = 2 JOIN p u ON u.row = a.source JOIN p v ON v.row = b.source),
        c AS (SELECT printf('kriging-%g', zs) AS candidate, row, observed, va * (0.5 + (ga - gb) / (50 - g) / 2) + vb * (0.5 - (ga - gb) / (50 - g) / 2) AS predicted FROM t),
        o AS (FROM i UNION ALL FROM c), s AS (SELECT candidate, count(*) AS n, avg(abs(predicted - observed)) AS mae, sqrt(avg(power(predicted - observed, 2))) AS rmse, 1 - sum(power(predicted - observed, 2)) / (var_pop(observed) * count(*)) AS r2, avg(predicted - observed) AS bias FROM o GROUP BY candidate),
        r AS (SELECT *, row_number() OVER (ORDER BY rmse, mae, r2 DESC, candidate)::INT AS rank FROM s)
        SELECT candidate, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(r2, 3) AS r2, round(bias, 3) AS bias, 1.0::DOUBLE AS coverage, 'succeeded' AS status, NULL::VARCHAR AS error, rank FROM r
        UNION ALL SELECT 'sill-too-small', 0, NULL, NULL, NULL, NULL, NULL, 'failed', 'VARIOGRAM_FIT_FAILED', NULL""",
    "i02_kriging_two": _two("x", "y"),
    "i02_kriging_anisotropic": _two("cos(radians(30)) * x + sin(radians(30)) * y", "2 * (-sin(radians(30)) * x + cos(radians(30)) * y)"),
    "i01_inverse_distance_z_scale": f"""WITH {SQL_3D}, {TARGETS_3D}, n AS (SELECT query_id, source_row, value, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(2.5 * p.z - 2.5 * q.z, 2)) AS d FROM q CROSS JOIN pts p WHERE ok),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, source_row) AS k FROM n QUALIFY k <= 8)
        SELECT query_id, round(sum(value / (d * d)) / sum(1 / (d * d)), 4) AS value, count(*) AS n, false AS is_nodata FROM k GROUP BY query_id""",
    "n01_sector_ellipsoid": f"WITH {SQL_3D}, {TARGETS_3D}, {SECTORS_3D} SELECT query_id, source_row, round(value, 6) AS value, round(d, 6) AS d, sector, k FROM f",
    "i01_inverse_distance_sectors": f"""WITH {SQL_3D}, {TARGETS_3D}, {SECTORS_3D}, a AS (SELECT query_id, count(*) AS n, sum(value / (ox * ox + oy * oy + oz * oz)) / sum(1 / (ox * ox + oy * oy + oz * oz)) AS value FROM f GROUP BY query_id)
        SELECT q.query_id, round(value, 4) AS value, coalesce(n, 0) AS n, n IS NULL AS is_nodata FROM q LEFT JOIN a ON q.query_id = a.query_id""",
    "x01_lag_bins": """WITH p AS (SELECT s_suppkey AS i, s_nationkey::DOUBLE AS x, (s_suppkey % 13)::DOUBLE AS y, s_acctbal AS v FROM supplier), h AS (SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS h, 0.5 * power(a.v - b.v, 2) AS g FROM p a JOIN p b ON a.i < b.i),
        w AS (SELECT max(h) / 12 AS w FROM h)
        SELECT least(11, greatest(0, ceil(h / w) - 1))::INT AS bin, round((any_value(least(11, greatest(0, ceil(h / w) - 1))) + 0.5) * any_value(w), 4) AS center, round(avg(g), 4) AS semivariance, count(*) AS pair_count FROM h, w GROUP BY 1""",
    "f13_analysis_profiles": """WITH m AS (SELECT c_custkey, trim(['RHO', 'Vx', ' CH4_content ', 'Gas', 'rho', 'grade'][c_custkey % 6 + 1]) AS name, coalesce(trim(['km/s', 'ml/g', NULL, ' km/s'][c_custkey // 6 % 4 + 1]), '') AS unit, coalesce(['3d', '2d', NULL][c_custkey // 24 % 3 + 1], '3d') AS dim FROM customer),
        f AS (SELECT *, name = 'RHO' AS r, name = 'Vx' AND unit = 'km/s' AS v, lower(name) IN ('ch4', 'ch4_content', 'gas', 'gas_content') AS c FROM m),
        p AS (SELECT *, CASE WHEN dim <> '3d' THEN 'generic_3d' WHEN r THEN 'resistivity' WHEN v THEN 'microseismic_velocity' WHEN c THEN 'gas_content' ELSE 'generic_3d' END AS profile FROM f)
        SELECT c_custkey, profile, profile <> 'generic_3d' AS specialized, CASE WHEN profile = 'generic_3d' THEN concat_ws(';', 'resistivity:' || CASE WHEN r THEN 'dimension=3d' ELSE 'value_name=RHO' END,
            'microseismic_velocity:' || CASE WHEN v THEN 'dimension=3d' WHEN name = 'Vx' THEN 'value_unit=km/s' ELSE 'value_name=Vx' END, 'gas_content:' || CASE WHEN c THEN 'dimension=3d' ELSE 'value_name∈{CH4,CH4_content,gas,gas_content}' END) END AS disabled FROM p""",
    "r01_findings": f"""{LABELS}, w AS (SELECT *, CASE WHEN ix IN (0, 9) THEN 2.5 ELSE 5 END * CASE WHEN iy IN (0, 11) THEN 1 ELSE 2 END * CASE WHEN iz IN (0, 5) THEN 1 ELSE 2 END AS w FROM n JOIN l USING (id)),
        c AS (SELECT label, count(*) AS n, sum(w) AS measure, max(value) AS top, bool_or(ix IN (0, 9) OR iy IN (0, 11) OR iz IN (0, 5)) AS touches FROM w GROUP BY label), k AS (SELECT *, row_number() OVER (ORDER BY label) AS id FROM c),
        b AS (SELECT least(7, floor((z + 10) / 1.25))::BIGINT AS bin, count(*) AS n, count(*) FILTER (WHERE value >= hi) / count(*) AS share FROM g, q WHERE value IS NOT NULL GROUP BY 1),
        x AS (SELECT event_id, value AS o, value + event_id % 7 - 3 AS a, value * 1.02 - 1 AS s, event_id % 37 <> 0 AND event_id % 53 <> 0 AS ok FROM events), y AS (SELECT unnest([{{'c': 'shifted', 'e': sqrt(avg((a - o) * (a - o)))}}, {{'c': 'scaled', 'e': sqrt(avg((s - o) * (s - o)))}}, {{'c': 'constant', 'e': sqrt(avg((60 - o) * (60 - o)))}}], recursive := true), count(*) AS n FROM x WHERE ok)
        SELECT 'dominant_depth' AS finding, bin AS subject, n, NULL::VARCHAR AS label FROM (SELECT * FROM b ORDER BY share DESC, bin LIMIT 1) UNION ALL SELECT 'largest_component', id, n, NULL FROM (SELECT * FROM k ORDER BY measure DESC, top DESC, id LIMIT 1) UNION ALL SELECT 'boundary_contacts', NULL, count(*) FILTER (WHERE touches), NULL FROM k
        UNION ALL SELECT 'uncertainty', NULL, NULL, 'missing' UNION ALL SELECT 'model', NULL, n, c FROM (SELECT * FROM y ORDER BY e LIMIT 1)""",
    "r02_rule_cards": f"""{RANKED} SELECT direction, rank, letter, CASE direction WHEN 'high' THEN 'High resistivity' ELSE 'Low resistivity' END AS title, CASE direction WHEN 'high' THEN 'often dense or dry rock, or a resistive rock type' ELSE 'often water, fractures, clay or another conductor' END AS meaning,
        CASE direction WHEN 'high' THEN 'high resistivity alone doesn''t prove sound rock' ELSE 'low resistivity alone doesn''t prove water' END || CASE WHEN touches THEN '; reaches the model''s edge, so it may be larger' ELSE '' END AS limitation FROM ranked WHERE rank <= 3""",
    "s09_survey_parse": f"WITH {LINES} SELECT file, line_no, wl, v, flags, is_valid FROM g",
    "f06_three_sigma": f"""WITH {LINES}, s AS (SELECT avg(wl) AS wm, stddev_samp(wl) AS ws, avg(v) AS vm, stddev_samp(v) AS vs FROM g WHERE is_valid)
        SELECT file, concat_ws(';', CASE WHEN abs(wl - wm) > 2 * ws THEN 'wl_beyond' END, CASE WHEN abs(v - vm) > 2 * vs THEN 'v_beyond' END) AS reasons, count(*) AS n FROM g, s WHERE is_valid GROUP BY ALL""",
    "a21_exact_places": f"""WITH {LINES}, r AS (SELECT (line_no % 7)::DOUBLE AS x, (line_no % 5)::DOUBLE AS y, -wl * 1000 AS z, v, line_no FROM g WHERE is_valid)
        SELECT x, y, round(z, 6) AS z, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(stddev_samp(v), 6) AS std, count(*) AS n, round(max(v) - min(v), 6) AS spread, string_agg(line_no::VARCHAR, ';' ORDER BY line_no) AS sample_ids, min(line_no) AS first_seq, count(*) > 1 AND max(v) > min(v) AS is_conflict FROM r GROUP BY x, y, r.z""",
    "w05_line_checks": """WITH p AS (SELECT user_id % 9 AS line_id, event_id AS seq, (event_id % 100)::DOUBLE AS x, hour(ts)::DOUBLE AS y FROM events),
        s AS (SELECT line_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM p WINDOW w AS (PARTITION BY line_id ORDER BY seq))
        SELECT line_id, count(*) AS points, round(coalesce(sum(step), 0), 4) AS length, true AS monotone FROM s GROUP BY line_id""",
    "s12_inventory": f"""WITH {LINES}, e AS (SELECT 'L' || i || '.dat' AS file FROM range(3, 12) t(i)), f AS (SELECT DISTINCT file FROM l)
        SELECT coalesce(e.file, f.file) AS file, CASE WHEN e.file IS NULL THEN 'unexpected' WHEN f.file IS NULL THEN 'missing' ELSE 'present' END AS status FROM e FULL JOIN f ON e.file = f.file""",
}
