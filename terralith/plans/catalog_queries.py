"""Catalogs, experiments, stored tables, voxels and survey totals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import catalog as C
from terralith.operators import experiments as E
from terralith.operators import grid as G
from terralith.operators import survey, validation, voxels
from terralith.plans.grid_queries import event_grid
from terralith.plans.statistics_queries import rounded
from terralith.sources import provenance, stored
from terralith.sources.points import SQL_2D, SQL_3D, points_2d, points_3d


def cases(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("case_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 == 0).alias("trashed"))


def experiments(spark, d):
    k = F.col("c_custkey")
    algorithm = F.when(k % 3 == 0, "idw").otherwise("ordinary_kriging")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("experiment_id"), F.col("c_nationkey").cast("long").alias("case_id"), F.concat(F.lit("d"), k % 5).alias("dataset"), algorithm.alias("algorithm"), F.lit("spatial_kfold").alias("method"), (F.lit(5) - k % 2).alias("folds"), F.lit(7).alias("seed"), F.lit(None).cast("double").alias("holdout_fraction"), F.concat(F.lit("f"), k % 4).alias("fold_fingerprint"))


def runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def candidates(spark, d):
    k = F.col("o_orderkey")
    rmse = F.when(k % 19 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000)
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("candidate_id"), k.alias("run_id"), F.when(k % 11 == 0, "failed").otherwise("succeeded").alias("status"), rmse.alias("rmse"), (F.col("o_totalprice") / 1250).alias("mae"), F.when(k % 7 != 0, 1 - F.col("o_totalprice") / 1e6).alias("r2"), ((k % 13 - 6) / 10).alias("bias"),
        (F.lit(100) + k % 2).alias("common_valid_count"), F.concat(F.lit("p"), k % 2).alias("population_fingerprint"), F.concat(F.lit('{"k":'), k % 9, F.lit("}")).alias("parameters"),
    )


def chain(spark, d):
    return C.candidates_of_runs(experiments(spark, d), runs(spark, d), candidates(spark, d))


def j02(spark, d):
    return chain(spark, d).select("candidate_id", "run_id", "experiment_id", "dataset", "selectable")


def w10(spark, d):
    return C.latest(runs(spark, d), ["experiment_id"], ["created_at", "run_id"]).select("experiment_id", "run_id", "status")


def w11(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("dataset"), F.col("l_linenumber").alias("version"))
    return C.next_version(lines, "dataset")


def l06(spark, d):
    return C.newest(runs(spark, d), [F.desc("created_at"), F.desc("run_id")], 50).select("run_id", "experiment_id", "status")


def u07(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("preset").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    r = spark.read.parquet(f"{d}/region.parquet").select(F.lit("legacy").alias("kind"), F.col("r_name").alias("name"))
    return C.case_cards(s, r, cases(spark, d).select(F.lit("upload").alias("kind"), "name", "trashed"))


def a32(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("long").alias("case_id"))
    e = experiments(spark, d)
    results = candidates(spark, d).join(runs(spark, d).select("run_id", "experiment_id"), "run_id").join(e.select("experiment_id", "case_id"), "experiment_id").where("case_id % 4 <> 3")
    return C.case_counts(cases(spark, d), s, e, results)


def v17(spark, d):
    return C.comparable_catalog(chain(spark, d))


def v11(spark, d):
    return rounded(C.baseline_of(chain(spark, d)), "rmse_change", "rmse_percent", "mae_change", "mae_percent")


def selection(spark, d):
    return chain(spark, d).where("dataset = 'd1'").orderBy("candidate_id").limit(4)


def v12(spark, d):
    return C.mismatches(selection(spark, d))


def v12_ranking(spark, d):
    return C.ranked(selection(spark, d))


def v18(spark, d):
    k = F.col("o_orderkey")
    versions = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), k.alias("version"), (k % 5 == 0).alias("abandoned"), (k % 3 != 0).alias("mapped"), (k % 4 != 0).alias("confirmed"), (k % 17 == 0).alias("blocked"), k.cast("string").alias("file_hash"), F.when(k % 23 == 0, "other").otherwise(k.cast("string")).alias("found_hash"))
    return C.preparation_state(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id")), versions)


def i06(spark, d):
    return E.capabilities(points_3d(spark, d))


def v10(spark, d):
    """Each preset's candidates, and for how many of the measured places there are as many others as it looks at."""
    rows = [(case, i, c["algorithm"], ";".join(f"{k}={v}" for k, v in sorted(c["parameters"].items())), c["parameters"].get("neighbor_count", 0)) for case in E.PRESETS for i, c in enumerate(E.preset_candidates(case))]
    n = points_3d(spark, d).where("is_numeric_valid").select("x", "y", "z").distinct().agg(F.count("*").alias("places"))
    every = spark.createDataFrame(rows, "case string, i int, algorithm string, parameters string, wanted int").join(F.broadcast(n))  # one row
    return every.select("case", "i", "algorithm", "parameters", "places", (F.col("places") > F.col("wanted")).alias("enough"))


def v08(spark, d):
    """A search over two powers and two numbers of neighbours; spatial cells of even and odd number are the folds."""
    p = points_2d(spark, d)
    plan = validation.with_roles(validation.groups_2d(p, 5).select("source_row", "group_key", (F.col("group_key") % 2).cast("int").alias("own")), 2)
    found = [c["parameters"] | {"algorithm": "idw", "name": f"k{c['parameters']['k']}p{c['parameters']['power']:g}"} for c in E.definitions("idw", {}, {"k": [4, 8], "power": [1.0, 2.0]})]
    return rounded(E.run(p, plan, found).drop("error"), "mae", "rmse", "r2", "bias", "coverage", digits=4)


def g03(spark, d):
    axes = G.axes_from_points(points_3d(spark, d), ["x", "y", "z"])
    return spark.createDataFrame([(n, a.low, a.high, a.nodes) for n, a in zip("xyz", axes, strict=True)], "axis string, low double, high double, nodes int")


def g05(spark, d):
    return rounded(G.chart_slice(event_grid(spark, d), "x", 4), "value", "relative")


def k08(spark, d):
    return rounded(G.slice_rows(event_grid(spark, d), "y", 3), "value")


def p15(spark, d):
    return rounded(G.render_profile(event_grid(spark, d), "builtin_legacy"), "low", "high")


def l03(spark, d):
    return G.bounded(points_2d(spark, d), 300).select("source_row")


def tiles(spark, d):
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    return e.select(F.concat(F.lit("t"), k % 7).alias("tile"), (F.col("user_id") % 40 + 0.0004).alias("x"), (k % 30).cast("double").alias("y"), F.hour("ts").cast("double").alias("z"), (F.col("user_id") % 40 * 30 + k % 30 + F.when(k % 97 == 0, 0.5).otherwise(0.0)).cast("double").alias("weight"))


def a30(spark, d):
    return voxels.conflicts(tiles(spark, d))


def a30_cells(spark, d):
    return voxels.distinct_cells(tiles(spark, d).where("weight = floor(weight)"))


def f10(spark, d):
    return voxels.violations(tiles(spark, d), 100, (0.5, 2.0), 10**9, (0.0, 1000.0, 0.1), {"x": (0.0, 40.0), "y": (0.0, 20.0), "z": (0.0, 23.0)}, 0.5)


def a29(spark, d):
    points = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("line_id"), F.col("c_custkey").alias("point_id"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("point_id"), F.lit(1).cast("long").alias("source_records"), F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).cast("long").alias("valid"))
    return survey.line_totals(points, o.where("point_id % 3 <> 0"))


def s13(spark, d):
    """Predictions as an outside tool writes them, against the truth, by depth band."""
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    truth = stored.read_truth(e.select(F.col("user_id").alias("X"), F.hour("ts").alias("Y"), (-(k * 7) % 900).alias("Z"), F.col("value").alias("RHO")))
    made = e.select(k.alias("SmUserID"), F.when(k % 29 == 0, "-9999").when(k % 31 == 0, "x").otherwise((F.col("value") + k % 5 - 2).cast("string")).alias("Attribute"), F.concat(F.lit("POINT ("), F.col("user_id") + F.when(k % 37 == 0, 1).otherwise(0), F.lit(" "), F.hour("ts"), F.lit(")")).alias("Geometry"))
    out, told = stored.import_predictions(made, truth, "tool")
    by = out.groupBy("depth_band").agg(F.count("*").alias("n"), F.count_if("is_nodata").alias("nodata"), F.avg("error").alias("error"), F.avg("abs_error").alias("abs_error"))
    return rounded(by.withColumn("xy_mismatches", F.lit(told["xy_mismatch_count"]).cast("long")), "error", "abs_error")


def s15(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    rows = stored.check_preset(p, ["p_partkey", "p_size", "p_retailprice"], p.count())
    return rounded(rows.agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.avg("p_retailprice").alias("price")), "price")


def s22(spark, d):
    """The keys of a provenance table with every kind of failure, against the rows it stands beside."""
    k = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select((k + 1).alias("source_row"), k)
    kept = rows.where(k % 97 != 0)
    table = kept.select(F.when(k % 83 != 0, F.col("source_row")).alias("source_row")).unionByName(kept.where(k % 89 == 0).select((-k).alias("source_row"))).unionByName(kept.where(k % 71 == 0).select("source_row"))
    return provenance.key_counts(table, rows.select("source_row"))


QUERIES = {
    "s22_provenance_keys": s22,
    "j02_candidate_chain": j02, "w10_latest_runs": w10, "w11_next_versions": w11, "l06_newest_runs": l06, "u07_case_cards": u07, "a32_case_counts": a32, "v17_catalog": v17, "v11_baselines": v11,
    "v12_mismatches": v12, "v12_ranking": v12_ranking, "v18_preparation": v18, "i06_capabilities": i06, "v10_presets": v10, "v08_experiment_run": v08, "g03_axes": g03, "g05_chart_slice": g05,
    "k08_slice_rows": k08, "p15_render_profile": p15, "l03_bounded_rows": l03, "a30_voxel_conflicts": a30, "a30_voxel_cells": a30_cells, "f10_voxel_rules": f10, "a29_line_totals": a29, "s13_predictions": s13, "s15_preset": s15,
}

CHAIN = """e AS (SELECT c_custkey AS experiment_id, c_nationkey AS case_id, 'd' || (c_custkey % 5) AS dataset, CASE WHEN c_custkey % 3 = 0 THEN 'idw' ELSE 'ordinary_kriging' END AS algorithm, 5 - c_custkey % 2 AS folds, 'f' || (c_custkey % 4) AS fold_fingerprint FROM customer),
    r AS (SELECT o_orderkey AS run_id, o_custkey AS experiment_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS run_status, o_orderdate AS created_at FROM orders),
    k AS (SELECT o_orderkey AS candidate_id, o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / 1000 END AS rmse, o_totalprice / 1250 AS mae, CASE WHEN o_orderkey % 7 <> 0 THEN 1 - o_totalprice / 1e6 END AS r2,
          (o_orderkey % 13 - 6) / 10 AS bias, 100 + o_orderkey % 2 AS common_valid_count, 'p' || (o_orderkey % 2) AS population, '{"k":' || (o_orderkey % 9) || '}' AS parameters FROM orders),
    c AS (SELECT * REPLACE (rmse AS rmse), status = 'succeeded' AND run_status = 'succeeded' AS selectable FROM k JOIN r USING (run_id) JOIN e USING (experiment_id))"""
TILES = "t AS (SELECT 't' || (event_id % 7) AS tile, round(user_id % 40 + 0.0004, 3)::DOUBLE AS x, (event_id % 30)::DOUBLE AS y, hour(ts)::DOUBLE AS z, (user_id % 40 * 30 + event_id % 30 + CASE WHEN event_id % 97 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS weight FROM events)"
GRID = """g AS (SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, ix * 5.0::DOUBLE AS x, iy * 2.0::DOUBLE AS y, (iz * 2.0 - 10)::DOUBLE AS z, CASE WHEN (ix * 7 + iy * 3 + iz) % 11 <> 0 THEN m END AS value
    FROM range(10) a(ix) CROSS JOIN range(12) b(iy) CROSS JOIN range(6) c(iz) LEFT JOIN (SELECT user_id % 10 AS ex, hour(ts) % 12 AS ey, event_id % 6 AS ez, avg(value) AS m FROM events GROUP BY ALL) ON ix = ex AND iy = ey AND iz = ez)"""
ORACLE = {
    "s22_provenance_keys": """WITH r AS (SELECT event_id AS k, event_id + 1 AS key FROM events), t AS (SELECT CASE WHEN k % 83 <> 0 THEN key END AS key FROM r WHERE k % 97 <> 0 UNION ALL SELECT -k FROM r WHERE k % 97 <> 0 AND k % 89 = 0 UNION ALL SELECT key FROM r WHERE k % 97 <> 0 AND k % 71 = 0)
        SELECT (SELECT count(*) FROM t WHERE key IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT key FROM t WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)) AS repeated_keys, (SELECT count(DISTINCT key) FROM t WHERE key IN (SELECT key FROM r)) AS matched,
               (SELECT count(DISTINCT key) FROM r ANTI JOIN t USING (key)) AS unmatched, (SELECT count(DISTINCT key) FROM t WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM r)) AS unused, (SELECT count(*) FROM (SELECT key FROM r GROUP BY key HAVING count(*) > 1)) AS repeated_rows""",
    "j02_candidate_chain": f"WITH {CHAIN} SELECT candidate_id, run_id, experiment_id, dataset, selectable FROM c",
    "w10_latest_runs": f"WITH {CHAIN} SELECT experiment_id, run_id, run_status AS status FROM r QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY created_at DESC, run_id DESC) = 1",
    "w11_next_versions": "SELECT l_orderkey AS dataset, max(l_linenumber) + 1 AS next FROM lineitem GROUP BY l_orderkey",
    "l06_newest_runs": f"WITH {CHAIN} SELECT run_id, experiment_id, run_status AS status FROM r ORDER BY created_at DESC, run_id DESC LIMIT 50",
    "u07_case_cards": "SELECT 'preset' AS kind, s_name AS name, s_acctbal AS score, NULL::BOOLEAN AS trashed FROM supplier UNION ALL SELECT 'legacy', r_name, NULL, NULL FROM region UNION ALL SELECT 'upload', n_name, NULL, n_nationkey % 3 = 0 FROM nation",
    "a32_case_counts": f"""WITH {CHAIN}, s AS (SELECT s_nationkey AS case_id, count(*) AS n FROM supplier GROUP BY 1), x AS (SELECT case_id, count(*) AS n FROM e GROUP BY 1), y AS (SELECT case_id, count(*) AS n FROM c WHERE case_id % 4 <> 3 GROUP BY 1)
        SELECT n_nationkey AS case_id, coalesce(s.n, 0) AS datasets, coalesce(x.n, 0) AS experiments, coalesce(y.n, 0) AS results, n_nationkey % 3 = 0 AS can_restore, n_nationkey % 3 = 0 AND y.n IS NULL AS can_purge
        FROM nation LEFT JOIN s ON n_nationkey = s.case_id LEFT JOIN x ON n_nationkey = x.case_id LEFT JOIN y ON n_nationkey = y.case_id""",
    "v17_catalog": f"WITH {CHAIN} SELECT dataset, experiment_id, count(*) AS n, string_agg(candidate_id::VARCHAR, ';' ORDER BY created_at DESC, candidate_id) AS candidates FROM c WHERE selectable AND rmse IS NOT NULL GROUP BY dataset, experiment_id",
    "v11_baselines": f"""WITH {CHAIN}, b AS (SELECT x.candidate_id, y.candidate_id AS baseline_id, x.rmse, x.mae, y.rmse AS b_rmse, y.mae AS b_mae FROM c x JOIN c y ON x.candidate_id <> y.candidate_id AND x.dataset = y.dataset AND x.folds = y.folds AND x.fold_fingerprint = y.fold_fingerprint AND x.common_valid_count = y.common_valid_count
            AND y.algorithm = 'ordinary_kriging' AND y.status = 'succeeded' AND y.rmse IS NOT NULL WHERE x.rmse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x.candidate_id ORDER BY y.rmse, y.candidate_id) = 1)
        SELECT c.candidate_id, baseline_id, round(b.rmse - b_rmse, 6) AS rmse_change, round((b.rmse - b_rmse) / b_rmse * 100, 6) AS rmse_percent, round(b.mae - b_mae, 6) AS mae_change, round((b.mae - b_mae) / b_mae * 100, 6) AS mae_percent,
               b.rmse < b_rmse AS improved, CASE WHEN baseline_id IS NULL THEN 'ML_KRIGING_BASELINE_NOT_COMPARABLE' END AS reason FROM c LEFT JOIN b ON c.candidate_id = b.candidate_id""",
    "v12_mismatches": f"""WITH {CHAIN}, s AS (SELECT * FROM c WHERE dataset = 'd1' ORDER BY candidate_id LIMIT 4)
        SELECT 'validation_folds_mismatch' AS code FROM s HAVING count(DISTINCT folds) > 1 UNION SELECT 'fold_fingerprint_mismatch' FROM s HAVING count(DISTINCT fold_fingerprint) > 1 UNION SELECT 'common_valid_count_mismatch' FROM s HAVING count(DISTINCT common_valid_count) > 1
        UNION SELECT 'metric_population_fingerprint_mismatch' FROM s HAVING count(DISTINCT population) > 1 UNION SELECT 'candidate_not_succeeded:' || candidate_id FROM s WHERE NOT selectable UNION SELECT 'nan_rmse:' || candidate_id FROM s WHERE rmse IS NULL""",
    "v12_ranking": f"WITH {CHAIN}, s AS (SELECT * FROM c WHERE dataset = 'd1' ORDER BY candidate_id LIMIT 4) SELECT candidate_id, row_number() OVER (ORDER BY coalesce(rmse, 'nan'::DOUBLE), mae, r2 DESC NULLS LAST, parameters, candidate_id::VARCHAR)::INT AS rank FROM s",
    "v18_preparation": """WITH l AS (SELECT o_custkey AS case_id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1)
        SELECT c_custkey AS case_id, CASE WHEN k IS NULL THEN 'needs_upload' WHEN k % 17 = 0 OR k % 23 = 0 THEN 'blocked' WHEN k % 3 = 0 THEN 'mapping' WHEN k % 4 = 0 THEN 'quality_review' ELSE 'ready' END AS state FROM customer LEFT JOIN l ON c_custkey = case_id""",
    "i06_capabilities": f"""WITH {SQL_3D} SELECT a AS algorithm, c AS capability, CASE WHEN a = 'ordinary_kriging' OR c IN ('spatial_fold_inspection', 'empirical_error_scale', 'anomaly_extraction', 'candidate_comparison') OR (a = 'idw' AND c IN ('z_scale_weight_distance', 'search_neighborhood', 'sector_neighbor_limits')) THEN 'supported' ELSE 'not_applicable' END AS state,
            CASE WHEN a = 'dsi_like' THEN (SELECT count(*) FROM pts WHERE ok AND z IS NOT NULL) ELSE (SELECT count(*) FROM pts WHERE ok) END AS samples
        FROM (VALUES ('idw'), ('ordinary_kriging'), ('dsi_like')) x(a) CROSS JOIN (VALUES ('empirical_variogram'), ('model_anisotropy'), ('z_scale_weight_distance'), ('search_neighborhood'), ('sector_neighbor_limits'), ('native_kriging_std'), ('spatial_fold_inspection'), ('empirical_error_scale'), ('anomaly_extraction'), ('candidate_comparison')) y(c)""",
    "v10_presets": f"""WITH {SQL_3D}, m(i, m) AS (VALUES (0, 'spherical'), (1, 'exponential'), (2, 'gaussian')), n AS (SELECT count(*) AS places FROM (SELECT DISTINCT x, y, z FROM pts WHERE ok)), c AS (
        SELECT 'resistivity' AS "case", i::INT AS i, a AS algorithm, p AS parameters FROM (VALUES (0, 'idw', 'neighbor_count=24;power=2.0'), (1, 'ordinary_kriging', 'neighbor_count=16;variogram_model=spherical'), (2, 'ordinary_kriging', 'neighbor_count=24;variogram_model=spherical'), (3, 'ordinary_kriging', 'neighbor_count=16;variogram_model=exponential'), (4, 'ordinary_kriging', 'neighbor_count=24;variogram_model=exponential'), (5, 'dsi_like', 'neighbor_connectivity=6'), (6, 'dsi_like', 'neighbor_connectivity=26')) t(i, a, p)
        UNION ALL SELECT 'microseismic', (m.i * 9 + n.i * 3 + z.i)::INT, 'ordinary_kriging', 'neighbor_count=' || n.n || ';variogram_model=' || m.m || ';z_scale=' || z.z FROM m, (VALUES (0, 12), (1, 24), (2, 36)) n(i, n), (VALUES (0, '0.5'), (1, '1.0'), (2, '2.0')) z(i, z)
        UNION ALL SELECT 'gas', (p.i * 3 + n.i)::INT, 'idw', 'neighbor_count=' || n.n || ';power=' || p.p FROM (VALUES (0, '1.5'), (1, '2.0'), (2, '3.0')) p(i, p), (VALUES (0, 16), (1, 24), (2, 32)) n(i, n)
        UNION ALL SELECT 'gas', (9 + m.i * 2 + n.i)::INT, 'ordinary_kriging', 'neighbor_count=' || n.n || ';variogram_model=' || m.m FROM m, (VALUES (0, 16), (1, 24)) n(i, n) WHERE m.i < 2)
        SELECT "case", i, algorithm, parameters, places, places > coalesce(try_cast(regexp_extract(parameters, 'neighbor_count=([0-9]+)', 1) AS INT), 0) AS enough FROM c, n""",
    "v08_experiment_run": f"""WITH {SQL_2D}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
        f AS MATERIALIZED (SELECT pts.*, (least(3, floor((x - x0) / ((x1 - x0) / 4))) * 4 + least(3, floor((y - y0) / ((y1 - y0) / 4))))::BIGINT % 2 AS fold FROM pts, b),
        d AS (SELECT q.source_row, q.value AS observed, s.value, s.source_row AS row, sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) AS d FROM f q JOIN f s ON q.fold <> s.fold),
        n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY d, row) AS k FROM d QUALIFY k <= 8),
        p AS (SELECT 'k' || c.k || 'p' || c.p::INT AS candidate, source_row, any_value(observed) AS observed, sum(value / power(d, c.p)) / sum(1 / power(d, c.p)) AS predicted FROM n, (VALUES (4, 1.0), (4, 2.0), (8, 1.0), (8, 2.0)) c(k, p) WHERE n.k <= c.k GROUP BY ALL),
        s AS (SELECT candidate, count(*) AS n, avg(abs(predicted - observed)) AS mae, sqrt(avg(power(predicted - observed, 2))) AS rmse, 1 - sum(power(predicted - observed, 2)) / (var_pop(observed) * count(*)) AS r2, avg(predicted - observed) AS bias FROM p GROUP BY candidate)
        SELECT candidate, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2, round(bias, 4) AS bias, 1.0::DOUBLE AS coverage, 'succeeded' AS status, row_number() OVER (ORDER BY rmse, mae, r2 DESC, candidate)::INT AS rank FROM s""",
    "g03_axes": """WITH b AS (SELECT min(o_custkey % 40)::DOUBLE AS x0, max(o_custkey % 40)::DOUBLE AS x1, min(month(o_orderdate))::DOUBLE AS y0, max(month(o_orderdate))::DOUBLE AS y1, min(day(o_orderdate))::DOUBLE AS z0, max(day(o_orderdate))::DOUBLE AS z1 FROM orders)
        SELECT 'x' AS axis, x0 AS low, x1 AS high, 11 AS nodes FROM b UNION ALL SELECT 'y', y0, y1, 11 FROM b UNION ALL SELECT 'z', z0, z1, 11 FROM b""",
    "g05_chart_slice": f"WITH {GRID} SELECT iz AS row, iy AS column, z AS row_coord, y AS column_coord, x AS coordinate, round(4 / 9, 6) AS relative, round(value, 6) AS value, value IS NULL AS masked FROM g WHERE ix = 4".replace("AS row,", 'AS "row",').replace("AS column,", 'AS "column",'),
    "k08_slice_rows": f"WITH {GRID} SELECT x, y, z, round(value, 6) AS value, value IS NULL AS is_nodata FROM g WHERE iy = 3",
    "p15_render_profile": f"WITH {GRID}, s AS (SELECT min(value) AS low, max(value) AS high FROM g) SELECT round(low, 6) AS low, round(high, 6) AS high, low > 0 AS log_available, CASE WHEN low > 0 THEN 'log' ELSE 'linear' END AS scale, 'native-spectrum' AS palette FROM s",
    "l03_bounded_rows": "SELECT p_partkey + 1 AS source_row FROM part WHERE p_partkey % greatest(1, ceil((SELECT count(*) FROM part) / 300)::BIGINT) = 0",
    "a30_voxel_conflicts": f"WITH {TILES} SELECT x, y, z, count(*) AS tiles, min(weight) AS low, max(weight) AS high FROM t GROUP BY x, y, z HAVING max(weight) - min(weight) > 1e-4",
    "a30_voxel_cells": f"WITH {TILES} SELECT x, y, z, arg_min(weight, tile) AS weight FROM t WHERE weight = floor(weight) GROUP BY x, y, z",
    "f10_voxel_rules": f"WITH {TILES} SELECT 'count_window' AS rule, count(*) AS n FROM t HAVING count(*) NOT BETWEEN 50 AND 200 UNION ALL SELECT 'value_range', count(*) FROM t WHERE weight > 1000.1 HAVING count(*) > 0 UNION ALL SELECT 'envelope_y', count(*) FROM t WHERE y > 20.5 HAVING count(*) > 0",
    "a29_line_totals": """WITH f AS (SELECT o_custkey AS p, count(*) AS s, count(*) FILTER (WHERE o_orderstatus <> 'P') AS v FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)
        SELECT c_nationkey AS line_id, count(*) AS points, coalesce(sum(s), 0)::BIGINT AS source_records, coalesce(sum(v), 0)::BIGINT AS valid, (coalesce(sum(s), 0) - coalesce(sum(v), 0))::BIGINT AS invalid FROM customer LEFT JOIN f ON c_custkey = p GROUP BY c_nationkey""",
    "s13_predictions": """WITH r AS (SELECT event_id AS k, (-(event_id * 7)) % 900 AS z, event_id % 29 = 0 OR event_id % 31 = 0 AS nodata, event_id % 5 - 2 AS e FROM events)
        SELECT CASE WHEN z < -840 THEN NULL WHEN z < -630 THEN '深部 [-840,-630) m' WHEN z < -420 THEN '中深部 [-630,-420) m' WHEN z < -210 THEN '中浅部 [-420,-210) m' ELSE '浅部 [-210,0] m' END AS depth_band, count(*) AS n, count(*) FILTER (WHERE nodata) AS nodata,
               round(avg(e) FILTER (WHERE NOT nodata), 6) AS error, round(avg(abs(e)) FILTER (WHERE NOT nodata), 6) AS abs_error, (SELECT count(*) FROM r WHERE k % 37 = 0) AS xy_mismatches FROM r GROUP BY 1""",
    "s15_preset": "SELECT count(*) AS n, sum(p_size)::DOUBLE AS size, round(avg(p_retailprice), 6) AS price FROM part",
}
