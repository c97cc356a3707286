"""Quality gate, metrics, comparisons and spatial folds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import candidates
from terralith.operators import metrics as M
from terralith.operators import quality as Q
from terralith.operators import validation as V
from terralith.plans.statistics_queries import rounded
from terralith.sources.points import SQL_2D, SQL_3D, points_2d, points_3d, points_events

SCORES = ["mae", "rmse", "r2", "bias"]


def predictions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    rows = F.array(
        F.struct(F.lit("shifted").alias("candidate"), (F.col("value") + k % 7 - 3).alias("predicted"), (k % 37 == 0).alias("is_nodata")),
        F.struct(F.lit("scaled").alias("candidate"), (F.col("value") * 1.02 - 1).alias("predicted"), (k % 53 == 0).alias("is_nodata")),
        F.struct(F.lit("constant").alias("candidate"), F.lit(60.0).alias("predicted"), F.lit(False).alias("is_nodata")),
    )
    return e.select((k + 1).alias("source_row"), F.col("value").alias("observed"), F.col("event_type").alias("line_id"), (F.col("user_id") % 5).alias("point_id"), F.explode(rows).alias("s")).select("source_row", "observed", "line_id", "point_id", "s.*")


def a14(spark, d):
    return M.common_rows(predictions(spark, d))


def a13(spark, d):
    return rounded(M.metrics(predictions(spark, d)), *SCORES, "coverage")


def a15(spark, d):
    return rounded(M.nine_metrics(predictions(spark, d)), *SCORES, "median_ae", "mean_relative", "median_relative", "log10_rmse", "p90_ae")


def a17(spark, d):
    return rounded(M.group_metrics(predictions(spark, d), "line_id"), "coverage", "mae", "rmse", "bias")


def a18(spark, d):
    p = predictions(spark, d)
    provenance = p.where("candidate = 'scaled'").select("source_row", "line_id", "point_id")
    return rounded(M.grouping_diagnostics(p.drop("line_id", "point_id"), provenance), "mae", "rmse", "bias")


def a22(spark, d):
    return rounded(M.residual_summary(predictions(spark, d)), "mean", "std", "min", "max", "abs_p50", "abs_p90", "abs_p95", "abs_p99")


def a28(spark, d):
    return rounded(M.pair_deltas(predictions(spark, d), "shifted", "scaled"), "d_mae", "d_rmse", "d_r2", "d_bias")


def w07(spark, d):
    return rounded(M.ranking(M.metrics(predictions(spark, d))).select("candidate", "rank", "rmse", "mae"), "rmse", "mae")


def j14(spark, d):
    s = M.metrics(predictions(spark, d))
    base = s.where("candidate <> 'constant'").select("candidate", *((F.col(k) + (0.5 if k == "mae" else 0)).alias(k) for k in SCORES))
    return rounded(M.baseline_check(s, base, 0.1), "value", "expected", "delta")


def f02(spark, d):
    p = points_3d(spark, d)
    return Q.quality_issues(p.unionByName(p.where("source_row % 10 = 0")), "3d")


def f04(spark, d):
    return Q.column_summary(points_events(spark, d), ["x", "y", "z", "value"])


def f05(spark, d):
    p = points_2d(spark, d)
    return Q.shared_columns(p.where("source_row % 3 = 0"), p.where("source_row % 3 <> 0"))


def u08(spark, d):
    p = points_2d(spark, d)
    return Q.partition_identity([p.where("source_row % 4 = 0"), p.where("source_row % 4 in (1, 2)"), p.where("source_row % 8 = 0")], p, ["source_row"])


def f11(spark, d):
    return V.ml_suitability(points_3d(spark, d), "3d")


def v01(spark, d):
    return V.groups_2d(points_2d(spark, d), 5).groupBy("group_key").agg(F.count("*").alias("n"))


def v02(spark, d):
    return V.groups_3d(points_3d(spark, d)).groupBy("group_key").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"))


def v05(spark, d):
    a = V.fold_assignments(points_3d(spark, d), "3d")
    V.check_assignments(a)
    return V.fold_evidence(a)


def f03(spark, d):
    """The contract of a table of places and values, on the events with a few spoilt rows."""
    e, k = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id")
    rows = e.select(F.col("user_id").cast("string").alias("X"), F.when(k % 101 == 0, "n/a").otherwise(F.hour("ts").cast("string")).alias("Y"), (-k % 50).cast("string").alias("Z"), F.when(k % 89 == 0, "-9999").when(k % 83 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("RHO"))
    return Q.contract_checks(rows)


def f12(spark, d):
    """Whether the hours, and the days of orders but one, are regular axes."""
    hours = spark.read.parquet(f"{d}/events.parquet").select(F.hour("ts").cast("double").alias("coord")).distinct()
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.dayofmonth("o_orderdate").cast("double").alias("coord")).distinct().where("coord <> 7")
    return Q.axis_check(hours).select(F.lit("hours").alias("axis"), "*").unionByName(Q.axis_check(days).select(F.lit("days").alias("axis"), "*"))


def v06(spark, d):
    """Out-of-fold records of a candidate against the plan and the truth, and each fold's error (A19)."""
    p = points_2d(spark, d)
    plan = V.with_roles(V.groups_2d(p, 5).select("source_row", "group_key", (F.col("group_key") % 2).cast("int").alias("own")), 2)
    V.check_assignments(plan)
    found, _ = candidates.evaluate(p, plan, [{"name": "idw", "algorithm": "idw", "parameters": {"neighbor_count": 8, "min_neighbors": 1}}])
    oof = V.out_of_fold(p, plan, found.select("source_row", "fold_index", "predicted", "is_nodata"))
    more = oof.groupBy("fold_index").agg(F.avg("residual").alias("bias"), F.avg("absolute_error").alias("mae"))
    return rounded(V.fold_rmse(oof).join(more, "fold_index"), "rmse", "bias", "mae", digits=4)


QUERIES = {
    "f03_contract": f03, "f12_axis_check": f12, "v06_out_of_fold": v06,
    "a13_metrics": a13, "a14_common_rows": a14, "a15_nine_metrics": a15, "a17_group_metrics": a17, "a18_grouping_diagnostics": a18, "a22_residual_summary": a22,
    "a28_pair_deltas": a28, "w07_ranking": w07, "j14_baseline_check": j14, "f02_quality_issues": f02, "f04_column_summary": f04, "f05_shared_columns": f05,
    "u08_partition_identity": u08, "f11_ml_suitability": f11, "v01_groups_2d": v01, "v02_groups_3d": v02, "v05_fold_evidence": v05,
}

PRED = """base AS (SELECT event_id AS k, event_id + 1 AS source_row, value AS observed, event_type AS line_id, user_id % 5 AS point_id FROM events),
    p AS (SELECT source_row, observed, line_id, point_id, 'shifted' AS candidate, observed + k % 7 - 3 AS predicted, k % 37 = 0 AS is_nodata FROM base
          UNION ALL SELECT source_row, observed, line_id, point_id, 'scaled', observed * 1.02 - 1, k % 53 = 0 FROM base
          UNION ALL SELECT source_row, observed, line_id, point_id, 'constant', 60.0, false FROM base),
    c AS (SELECT source_row FROM p GROUP BY source_row HAVING bool_and(NOT is_nodata)),
    e AS (SELECT *, predicted - observed AS r FROM p),
    k AS (SELECT * FROM e WHERE source_row IN (SELECT source_row FROM c)),
    s AS (SELECT candidate, count(*) AS n, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, 1 - sum(r * r) / (var_pop(observed) * count(*)) AS r2, avg(r) AS bias FROM k GROUP BY candidate)"""

ORACLE = {
    "f03_contract": """WITH r AS (SELECT user_id::DOUBLE AS x, CASE WHEN event_id % 101 <> 0 THEN hour(ts)::DOUBLE END AS y, (-event_id % 50)::DOUBLE AS z, CASE WHEN event_id % 89 = 0 THEN -9999 WHEN event_id % 83 <> 0 THEN value END AS v FROM events),
        s AS (SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR z IS NULL OR v IS NULL) AS bad, count(*) FILTER (WHERE v <= 0) AS low, (SELECT count(*) FROM (SELECT DISTINCT x, y, z FROM r)) AS places FROM r)
        SELECT 'required_columns' AS "check", true AS passed, 0::BIGINT AS n FROM s UNION ALL SELECT 'finite_cells', bad = 0, bad FROM s UNION ALL SELECT 'positive_values', low = 0, low FROM s UNION ALL SELECT 'distinct_places', places = n, n - places FROM s UNION ALL SELECT 'row_count', true, n FROM s""",
    "f12_axis_check": """WITH a AS (SELECT DISTINCT 'hours' AS axis, hour(ts)::DOUBLE AS c FROM events UNION SELECT DISTINCT 'days', day(o_orderdate)::DOUBLE FROM orders WHERE day(o_orderdate) <> 7),
        g AS (SELECT axis, c, c - lag(c) OVER (PARTITION BY axis ORDER BY c) AS gap FROM a)
        SELECT axis, count(*) AS nodes, true AS increasing, count(*) >= 2 AND max(gap) - min(gap) <= 1e-6 AS even FROM g GROUP BY axis""",
    "v06_out_of_fold": f"""WITH {SQL_2D}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
        f AS MATERIALIZED (SELECT pts.*, (least(3, floor((x - x0) / ((x1 - x0) / 4))) * 4 + least(3, floor((y - y0) / ((y1 - y0) / 4))))::INT % 2 AS fold FROM pts, b),
        d AS (SELECT q.fold, q.source_row, q.value AS observed, s.value, s.source_row AS row, sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) AS d FROM f q JOIN f s ON q.fold <> s.fold QUALIFY row_number() OVER (PARTITION BY q.source_row ORDER BY sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)), s.source_row) <= 8),
        p AS (SELECT fold, source_row, any_value(observed) AS o, sum(value / (d * d)) / sum(1 / (d * d)) AS p FROM d GROUP BY ALL)
        SELECT fold AS fold_index, round(sqrt(avg((p - o) * (p - o))), 4) AS rmse, count(*) AS valid_count, round(avg(p - o), 4) AS bias, round(avg(abs(p - o)), 4) AS mae FROM p GROUP BY fold""",
    "a14_common_rows": f"WITH {PRED} SELECT source_row FROM c",
    "a13_metrics": f"""WITH {PRED}, o AS (SELECT candidate, count(*) AS total, count(*) FILTER (WHERE NOT is_nodata) AS own, count(*) FILTER (WHERE is_nodata) AS nodata FROM p GROUP BY candidate)
        SELECT candidate, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(bias, 6) AS bias, round(own / total, 6) AS coverage, nodata, total - n AS excluded FROM s JOIN o USING (candidate)""",
    "a15_nine_metrics": f"""WITH {PRED}, m AS (SELECT candidate, median(abs(r)) AS median_ae, avg(CASE WHEN observed <> 0 THEN abs(r) / observed WHEN r <> 0 THEN 'inf'::DOUBLE END) AS mean_relative, median(CASE WHEN observed <> 0 THEN abs(r) / observed WHEN r <> 0 THEN 'inf'::DOUBLE END) AS median_relative,
            sqrt(avg(power(log10(predicted) - log10(observed), 2)) FILTER (WHERE predicted > 0 AND observed > 0)) AS log10_rmse, quantile_cont(abs(r), 0.9) AS p90_ae FROM k GROUP BY candidate)
        SELECT candidate, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(bias, 6) AS bias, round(median_ae, 6) AS median_ae, round(mean_relative, 6) AS mean_relative,
               round(median_relative, 6) AS median_relative, round(log10_rmse, 6) AS log10_rmse, round(p90_ae, 6) AS p90_ae FROM s JOIN m USING (candidate)""".replace("power(log10(predicted) - log10(observed), 2)", "CASE WHEN predicted > 0 AND observed > 0 THEN power(log10(CASE WHEN predicted > 0 THEN predicted END) - log10(CASE WHEN observed > 0 THEN observed END), 2) END"),
    "a17_group_metrics": f"""WITH {PRED}, u AS (SELECT e.*, source_row IN (SELECT source_row FROM c) AS used FROM e)
        SELECT candidate, line_id, count(*) AS n_total, count(*) FILTER (WHERE used) AS n_valid, round(count(*) FILTER (WHERE used) / count(*), 6) AS coverage,
        round(avg(abs(r)) FILTER (WHERE used), 6) AS mae, round(sqrt(avg(r * r) FILTER (WHERE used)), 6) AS rmse, round(avg(r) FILTER (WHERE used), 6) AS bias FROM u GROUP BY candidate, line_id""",
    "a18_grouping_diagnostics": f"""WITH {PRED}, u AS (SELECT e.*, source_row IN (SELECT source_row FROM c) AS used FROM e)
        SELECT candidate, line_id, NULL::BIGINT AS point_id, count(*) FILTER (WHERE used) AS n, round(avg(abs(r)) FILTER (WHERE used), 6) AS mae, round(sqrt(avg(r * r) FILTER (WHERE used)), 6) AS rmse, round(avg(r) FILTER (WHERE used), 6) AS bias FROM u GROUP BY candidate, line_id
        UNION ALL SELECT candidate, NULL, point_id, count(*) FILTER (WHERE used), round(avg(abs(r)) FILTER (WHERE used), 6), round(sqrt(avg(r * r) FILTER (WHERE used)), 6), round(avg(r) FILTER (WHERE used), 6) FROM u GROUP BY candidate, point_id""",
    "a22_residual_summary": f"""WITH {PRED}, g AS (SELECT candidate, CASE WHEN NOT is_nodata THEN r END AS r, is_nodata FROM e)
        SELECT candidate, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max, round(quantile_cont(abs(r), 0.5), 6) AS abs_p50, round(quantile_cont(abs(r), 0.9), 6) AS abs_p90,
               round(quantile_cont(abs(r), 0.95), 6) AS abs_p95, round(quantile_cont(abs(r), 0.99), 6) AS abs_p99, count(*) FILTER (WHERE is_nodata) AS nodata FROM g GROUP BY candidate""",
    "a28_pair_deltas": f"""WITH {PRED}, b AS (SELECT source_row FROM p WHERE candidate IN ('shifted', 'scaled') GROUP BY source_row HAVING bool_and(NOT is_nodata)),
        t AS (SELECT candidate, count(*) AS n, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, 1 - sum(r * r) / (var_pop(observed) * count(*)) AS r2, avg(r) AS bias FROM e WHERE source_row IN (SELECT source_row FROM b) GROUP BY candidate)
        SELECT f.n, round(f.mae - g.mae, 6) AS d_mae, round(f.rmse - g.rmse, 6) AS d_rmse, round(f.r2 - g.r2, 6) AS d_r2, round(f.bias - g.bias, 6) AS d_bias FROM t f, t g WHERE f.candidate = 'shifted' AND g.candidate = 'scaled'""",
    "w07_ranking": f"WITH {PRED} SELECT candidate, row_number() OVER (ORDER BY rmse, mae, r2 DESC, candidate)::INT AS rank, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM s",
    "j14_baseline_check": f"""WITH {PRED}, l AS (UNPIVOT (SELECT candidate, mae, rmse, r2, bias FROM s) ON mae, rmse, r2, bias INTO NAME metric VALUE value)
        SELECT candidate, metric, round(value, 6) AS value, CASE WHEN candidate <> 'constant' THEN round(value + CASE WHEN metric = 'mae' THEN 0.5 ELSE 0 END, 6) END AS expected,
               CASE WHEN candidate <> 'constant' THEN CASE WHEN metric = 'mae' THEN 0.5 ELSE 0.0 END END AS delta, candidate <> 'constant' AND metric <> 'mae' AS within FROM l""",
    "f02_quality_issues": f"""WITH {SQL_3D}, u AS (SELECT * FROM pts UNION ALL SELECT * FROM pts WHERE source_row % 10 = 0), q AS (SELECT median(value) AS m FROM u WHERE ok), w AS (SELECT median(abs(value - m)) AS mad FROM u, q WHERE ok)
        SELECT 'CONFLICTING_COORDINATE' AS code, 'blocker' AS severity, NULL::VARCHAR AS axis, count(*) AS n FROM (SELECT x, y, z FROM u WHERE ok GROUP BY x, y, z HAVING count(DISTINCT value) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'DUPLICATE_ROWS', 'warning', NULL, count(*) - (SELECT count(*) FROM (SELECT DISTINCT x, y, z, value FROM u)) FROM u HAVING count(*) > 0
        UNION ALL SELECT 'EXTREME_VALUES', 'warning', NULL, count(*) FROM u, q, w WHERE ok AND abs(value - m) > 6 * mad HAVING count(*) > 0""",
    "f04_column_summary": """WITH pts AS (SELECT user_id::DOUBLE AS x, hour(ts)::DOUBLE AS y, day(ts)::DOUBLE AS z, CASE WHEN event_id % 37 <> 0 THEN value END AS value FROM events)
        SELECT 'x' AS "column", min(x) AS min, max(x) AS max, count(DISTINCT x) AS places, count(*) - count(x) AS nulls FROM pts UNION ALL SELECT 'y', min(y), max(y), count(DISTINCT y), count(*) - count(y) FROM pts
        UNION ALL SELECT 'z', min(z), max(z), count(DISTINCT z), count(*) - count(z) FROM pts UNION ALL SELECT 'value', min(value), max(value), count(DISTINCT value), count(*) - count(value) FROM pts""",
    "f05_shared_columns": f"WITH {SQL_2D} SELECT x, y FROM pts WHERE source_row % 3 = 0 INTERSECT SELECT x, y FROM pts WHERE source_row % 3 <> 0",
    "u08_partition_identity": f"WITH {SQL_2D} SELECT count(*) FILTER (WHERE source_row % 8 = 0) AS overlap, count(*) FILTER (WHERE source_row % 4 = 3) AS missing, 0::BIGINT AS foreign FROM pts".replace("AS foreign", 'AS "foreign"'),
    "f11_ml_suitability": f"""WITH {SQL_3D}, s AS (SELECT count(*) AS samples, (SELECT count(*) FROM (SELECT DISTINCT x, y FROM pts)) AS groups FROM pts)
        SELECT samples, "groups", CASE WHEN samples >= 200 AND "groups" >= 30 THEN 'supported' WHEN samples >= 80 AND "groups" >= 15 THEN 'experimental' ELSE 'not_recommended' END AS level FROM s""".replace("AS groups", 'AS "groups"'),
    "v01_groups_2d": f"""WITH {SQL_2D}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts)
        SELECT (least(3, floor((x - x0) / ((x1 - x0) / 4))) * 4 + least(3, floor((y - y0) / ((y1 - y0) / 4))))::BIGINT AS group_key, count(*) AS n FROM pts, b GROUP BY 1""",
    "v02_groups_3d": f"WITH {SQL_3D} SELECT dense_rank() OVER (ORDER BY x, y) - 1 AS group_key, n, x, y FROM (SELECT x, y, count(*) AS n FROM pts GROUP BY x, y)",
}
