"""Point statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import statistics as S
from terralith.sources.points import SQL_2D, SQL_3D, SQL_EVENTS, points_2d, points_3d, points_events

VALID = "v AS (SELECT * FROM pts WHERE ok AND value IS NOT NULL AND isfinite(value))"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _edges(column: str, bins: int, source: str = "v", name: str = "e") -> str:
    """Independent edges: every bin with its bounds, to be joined by comparison."""
    return f"""{name} AS (
        SELECT i::INT AS bin, lo + i * ((hi - lo) / {bins}) AS lower, CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS upper
        FROM (SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END AS lo,
                     CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END AS hi FROM {source}), range({bins}) t(i))"""


def _cells(size: int) -> str:
    return f"""{_edges('x', size, name='ex')}, {_edges('y', size, name='ey')},
        cell AS (
            SELECT ey.bin AS iy, ex.bin AS ix, count(v.value) AS n, avg(v.value) AS mean
            FROM ex CROSS JOIN ey LEFT JOIN v
              ON v.x >= ex.lower AND (v.x < ex.upper OR ex.bin = {size - 1}) AND v.y >= ey.lower AND (v.y < ey.upper OR ey.bin = {size - 1})
            GROUP BY ALL)"""


def a01(spark, d):
    return S.quality_summary(points_3d(spark, d), "3d")


def a02(spark, d):
    return rounded(S.quantile_row(S.common_valid(points_3d(spark, d))), "p05", "p25", "p50", "p75", "p95", digits=4)


def a03(spark, d):
    return rounded(S.numeric_summary(points_3d(spark, d)), "min", "max", "mean", "std", "p05", "p25", "p50", "p75", "p95", "median", digits=4)


def a04(spark, d):
    return rounded(S.histogram(S.common_valid(points_events(spark, d))), "lower", "upper")


def a05(spark, d):
    return rounded(S.log10_histogram(points_events(spark, d)), "lower", "upper")


def a06(spark, d):
    return rounded(S.spatial_cells(points_2d(spark, d)), "mean")


def a07(spark, d):
    return rounded(S.axis_profile(points_3d(spark, d), "z"), "lower", "upper", "mean", "median", digits=4)


def a08(spark, d):
    return rounded(S.axis_trends(points_3d(spark, d)), "lower", "upper", "mean", "median", digits=4)


def a09(spark, d):
    return rounded(S.gradient_summary(points_2d(spark, d)), "mean", "p95", "max")


def a10(spark, d):
    low, high = S.anomaly_thresholds(points_events(spark, d))
    return spark.createDataFrame([(round(low, 6), round(high, 6))], "low double, high double")


def a11(spark, d):
    return rounded(S.depth_slice_ratios(points_3d(spark, d)), "lower", "upper", "high_ratio", "low_ratio")


def a12(spark, d):
    return rounded(S.spatial_anomaly_summary(points_2d(spark, d)), "ratio")


def k06(spark, d):
    p = points_events(spark, d)
    bins = S.histogram(S.common_valid(p), bins=8)
    n = S.common_valid(p).count()
    return rounded(S.export_rows({"count": n}, [("histogram", "value", bins)]), "lower", "upper", "value")


QUERIES = {
    "a01_quality_summary": a01, "a02_quantiles": a02, "a03_numeric_summary": a03, "a04_histogram": a04, "a05_log10_histogram": a05,
    "a06_spatial_cells": a06, "a07_axis_profile": a07, "a08_axis_trends": a08, "a09_gradient_summary": a09, "a10_anomaly_thresholds": a10,
    "a11_depth_slice_ratios": a11, "a12_spatial_anomaly": a12, "k06_statistics_export": k06,
}

_Q = "round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.95), 4) AS p95"


def _profile(axis: str, bins: int) -> str:
    return f"""SELECT e.bin, round(e.lower, 4) AS lower, round(e.upper, 4) AS upper, count(v.value) AS n, round(avg(v.value), 4) AS mean, round(median(v.value), 4) AS median
        FROM {axis} e LEFT JOIN v ON v.{axis[1:]} >= e.lower AND (v.{axis[1:]} < e.upper OR e.bin = {bins - 1}) GROUP BY e.bin, e.lower, e.upper"""


ORACLE = {
    "a01_quality_summary": f"""WITH {SQL_3D} SELECT count(*) AS row_count, count(*) FILTER (WHERE ok) AS valid_count, count(*) FILTER (WHERE NOT ok) AS invalid_count,
        count(*) FILTER (WHERE ok) - (SELECT count(*) FROM (SELECT DISTINCT x, y, z FROM pts WHERE ok)) AS duplicate_coordinate_count,
        min(x) FILTER (WHERE ok) AS x_min, max(x) FILTER (WHERE ok) AS x_max, min(y) FILTER (WHERE ok) AS y_min, max(y) FILTER (WHERE ok) AS y_max,
        min(z) FILTER (WHERE ok) AS z_min, max(z) FILTER (WHERE ok) AS z_max FROM pts""",
    "a02_quantiles": f"WITH {SQL_3D}, {VALID} SELECT {_Q} FROM v",
    "a03_numeric_summary": f"WITH {SQL_3D}, {VALID} SELECT count(*) AS n, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, {_Q}, round(median(value), 4) AS median FROM v",
    "a04_histogram": f"WITH {SQL_EVENTS}, {VALID}, {_edges('value', 32)} SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(v.value) AS n FROM e LEFT JOIN v ON v.value >= lower AND (v.value < upper OR bin = 31) GROUP BY bin, lower, upper",
    "a05_log10_histogram": f"WITH {SQL_EVENTS}, {VALID}, l AS (SELECT log10(value) AS lv FROM v WHERE value > 0), {_edges('lv', 32, 'l')} SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(l.lv) AS n, (SELECT count(*) FROM v WHERE value <= 0)::INT AS excluded FROM e LEFT JOIN l ON l.lv >= lower AND (l.lv < upper OR bin = 31) GROUP BY bin, lower, upper",
    "a06_spatial_cells": f"WITH {SQL_2D}, {VALID}, {_cells(32)} SELECT iy, ix, n, round(mean, 6) AS mean FROM cell",
    "a07_axis_profile": f"WITH {SQL_3D}, {VALID}, {_edges('z', 32, name='ez')} {_profile('ez', 32)}",
    "a08_axis_trends": f"WITH {SQL_3D}, {VALID}, {_edges('x', 32, name='ex')}, {_edges('y', 32, name='ey')}, {_edges('z', 32, name='ez')} "
    + " UNION ALL ".join(f"SELECT '{a}' AS axis, * FROM ({_profile('e' + a, 32)})" for a in "xyz"),
    "a09_gradient_summary": f"""WITH {SQL_2D}, {VALID}, {_cells(16)},
        d AS (SELECT abs(b.mean - a.mean) AS d FROM cell a JOIN cell b ON (a.iy = b.iy AND a.ix + 1 = b.ix) OR (a.ix = b.ix AND a.iy + 1 = b.iy))
        SELECT count(d) AS pairs, count(*) - count(d) AS excluded, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max FROM d""",
    "a10_anomaly_thresholds": f"WITH {SQL_EVENTS}, {VALID} SELECT round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.75), 6) AS high FROM v",
    "a11_depth_slice_ratios": f"""WITH {SQL_3D}, {VALID}, {_edges('z', 16)}, q AS (SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM v)
        SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(v.value) AS n,
               round(count(*) FILTER (WHERE v.value >= q.hi) / nullif(count(v.value), 0), 6) AS high_ratio, round(count(*) FILTER (WHERE v.value <= q.lo) / nullif(count(v.value), 0), 6) AS low_ratio
        FROM e CROSS JOIN q LEFT JOIN v ON v.z >= lower AND (v.z < upper OR bin = 15) GROUP BY bin, lower, upper""",
    "a12_spatial_anomaly": f"""WITH {SQL_2D}, {VALID}, {_cells(32)}, q AS (SELECT quantile_cont(mean, 0.25) AS lo, quantile_cont(mean, 0.75) AS hi FROM cell),
        c AS (SELECT n, CASE WHEN mean IS NULL THEN 'empty' WHEN lo = hi THEN 'normal' WHEN mean >= hi THEN 'high' WHEN mean <= lo THEN 'low' ELSE 'normal' END AS class FROM cell, q)
        SELECT class, count(*) AS cells, sum(n)::BIGINT AS n, round(sum(n) / (SELECT count(*) FROM v), 6) AS ratio FROM c GROUP BY class""",
    "k06_statistics_export": f"""WITH {SQL_EVENTS}, {VALID}, {_edges('value', 8)}
        SELECT 'summary' AS section, NULL::VARCHAR AS axis, NULL::INT AS bin_index, 'count' AS metric, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, count(*)::DOUBLE AS value FROM v
        UNION ALL SELECT 'histogram', 'value', bin, 'n', round(lower, 6), round(upper, 6), count(v.value)::DOUBLE FROM e LEFT JOIN v ON v.value >= lower AND (v.value < upper OR bin = 7) GROUP BY bin, lower, upper""",
}
