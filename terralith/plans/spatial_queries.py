"""Neighbour joins, interpolation by inverse distance, sector neighbourhoods and variograms over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import neighbors as N
from terralith.operators import variogram as X
from terralith.operators.shared import checkpointed
from terralith.plans.statistics_queries import rounded
from terralith.sources.points import SQL_2D, points_2d

WIDTH, BINS = 1.0, 5


def targets(spark):
    """A grid of 12 by 12 places to estimate at; some fall on samples."""
    i = F.col("id")
    return spark.range(144).select(i.alias("query_id"), ((i % 12) * 4.5 - 1).alias("x"), (F.floor(i / 12) * 8.25).alias("y"))


def residuals(spark, d):
    p = points_2d(spark, d)
    return p.select("source_row", "x", "y", F.when(F.col("source_row") % 11 != 0, (F.col("source_row") % 13 - 6).cast("double")).alias("residual"))


def j07(spark, d):
    return rounded(N.nearest(targets(spark), points_2d(spark, d), 6), "value", "d")


def i01(spark, d):
    return rounded(N.inverse_distance(targets(spark), points_2d(spark, d), 8), "value", digits=4)


def i01_radius(spark, d):
    return rounded(N.inverse_distance(targets(spark), points_2d(spark, d), 8, 1.5, 3, radius=2.5), "value", digits=4)


def n01(spark, d):
    return rounded(N.sector_neighbors(targets(spark), points_2d(spark, d), (9.0, 4.0), 30.0, 4, 2, 3, 6), "value", "d")


def n02(spark, d):
    return rounded(N.error_scale(targets(spark), residuals(spark, d), 6), "scale")


def pairs(spark, d):
    return N.place_pairs(checkpointed(N.places(points_2d(spark, d))), WIDTH * BINS)


def j09(spark, d):
    return rounded(N.later_within_radius(points_2d(spark, d), WIDTH * BINS), "h")


def x02(spark, d):
    return rounded(X.binned(pairs(spark, d), WIDTH, BINS), "mean_distance", "semivariance")


def x04(spark, d):
    return rounded(X.directional(pairs(spark, d), [("east", 0.0, 22.5), ("northeast", 45.0, 22.5)], WIDTH, BINS), "mean_distance", "semivariance")


def l07(spark, d):
    return X.sampled_pairs(points_2d(spark, d), 5000).groupBy("stratum").agg(F.count("*").alias("n"), F.min("h").alias("h_min"), F.max("h").alias("h_max"))


def x06(spark, d):
    bins = checkpointed(X.binned(X.sampled_pairs(points_2d(spark, d), 20_000), 4.0, 12))
    rows = [X.fit_bins(bins, m) for m in X.MODELS]
    return spark.createDataFrame(rows).select("model", "nugget", "partial_sill", "sill", "range", "weighted_sse")


def x07(spark, d):
    pairs, found = checkpointed(X.sampled_pairs(points_2d(spark, d), 40_000)), []
    for a in (0.0, 45.0, 90.0, 135.0):
        bins = checkpointed(X.binned(X.along(pairs, a, 22.5), 6.0, 10))
        found.append({"id": f"az{a:03.0f}", "azimuth": a, "range": X.best_fit(bins)["range"], "bound": X.range_bound(bins), "pairs": X.used_pairs(bins)})
    cols = ["rank", "major", "azimuth", "range", "secondary", "minor_ratio", "pairs"]
    rows = [(*(c[k] for k in cols), ";".join(c["warnings"])) for c in X.suggest_anisotropy(found)["candidates"]]
    return spark.createDataFrame(rows, "rank int, major string, azimuth double, range double, secondary string, minor_ratio double, pairs bigint, warnings string")


QUERIES = {
    "j07_nearest_neighbors": j07, "i01_inverse_distance": i01, "i01_inverse_distance_radius": i01_radius, "n01_sector_neighbors": n01, "n02_error_scale": n02,
    "j09_pairs_in_radius": j09, "x02_variogram_bins": x02, "x04_directional_variogram": x04, "l07_sampled_pairs": l07, "x06_variogram_fits": x06, "x07_anisotropy": x07,
}

TARGETS = "q AS (SELECT i AS query_id, (i % 12) * 4.5 - 1 AS x, (i // 12) * 8.25 AS y FROM range(144) t(i))"
DIST = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))"
NEAR = f"near AS (SELECT query_id, source_row, value, d, row_number() OVER (PARTITION BY query_id ORDER BY d, source_row)::INT AS k FROM (SELECT query_id, source_row, value, {DIST} AS d FROM q CROSS JOIN pts p))"


def _idw(k: int, power: float, least: int, where: str = "true") -> str:
    return f"""g AS (SELECT query_id, count(*) AS n, min(d) AS d0, arg_min(value, k) AS hit, sum(value / power(d, {power})) FILTER (WHERE d > 1e-12) / sum(1 / power(d, {power})) FILTER (WHERE d > 1e-12) AS mean FROM near WHERE k <= {k} AND {where} GROUP BY query_id)
        SELECT q.query_id, round(CASE WHEN n >= {least} THEN CASE WHEN d0 <= 1e-12 THEN hit ELSE mean END END, 4) AS value, coalesce(n, 0) AS n, coalesce(n, 0) < {least} AS is_nodata FROM q LEFT JOIN g USING (query_id)""".replace("sum(value / power(d", "sum(value / power(CASE WHEN d > 1e-12 THEN d END").replace("sum(1 / power(d", "sum(1 / power(CASE WHEN d > 1e-12 THEN d END")


PAIRS = f"""pr AS (SELECT a.source_row AS i, b.source_row AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, 0.5 * (a.value - b.value) * (a.value - b.value) AS gamma, b.x - a.x AS dx, b.y - a.y AS dy
    FROM pts a JOIN pts b ON a.source_row < b.source_row AND abs(a.x - b.x) <= {WIDTH * BINS} AND abs(a.y - b.y) <= {WIDTH * BINS}), inr AS (SELECT * FROM pr WHERE h <= {WIDTH * BINS})"""


def _bins(direction: str, where: str, reason: str) -> str:
    return f"""SELECT {direction} AS direction, b::INT AS bin, b * {WIDTH} AS lower, (b + 1) * {WIDTH} AS upper, (b + 0.5) * {WIDTH} AS center, round(avg(h), 6) AS mean_distance, round(avg(gamma), 6) AS semivariance, count(h) AS pair_count,
        count(h) >= 30 AS used_for_fit, CASE WHEN count(h) < 30 THEN {reason} END AS exclusion_reason
        FROM range({BINS}) t(b) LEFT JOIN (SELECT * FROM inr WHERE {where}) ON (h > b * {WIDTH} OR (b = 0 AND h = 0)) AND h <= (b + 1) * {WIDTH} GROUP BY b"""


_AZ = "abs((((degrees(atan2(dy, dx)) + 360) % 180) - {a} + 90 + 180) % 180 - 90) <= 22.5 + 1e-9"
ORACLE = {
    "j07_nearest_neighbors": f"WITH {SQL_2D}, {TARGETS}, {NEAR} SELECT query_id, source_row, round(value, 6) AS value, round(d, 6) AS d, k FROM near WHERE k <= 6",
    "i01_inverse_distance": f"WITH {SQL_2D}, {TARGETS}, {NEAR}, {_idw(8, 2.0, 1)}",
    "i01_inverse_distance_radius": f"WITH {SQL_2D}, {TARGETS}, {NEAR}, {_idw(8, 1.5, 3, 'd < 2.5')}",
    "n01_sector_neighbors": f"""WITH {SQL_2D}, {TARGETS}, o AS (SELECT query_id, source_row, value, p.x - q.x AS ox, p.y - q.y AS oy FROM q CROSS JOIN pts p),
        l AS (SELECT *, cos(radians(30)) * ox + sin(radians(30)) * oy AS u, -sin(radians(30)) * ox + cos(radians(30)) * oy AS v FROM o),
        e AS (SELECT *, sqrt((u / 9) * (u / 9) + (v / 4) * (v / 4)) AS d, least(3, floor((atan2(v, u) + CASE WHEN atan2(v, u) < 0 THEN 2 * pi() ELSE 0 END) / (pi() / 2)))::INT AS sector FROM l WHERE (u / 9) * (u / 9) + (v / 4) * (v / 4) <= 1),
        s AS (SELECT *, row_number() OVER (PARTITION BY query_id, sector ORDER BY d, source_row) AS r FROM e),
        m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, source_row)::INT AS k, count(*) OVER (PARTITION BY query_id) AS n FROM s WHERE r <= 2)
        SELECT query_id, source_row, round(value, 6) AS value, round(d, 6) AS d, sector, k FROM m WHERE n >= 3 AND k <= 6""",
    "j09_pairs_in_radius": f"WITH {SQL_2D}, {PAIRS} SELECT i, count(*) AS n, round(sum(h), 6) AS h FROM inr GROUP BY i",
    "x02_variogram_bins": f"WITH {SQL_2D}, {PAIRS} {_bins('NULL::VARCHAR', 'true', chr(39) + 'insufficient_pairs' + chr(39))}".replace("THEN 'insufficient_pairs'", "THEN CASE WHEN count(h) = 0 THEN 'empty_bin' ELSE 'insufficient_pairs' END"),
    "x04_directional_variogram": f"WITH {SQL_2D}, {PAIRS} {_bins('NULL::VARCHAR', 'true', chr(39) + 'insufficient_pairs' + chr(39))}".replace("THEN 'insufficient_pairs'", "THEN CASE WHEN count(h) = 0 THEN 'empty_bin' ELSE 'insufficient_pairs' END")
    + "".join(f" UNION ALL {_bins(repr(n), _AZ.format(a=a), repr('unsupported_direction'))}" for n, a in (("east", 0.0), ("northeast", 45.0))),
}
ORACLE["n02_error_scale"] = f"""WITH {SQL_2D}, {TARGETS}, r AS (SELECT source_row, x, y, (source_row % 13 - 6)::DOUBLE AS value FROM pts WHERE source_row % 11 <> 0), {NEAR.replace('pts p', 'r p')},
    t AS (SELECT query_id, k, value, d AS d0, CASE WHEN d > 1e-12 THEN d END AS d FROM near WHERE k <= 6),
    g AS (SELECT query_id, count(*) AS n, min(d0) AS d0, arg_min(abs(value), k) AS hit, sqrt(sum(value * value / (d * d)) / sum(1 / (d * d))) AS mean FROM t WHERE true GROUP BY query_id)
    SELECT query_id, round(CASE WHEN d0 <= 1e-12 THEN hit ELSE mean END, 6) AS scale, n, false AS is_nodata FROM g"""
