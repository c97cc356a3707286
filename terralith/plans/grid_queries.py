"""Grids, slices, anomalies and their components over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.operators import anomalies as A
from terralith.operators import grid as G
from terralith.plans.statistics_queries import rounded

AXES = [G.Axis(0.0, 45.0, 10), G.Axis(0.0, 22.0, 12), G.Axis(-10.0, 0.0, 6)]


def event_grid(spark, d, shift=0):
    e = spark.read.parquet(f"{d}/events.parquet")
    cell = e.groupBy((F.col("user_id") % 10).cast("int").alias("ix"), (F.hour("ts") % 12).cast("int").alias("iy"), ((F.col("event_id") + shift) % 6).cast("int").alias("iz")).agg(F.avg("value").alias("mean"))
    every = G.nodes(spark, AXES)
    hole = (F.col("ix") * 7 + F.col("iy") * 3 + F.col("iz")) % 11 == 0
    return every.join(cell, G.INDEX, "left").select("ix", "iy", "iz", "x", "y", "z", F.when(~hole, F.col("mean")).alias("value"), (hole | F.col("mean").isNull()).alias("is_nodata"))


def g01(spark, d):
    return rounded(event_grid(spark, d), "value")


def g04(spark, d):
    return rounded(G.take_slice(event_grid(spark, d), "z", 3).select("ix", "iy", "value", "is_nodata"), "value")


def a23(spark, d):
    return rounded(G.slice_statistics(event_grid(spark, d), "z", 3), "min", "max", "mean", "std", "p10", "p50", "p90")


def a24(spark, d):
    return rounded(G.grid_statistics(event_grid(spark, d)), "min", "max", "mean", "p25", "median", "p75")


def a25(spark, d):
    return rounded(G.composition(event_grid(spark, d)), "ratio")


def a26(spark, d):
    return rounded(G.depth_profile(event_grid(spark, d)), "lower", "upper", "mean", "high_ratio")


def a27(spark, d):
    return rounded(G.difference(event_grid(spark, d), event_grid(spark, d, 1)), "mean_abs", "max_abs")


def g07(spark, d):
    return rounded(G.support(event_grid(spark, d)).select("ix", "iy", "iz", "measure"), "measure")


def g11(spark, d):
    q = spark.range(200).select(F.col("id").alias("query_id"), (F.col("id") * 0.25 - 1).alias("x"), (F.col("id") % 23).cast("double").alias("y"), (F.col("id") % 11 - 10).cast("double").alias("z"))
    return rounded(G.trilinear(event_grid(spark, d), AXES, q), "value")


def g12(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("double").alias("x"), F.hour("ts").cast("double").alias("y"), (-F.col("event_id") % 11).cast("double").alias("z"), "value")
    return rounded(G.snap(e, AXES), "value")


def g13(spark, d):
    return rounded(G.neighbor_mean(event_grid(spark, d), 18), "mean")


def l04(spark, d):
    return G.preview(event_grid(spark, d), 3, 100).select("ix", "iy", "iz")


def g08(spark, d):
    grid = event_grid(spark, d)
    t = A.exact_quantiles(G.valid(grid), "value", [0.75])[0]
    return rounded(A.components(grid, t), "support_measure", "x_centroid", "y_centroid", "z_centroid", "value_min", "value_max", "value_mean")


def g10(spark, d):
    return rounded(A.ranked_components(event_grid(spark, d), 2).select("direction", "rank", "letter", "component_id", "support_node_count", "value_min", "value_max"), "value_min", "value_max")


def with_layer(g):
    """The grid with an uncertainty layer that some nodes lack."""
    at = (F.col("ix") + 2 * F.col("iy") + 3 * F.col("iz")) % 7
    return g.withColumn("err", F.when(at != 6, at.cast("double") / 2))


def g09(spark, d):
    """Components of nodes whose layer is within its gate, with the layer's summary."""
    g = with_layer(event_grid(spark, d))
    t = exact_quantiles(G.valid(g), "value", [0.5])[0]
    c = A.components(g, t, min_nodes=2, gates={"err": 2.0})
    return rounded(c.select("component_id", "support_node_count", "value_max", "err_min", "err_max", "err_mean"), "value_max", "err_mean")


def l02(spark, d):
    """Nodes as they are decimated for a preview that asks for every fourth row."""
    g = event_grid(spark, d).where("not is_nodata").withColumn("row", F.col("ix") * 72 + F.col("iy") * 6 + F.col("iz") + 1)
    return rounded(G.decimated(g, 4, "row").select("row", "value"), "value")


def s16(spark, d):
    """The grid's rows as a table of places and values, read back as a grid."""
    return rounded(G.import_grid(event_grid(spark, d).select("x", "y", "z", "value").repartition("value")), "value")


def g15(spark, d):
    """Whether two results stand on the same nodes: another month's grid does, a preview of every second node doesn't."""
    g = event_grid(spark, d)
    rows = [(name, G.same_axes(g, other)) for name, other in (("shifted", event_grid(spark, d, 1)), ("preview", G.preview(g, 3, 100)))]
    n = g.agg(F.count("value").alias("valid"))
    return spark.createDataFrame(rows, "other string, same boolean").join(F.broadcast(n))


QUERIES = {
    "s16_grid_import": s16, "g15_same_axes": g15,
    "g09_gated_components": g09, "l02_decimated_nodes": l02,
    "g01_grid": g01, "g04_slice": g04, "a23_slice_statistics": a23, "a24_grid_statistics": a24, "a25_composition": a25, "a26_depth_profile": a26, "a27_grid_difference": a27,
    "g07_support": g07, "g11_trilinear": g11, "g12_snap": g12, "g13_neighbor_mean": g13, "l04_preview": l04, "g08_components": g08, "g10_ranked_components": g10,
}


def _grid(name: str = "g", shift: int = 0) -> str:
    return f"""{name} AS (SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, ix * 5.0 AS x, iy * 2.0 AS y, iz * 2.0 - 10 AS z, CASE WHEN (ix * 7 + iy * 3 + iz) % 11 <> 0 THEN m END AS value, (ix * 7 + iy * 3 + iz) % 11 = 0 OR m IS NULL AS is_nodata
        FROM range(10) a(ix) CROSS JOIN range(12) b(iy) CROSS JOIN range(6) c(iz) LEFT JOIN (SELECT user_id % 10 AS ex, hour(ts) % 12 AS ey, (event_id + {shift}) % 6 AS ez, avg(value) AS m FROM events GROUP BY ALL) ON ix = ex AND iy = ey AND iz = ez)"""


Q = "q AS (SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM g)"
# Reachability by spreading the least label as often as the grid is long.
LABELS = f"""WITH RECURSIVE {_grid()}, {Q}, n AS MATERIALIZED (SELECT g.*, ix * 72 + iy * 6 + iz AS id FROM g, q WHERE value >= hi),
    e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1),
    r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT b AS id, min(a) AS label FROM r GROUP BY b)"""
# Components of both directions with at least two nodes, ranked.
RANKED = f"""WITH RECURSIVE {_grid()}, {Q}, n AS MATERIALIZED (SELECT g.*, ix * 72 + iy * 6 + iz AS id, d AS direction, CASE WHEN ix IN (0, 9) THEN 2.5 ELSE 5 END * CASE WHEN iy IN (0, 11) THEN 1 ELSE 2 END * CASE WHEN iz IN (0, 5) THEN 1 ELSE 2 END AS w FROM g, q, (VALUES ('high'), ('low')) t(d) WHERE CASE d WHEN 'high' THEN value >= hi ELSE value <= lo END),
    e AS MATERIALIZED (SELECT a.direction AS d, a.id AS a, b.id AS b FROM n a JOIN n b ON a.direction = b.direction AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1),
    r AS (SELECT direction AS d, id AS a, id AS b FROM n UNION SELECT r.d, r.a, e.b FROM r JOIN e ON r.b = e.a AND r.d = e.d), l AS (SELECT d AS direction, b AS id, min(a) AS label FROM r GROUP BY d, b),
    s AS (SELECT direction, label, count(*) AS n, sum(w) AS measure, min(value) AS lowest, max(value) AS highest, bool_or(ix IN (0, 9) OR iy IN (0, 11) OR iz IN (0, 5)) AS touches FROM n JOIN l USING (direction, id) GROUP BY direction, label HAVING count(*) >= 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY label) AS id FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY measure DESC, CASE direction WHEN 'high' THEN -highest ELSE lowest END, id)::INT AS rank FROM k),
    ranked AS (SELECT *, CASE direction WHEN 'low' THEN '低-' ELSE '' END || chr(64 + rank) AS letter FROM o WHERE rank <= 10)"""
ORACLE = {
    "s16_grid_import": f"WITH {_grid()} SELECT ix, iy, iz, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, round(value, 6) AS value, value IS NULL AS is_nodata FROM g",
    "g15_same_axes": f"WITH {_grid()}, {_grid('h', 1)}, p AS (SELECT * FROM g WHERE ix % 2 = 0 AND iy % 2 = 0 AND iz % 2 = 0), n AS (SELECT count(value) AS valid FROM g) SELECT 'shifted' AS other, (SELECT count(DISTINCT (ix, iy, iz)) FROM g) = (SELECT count(*) FROM g SEMI JOIN h USING (x, y, z)) AS same, valid FROM n UNION ALL SELECT 'preview', (SELECT count(*) FROM g) = (SELECT count(*) FROM p), valid FROM n",
    "l02_decimated_nodes": f"WITH {_grid()} SELECT ix * 72 + iy * 6 + iz + 1 AS row, round(value, 6) AS value FROM g WHERE value IS NOT NULL AND (ix * 72 + iy * 6 + iz) % 4 = 0",
    "g09_gated_components": f"""WITH RECURSIVE {_grid()}, h AS (SELECT median(value) AS hi FROM g), n AS MATERIALIZED (SELECT g.*, ix * 72 + iy * 6 + iz AS id, (ix + 2 * iy + 3 * iz) % 7 / 2 AS err FROM g, h WHERE value >= hi AND (ix + 2 * iy + 3 * iz) % 7 <= 4),
        e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1),
        r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT b AS id, min(a) AS label FROM r GROUP BY b)
        SELECT row_number() OVER (ORDER BY label)::INT AS component_id, count(*) AS support_node_count, round(max(value), 6) AS value_max, min(err)::DOUBLE AS err_min, max(err)::DOUBLE AS err_max, round(avg(err), 6) AS err_mean FROM n JOIN l USING (id) GROUP BY label HAVING count(*) >= 2""",
    "g10_ranked_components": f"{RANKED} SELECT direction, rank, letter, (id + CASE direction WHEN 'low' THEN 1000000 ELSE 0 END)::INT AS component_id, n AS support_node_count, round(lowest, 6) AS value_min, round(highest, 6) AS value_max FROM ranked",
    "g01_grid": f"WITH {_grid()} SELECT ix, iy, iz, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, round(value, 6) AS value, is_nodata FROM g",
    "g04_slice": f"WITH {_grid()} SELECT ix, iy, round(value, 6) AS value, is_nodata FROM g WHERE iz = 3",
    "a23_slice_statistics": f"WITH {_grid()}, {Q} SELECT count(*) AS total, count(value) AS valid, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (WHERE value < lo) AS low, count(*) FILTER (WHERE value >= lo AND value < hi) AS normal, count(*) FILTER (WHERE value >= hi) AS high FROM g, q WHERE iz = 3",
    "a24_grid_statistics": f"WITH {_grid()} SELECT count(*) AS total, count(value) AS valid, count(*) - count(value) AS nodata, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM g",
    "a25_composition": f"WITH {_grid()}, {Q} SELECT CASE WHEN value >= hi THEN 'high' WHEN value < lo THEN 'low' ELSE 'normal' END AS class, count(*) AS n, round(count(*) / (SELECT count(value) FROM g), 6) AS ratio FROM g, q WHERE value IS NOT NULL GROUP BY 1",
    "a26_depth_profile": f"""WITH {_grid()}, {Q}, e AS (SELECT b::INT AS bin, -10 + b * 1.25 AS lower, -10 + (b + 1) * 1.25 AS upper FROM range(8) t(b))
        SELECT bin, lower::DOUBLE AS lower, upper::DOUBLE AS upper, count(value) AS n, coalesce(round(avg(value), 6), 0) AS mean, coalesce(round(count(*) FILTER (WHERE value >= hi) / nullif(count(value), 0), 6), 0) AS high_ratio
        FROM e CROSS JOIN q LEFT JOIN (SELECT * FROM g WHERE value IS NOT NULL) g ON z >= lower AND (z < upper OR bin = 7) GROUP BY bin, lower, upper""",
    "a27_grid_difference": f"WITH {_grid()}, {_grid('h', 1)} SELECT count(*) AS common, round(avg(abs(g.value - h.value)), 6) AS mean_abs, round(max(abs(g.value - h.value)), 6) AS max_abs FROM g JOIN h USING (ix, iy, iz) WHERE g.value IS NOT NULL AND h.value IS NOT NULL",
    "g07_support": f"WITH {_grid()} SELECT ix, iy, iz, ((CASE WHEN ix IN (0, 9) THEN 2.5 ELSE 5 END) * (CASE WHEN iy IN (0, 11) THEN 1.0 ELSE 2 END) * (CASE WHEN iz IN (0, 5) THEN 1.0 ELSE 2 END))::DOUBLE AS measure FROM g",
    "g11_trilinear": f"""WITH {_grid()}, p AS (SELECT i AS query_id, greatest(0, least(9, (i * 0.25 - 1) / 5)) AS fx, greatest(0, least(11, (i % 23) / 2)) AS fy, greatest(0, least(5, (i % 11) / 2)) AS fz FROM range(200) t(i)),
        b AS (SELECT *, least(floor(fx), 8) AS bx, least(floor(fy), 10) AS b_y, least(floor(fz), 4) AS bz FROM p),
        c AS (SELECT query_id, value, abs(1 - oi - (fx - bx)) * abs(1 - oj - (fy - b_y)) * abs(1 - ok - (fz - bz)) AS w FROM b CROSS JOIN range(2) i(oi) CROSS JOIN range(2) j(oj) CROSS JOIN range(2) k(ok) LEFT JOIN g ON ix = bx + oi AND iy = b_y + oj AND iz = bz + ok)
        SELECT query_id, round(CASE WHEN count(*) = count(value) THEN sum(w * value) END, 6) AS value FROM c GROUP BY query_id""",
    "g12_snap": """SELECT greatest(0, least(9, ceil(user_id / 5 - 0.5)))::INT AS ix, greatest(0, least(11, ceil(hour(ts) / 2 - 0.5)))::INT AS iy, greatest(0, least(5, ceil((-(event_id % 11) + 10) / 2 - 0.5)))::INT AS iz, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL""",
    "g13_neighbor_mean": f"WITH {_grid()} SELECT a.ix, a.iy, a.iz, count(b.value) AS n, round(avg(b.value), 6) AS mean FROM g a LEFT JOIN g b ON greatest(abs(a.ix - b.ix), abs(a.iy - b.iy), abs(a.iz - b.iz)) = 1 AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) <= 2 GROUP BY a.ix, a.iy, a.iz",
    "l04_preview": f"WITH {_grid()} SELECT ix, iy, iz FROM g WHERE ix % 2 = 0 AND iy % 2 = 0 AND iz % 2 = 0",
    "g08_components": f"""{LABELS}, s AS (SELECT n.*, label, CASE WHEN ix IN (0, 9) THEN 2.5 ELSE 5 END * CASE WHEN iy IN (0, 11) THEN 1 ELSE 2 END * CASE WHEN iz IN (0, 5) THEN 1 ELSE 2 END AS w FROM n JOIN l USING (id))
        SELECT row_number() OVER (ORDER BY label)::INT AS component_id, count(*) AS support_node_count, round(sum(w)::DOUBLE, 6) AS support_measure, min(x)::DOUBLE AS x_min, max(x)::DOUBLE AS x_max, min(y)::DOUBLE AS y_min, max(y)::DOUBLE AS y_max, min(z)::DOUBLE AS z_min, max(z)::DOUBLE AS z_max,
               round((sum(x * w) / sum(w))::DOUBLE, 6) AS x_centroid, round((sum(y * w) / sum(w))::DOUBLE, 6) AS y_centroid, round((sum(z * w) / sum(w))::DOUBLE, 6) AS z_centroid, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(avg(value), 6) AS value_mean,
               bool_or(ix IN (0, 9) OR iy IN (0, 11) OR iz IN (0, 5)) AS touches_grid_boundary FROM s GROUP BY label""",
}
