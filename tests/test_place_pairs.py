"""Pairs of rows at repeated places: sums by places against every pair one by one."""

from itertools import combinations

import numpy as np
import pytest

from terralith.operators import neighbors, variogram

SCHEMA = "source_row long, x double, y double, value double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, float(rng.integers(0, 4)), float(rng.integers(-2, 3)), float(rng.integers(0, 900)) / 7) for i in range(90)]
    return [(i, x, y, None if i % 23 == 5 else v) for i, x, y, v in out]


def every_pair(rows):
    for (_, ax, ay, av), (_, bx, by, bv) in combinations(rows, 2):
        yield float(np.hypot(bx - ax, by - ay)), bx - ax, by - ay, None if av is None or bv is None else 0.5 * (av - bv) ** 2


def expected(pairs, width, bins):
    out = []
    for b in range(bins):
        mine = [(h, g) for h, _, _, g in pairs if (h > b * width or (b == 0 and h == 0)) and h <= (b + 1) * width]
        out.append((len(mine), np.mean([h for h, _ in mine]), np.mean([g for _, g in mine if g is not None])) if mine else (0, None, None))
    return out


@pytest.mark.parametrize("azimuth", [None, 0.0, 45.0])
def test_bins_over_places_hold_every_pair(spark, rows, azimuth):
    held = neighbors.places(spark.createDataFrame(rows, SCHEMA))
    pairs = neighbors.place_pairs(held, 3.0)
    want = list(every_pair(rows))
    if azimuth is not None:
        pairs = variogram.along(pairs, azimuth, 22.5)
        want = [p for p in want if abs((np.degrees(np.arctan2(p[2], p[1])) % 180 - azimuth + 90) % 180 - 90) <= 22.5 + 1e-9]
    assert pairs.count() < len(want) / 3  # a row for two places, not for two rows
    got = variogram.binned(pairs, 1.0, 3, 1).orderBy("bin").collect()
    for r, (n, h, g) in zip(got, expected(want, 1.0, 3), strict=True):
        assert r["pair_count"] == n
        assert (r["mean_distance"], r["semivariance"]) == pytest.approx((h, g))


def test_lags_over_all_pairs_sample_none(spark, rows):
    points = spark.createDataFrame(rows, SCHEMA)
    want = list(every_pair(rows))
    top = max(h for h, *_ in want)
    got = variogram.lag_bins(points, 4, None).orderBy("bin").collect()
    assert sum(r["pair_count"] for r in got) == len(want) == 90 * 89 // 2
    for b, r in enumerate(got):
        mine = [g for h, _, _, g in want if max(0, min(3, np.ceil(h / (top / 4)) - 1)) == b and g is not None]
        assert r["semivariance"] == pytest.approx(np.mean(mine))


def test_lag_query_counts_all_pairs_of_a_larger_table(spark, tmp_path):
    """1,500 suppliers have more pairs (1,124,250) than the sample held."""
    from terralith.plans.modelling_queries import x01

    i = "id as s_suppkey, id % 25 as s_nationkey, cast(id * 37 % 1000 as double) as s_acctbal"
    spark.range(1500).selectExpr(*i.split(", ")).write.parquet(f"{tmp_path}/supplier.parquet")
    assert sum(r["pair_count"] for r in x01(spark, str(tmp_path)).collect()) == 1500 * 1499 // 2


@pytest.mark.parametrize("most", [1000, 25])
def test_later_rows_within_a_radius(spark, rows, most):
    got = {r["i"]: (r["n"], r["h"]) for r in neighbors.later_within_radius(spark.createDataFrame(rows, SCHEMA), 1.5, most=most).collect()}
    want = {}
    for (i, ax, ay, _), (_, bx, by, _) in combinations(rows, 2):
        h = float(np.hypot(bx - ax, by - ay))
        if h <= 1.5:
            n, total = want.get(i, (0, 0.0))
            want[i] = n + 1, total + h
    assert set(got) == set(want)
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_weighted_mean_adds_in_the_order_of_distance(spark):
    """Eight rows at one distance: the sum of value / d ** 2 in their order, whatever order they come in."""
    rng = np.random.default_rng(5)
    d, values = 0.7826237921249262, (rng.random(8) * 500_000).round(2).tolist()
    top = below = 0.0
    for v in values:  # sum() makes up for lost digits
        top, below = top + v / (d * d), below + 1 / (d * d)
    want = top / below
    near = [(0, i, v, d) for i, v in enumerate(values)]
    for order in (near, near[::-1]):
        table = spark.createDataFrame([(0,)], "query_id long"), spark.createDataFrame(order, "query_id long, source_row long, value double, d double")
        assert neighbors.weighted(*table).first()["value"] == want
