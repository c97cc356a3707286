"""Trees against an exhaustive search for cuts, and forests that are grown in pieces against forests grown whole."""

from __future__ import annotations

import numpy as np
import pytest

from terralith.operators import forests
from terralith.operators.forests import Settings, copies, features, grow

SAMPLE = "problem int, source_row bigint, x double, y double, value double"


def brute_tree(x, y, w, depth, leaf):
    """Recursive best cuts; returns the prediction function."""
    value = float((w * y).sum() / w.sum())
    best = None
    if depth:
        here = (w * y).sum() ** 2 / w.sum()
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= c
                if min(left.sum(), (~left).sum()) >= leaf:
                    score = (w * y)[left].sum() ** 2 / w[left].sum() + (w * y)[~left].sum() ** 2 / w[~left].sum()
                    if score > here * (1 + 1e-9) and (best is None or score > best[0] * (1 + 1e-12)):
                        best = score, f, (c + x[x[:, f] > c, f].min()) / 2
    if best is None:
        return lambda q: np.full(len(q), value)
    _, f, cut = best
    left = x[:, f] <= cut
    low, high = brute_tree(x[left], y[left], w[left], depth - 1, leaf), brute_tree(x[~left], y[~left], w[~left], depth - 1, leaf)

    def run(q):
        out, at = np.zeros(len(q)), q[:, f] <= cut
        out[at], out[~at] = low(q[at]), high(q[~at])
        return out

    return run


@pytest.mark.parametrize(("depth", "leaf"), [(0, 1), (3, 1), (18, 2), (4, 7)])
def test_trees_take_the_best_cuts(depth, leaf):
    rng = np.random.RandomState(depth)
    x = np.round(rng.rand(160, 3) * 40) / 7
    y, w = np.sin(x[:, 0]) + x[:, 1] * 0.3 + rng.randn(160) * 0.2, rng.randint(1, 4, 160).astype(float)
    tree, want = grow(x, y, w, depth, leaf, 1.0, np.random.default_rng(1)), brute_tree(x, y, w, depth, leaf)
    assert np.allclose(tree.value[tree.find(x)], want(x)) and np.allclose(tree.value[tree.find(x + 0.01)], want(x + 0.01))
    assert np.bincount(tree.find(x)).max() >= leaf and (depth < 18 or np.bincount(tree.find(x))[np.unique(tree.find(x))].min() >= leaf)


def test_draws_follow_poisson():
    w = copies(np.arange(200_000), 7, 1, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w, copies(np.arange(200_000), 7, 1, 4))[0, 1]) < 0.01


def test_forests_of_several_problems(spark):
    rng = np.random.RandomState(2)
    rows = [(k, i, *map(float, p), float(np.sin(p[0]) + p[1] * (1 + k))) for k in (0, 3) for i, p in enumerate(rng.rand(300, 2) * 6)]
    df = spark.createDataFrame(rows, SAMPLE)
    asked = [(k, 1000 + i, *map(float, p)) for k in (0, 3, 8) for i, p in enumerate(rng.rand(40, 2) * 6)]
    settings = {0: Settings(12, 18, 2), 3: Settings(7, 5, 3, 1.0, 5), 8: Settings(3)}
    out = {(r["problem"], r["query_id"]): (r["value"], r["spread"]) for r in forests.predict_forests(df, spark.createDataFrame(asked, "problem int, query_id bigint, x double, y double"), settings, ["x", "y"]).collect()}
    assert set(out) == {(k, q) for k, q, *_ in asked if k != 8}
    for k, s in ((0, settings[0]), (3, settings[3])):
        x = np.array([r[2:4] for r in rows if r[0] == k])
        y, ids = np.array([r[4] for r in rows if r[0] == k]), np.arange(300)
        q = features(np.array([a[2:] for a in asked if a[0] == k]), x.mean(axis=0), x.std(axis=0))
        f, each = features(x, x.mean(axis=0), x.std(axis=0)), []
        for t in range(s.trees):
            w = copies(ids, s.seed, k, t)
            tree = grow(f[w > 0], y[w > 0], w[w > 0].astype(float), s.depth, s.leaf, s.share, np.random.default_rng((s.seed, k, t, 0)))
            each.append(tree.value[tree.find(q)])
        want = np.array(each)
        got = np.array([out[k, a[1]] for a in asked if a[0] == k])
        assert np.allclose(got[:, 0], want.mean(axis=0)) and np.allclose(got[:, 1], want.std(axis=0))
        truth = np.array([np.sin(a[2]) + a[3] * (1 + k) for a in asked if a[0] == k])
        assert np.corrcoef(got[:, 0], truth)[0, 1] > 0.9


def test_large_nodes_are_cut_by_histograms(spark, monkeypatch):
    """With nodes of at most 300 rows the upper levels come from histograms; the forest predicts as well as one grown whole."""
    rng = np.random.RandomState(5)
    p = rng.rand(3000, 2) * 10
    value = lambda a: np.sin(a[:, 0]) * 2 + np.floor(a[:, 1])
    df = spark.createDataFrame([(0, i, *map(float, a), float(v)) for i, (a, v) in enumerate(zip(p, value(p), strict=True))], SAMPLE).repartition(3)
    q = rng.rand(400, 2) * 10
    asked = spark.createDataFrame([(0, i, *map(float, a)) for i, a in enumerate(q)], "problem int, query_id bigint, x double, y double")
    errors = []
    for most in (10**9, 300):
        monkeypatch.setattr(forests, "LOCAL", most)
        out = sorted((r["query_id"], r["value"]) for r in forests.predict_forests(df, asked, {0: Settings(20)}, ["x", "y"]).collect())
        assert len(out) == 400
        errors.append(float(np.sqrt(np.mean((np.array([v for _, v in out]) - value(q)) ** 2))))
    assert errors[1] != errors[0]
    assert errors[1] < errors[0] * 1.3 + 0.02 and errors[0] < 0.5


def test_rows_at_repeated_places_are_added_up(spark, monkeypatch):
    """The same forest from sums by place as from single rows, and nothing is dealt row by row."""
    rng = np.random.default_rng(8)
    rows = [(0, i, float(rng.integers(0, 6)), float(rng.integers(0, 5)), float(rng.random())) for i in range(400)]
    asked = [(0, i, float(rng.random() * 6), float(rng.random() * 5)) for i in range(40)] + [(0, 100, 1.0, 1.0), (0, 101, 1.0, 1.0)]
    samples, queries = spark.createDataFrame(rows, "problem int, source_row long, x double, y double, value double"), spark.createDataFrame(asked, "problem int, query_id long, x double, y double")
    run = lambda: {r["query_id"]: (r["value"], r["spread"]) for r in forests.predict_forests(samples, queries, {0: forests.Settings(12, 6)}, ["x", "y"]).collect()}
    monkeypatch.setattr(forests, "MOST_PLACES", 0)
    one_by_one = run()
    monkeypatch.undo()
    monkeypatch.setattr(forests, "_deal", None)
    found = run()
    assert set(found) == set(one_by_one) == {i for _, i, *_ in asked}
    assert found[100] == found[101]
    for k, v in found.items():
        assert v == pytest.approx(one_by_one[k])
