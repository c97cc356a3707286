"""Settled fields against a dense solve, several problems at once, and every gate; grouped neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from terralith.operators import bricks, grouped_neighbors, smoothing
from terralith.operators.errors import GeoError
from terralith.operators.grid import Axis, default_axes, offsets

SAMPLE = "problem int, source_row bigint, x double, y double, z double, value double"


def dense(axes, samples, connectivity):
    """The field solved as one system of equations."""
    shape = tuple(a.nodes for a in axes)
    coords = [[a.high if i == a.nodes - 1 else a.low + i * a.step for i in range(a.nodes)] for a in axes]
    low, high = samples[:, :3].min(axis=0), samples[:, :3].max(axis=0)
    seen = {}
    for row in samples:
        at = tuple(int(min(max(np.ceil((v - a.low) / a.step - 0.5), 0), a.nodes - 1)) for v, a in zip(row, axes, strict=False))
        seen.setdefault(at, []).append(row[3])
    inside = lambda at: all(low[j] <= coords[j][at[j]] <= high[j] for j in range(3))
    nodes = [at for at in np.ndindex(*shape) if at in seen or inside(at)]
    number = {at: k for k, at in enumerate(nodes)}
    a, b = np.eye(len(nodes)), np.zeros(len(nodes))
    for at, k in number.items():
        if at in seen:
            b[k] = np.mean(seen[at])
            continue
        near = [number[n] for d in offsets(connectivity) if (n := tuple(i + o for i, o in zip(at, d, strict=True))) in number]
        a[k, k] = len(near)
        a[k, near] = -1
    return dict(zip(nodes, np.linalg.solve(a, b), strict=True)), shape


def random_samples(seed, n, width=9.0):
    rng = np.random.RandomState(seed)
    return np.concatenate([rng.rand(n, 3) * width, rng.randn(n, 1)], axis=1)


def test_fields_equal_dense_solves(spark, monkeypatch):
    """Two problems of other grids and neighbourhoods, in bricks of four nodes with coarse cells."""
    monkeypatch.setattr(bricks, "SIDE", 4)
    monkeypatch.setattr(bricks, "MOST_COARSE", 4)
    samples = {0: np.concatenate([random_samples(1, 25), [[0, 0, 0, 0.5], [9, 9, 9, -0.5]]]), 1: random_samples(2, 60, 5.0), 5: random_samples(3, 12, 30.0)}
    axes = {0: (Axis(0.0, 9.0, 10), Axis(0.0, 9.0, 7), Axis(0.0, 9.0, 5)), 1: tuple(default_axes([(v.min(), v.max()) for v in samples[1].T[:3]], 400)), 5: (Axis(-5.0, 40.0, 9),) * 3}
    settings = {0: {"neighbor_connectivity": 6}, 1: {"neighbor_connectivity": 26}, 5: {"neighbor_connectivity": 18}}
    df = spark.createDataFrame([(k, i, *map(float, r)) for k, rows in samples.items() for i, r in enumerate(rows)], SAMPLE)
    fitted = smoothing.fit(df, {k: s | {"convergence_tolerance": 1e-9} for k, s in settings.items()}, axes)
    got = {}
    for r in fitted.field.collect():
        got.setdefault(r["problem"], {})[r["ix"], r["iy"], r["iz"]] = r["value"]
    for k in (0, 1):
        want, shape = dense(axes[k], samples[k], settings[k]["neighbor_connectivity"])
        assert len(got[k]) == np.prod(shape) and fitted.reports[k]["converged"] and fitted.reports[k]["max_delta"] < 2e-9
        assert all((v is None) == (at not in want) and (v is None or abs(v - want[at]) < 1e-6) for at, v in got[k].items())
        assert fitted.reports[k]["max_observation_error"] <= 1e-8
    assert fitted.reports[5]["error"] == "DSI_CONSTRAINT" and set(fitted.problems) == {0, 1}  # its outer samples stand beside nodes without data
    at = spark.createDataFrame([(k, i, *map(float, r[:3])) for k, rows in samples.items() for i, r in enumerate(rows)] + [(0, 900, 4.0, 4.0, 4.0), (1, 901, 99.0, 1.0, 1.0)], "problem int, query_id bigint, x double, y double, z double")
    back = {(r["problem"], r["query_id"]): r["value"] for r in smoothing.predict_many(fitted, at).collect()}
    assert all(abs(back[k, i] - samples[k][i][3]) < 1e-8 for k in (0, 1) for i in range(len(samples[k])))
    assert back[0, 900] is not None and back[1, 901] is None and (5, 0) not in back


def test_failures_are_typed_and_alone(spark):
    rows = [(k, i, *map(float, r)) for k in (0, 4) for i, r in enumerate(random_samples(7 + k, 20))]
    rows += [(1, i, float(i), 1.0, 2.0, 1.0) for i in range(2)]  # too few
    rows += [(2, i, 1.0, 1.0, 2.0, float(i)) for i in range(4)]  # one place
    rows += [(3, i, float(i), float(i), 2.0, float("nan") if i == 3 else 1.0) for i in range(5)]
    fitted = smoothing.fit(spark.createDataFrame(rows, SAMPLE), {k: {} for k in (0, 1, 2, 3, 9)} | {4: {"max_iterations": 1, "convergence_tolerance": 1e-9}}, cells=2000)
    errors = {k: r.get("error") for k, r in fitted.reports.items()}
    assert errors == {0: None, 1: "DSI_NO_SUPPORTED_NODES", 2: "DSI_DUPLICATE_COORDINATES", 3: "DSI_INPUT_INVALID", 9: "DSI_INPUT_INVALID", 4: "DSI_NOT_CONVERGED"}
    with pytest.raises(GeoError, match="DSI_NO_SUPPORTED_NODES"):
        smoothing.raise_failures(fitted.reports)


def test_iterations_hardly_grow(spark):
    """Eight and sixty-four times the nodes with samples as far apart."""
    told = []
    for n in (11, 22, 44):
        rng = np.random.RandomState(n)
        at = np.unique(np.concatenate([rng.randint(0, n, (n**3 // 500 + 8, 3)), [[0, 0, 0], [n - 1] * 3]]), axis=0)
        df = spark.createDataFrame([(0, i, *map(float, p), float(np.sin(p[0] / n * 6) + rng.rand())) for i, p in enumerate(at)], SAMPLE)
        fitted = smoothing.fit(df, {0: {}}, {0: (Axis(0.0, n - 1.0, n),) * 3})
        told.append(fitted.reports[0]["iterations"])
    assert max(told) <= 25 and told[2] <= 2.5 * told[0]


def test_neighbors_by_set_and_apart_from_a_share(spark):
    rng = np.random.RandomState(4)
    p = np.round(rng.rand(400, 2) * [10, 6], 1)  # ties and equal places
    p[:150] = p[:150] / 50  # a crowded corner
    own = rng.randint(0, 3, 400)
    rows = [(s, i, *(map(float, p[i] * (1 + s))), float(i), int(own[i]) if s else None) for s in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "space int, source_row bigint, x double, y double, value double, own int")
    queries = df.select(df["source_row"].alias("query_id"), "space", "x", "y", "own")
    for k in (3, 300):
        got = {}
        for r in grouped_neighbors.nearest_by(queries, df, k, "space", ["x", "y"], "own").collect():
            got.setdefault((r["space"], r["query_id"]), []).append((r["k"], r["source_row"]))
        for s in (0, 1):
            for q in range(0, 400, 7):
                d = np.sqrt(((p[q] * (1 + s) - p * (1 + s)) ** 2).sum(axis=1))
                seen = [i for i in range(400) if s == 0 or own[i] != own[q]]
                want = sorted(seen, key=lambda i: (d[i], i))[:k]
                have = [i for _, i in sorted(got[s, q])]
                assert len(have) == len(want) and np.allclose(d[have], d[want]) and (k == 300 or have == want or np.allclose(d[have], d[want], atol=1e-12))
