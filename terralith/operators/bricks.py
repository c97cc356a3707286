"""Discrete smooth fields on grids by conjugate gradients over bricks of nodes.

Free nodes are to be the mean of their neighbours, observed nodes stay: a sparse symmetric system.  A grid is cut into bricks
of SIDE nodes a side, one row of a table each, and bricks send their neighbours the layers that touch them.  An iteration is
one Spark job with one exchange (the inner products are those of a conjugate gradient method with a single reduction):
each brick takes its step, smooths its residual, sends layers, and multiplies.

The preconditioner has two levels.  Within a brick a fixed number of Chebyshev steps takes care of what varies over a few
nodes; what varies slowly is corrected on coarse cells of equal nodes, at most MOST_COARSE of a grid, whose sums are all
that the driver sees.  The iterations needed therefore hardly grow with the number of nodes.

Any number of grids (problems) is solved side by side, in the same jobs; each has its own steps and leaves when it has
settled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators.errors import GeoError
from terralith.operators.grid import AXES, INDEX, Axis, offsets
from terralith.operators.shared import checkpointed, forgotten, written

SIDE = 32
MOST_COARSE = 2048
STEPS, SPREAD = 8, 20.0  # Chebyshev steps, and the ratio of the ends of the spectrum that they work on
AROUND = list(product((-1, 0, 1), repeat=3))
OWN = AROUND.index((0, 0, 0))
OUTSIDE, FIXED, FREE = 0, 1, 2

SENT = "problem int, brick int, part int, kinds binary, data binary"
STATE = "problem int, brick int, kinds binary, data binary, gamma double, delta double, worst double, cells binary, sums binary, links binary, bad bigint"


@dataclass(frozen=True)
class Problem:
    """A grid to be settled. ``low`` and ``high`` are the samples' bounds, beyond which nodes have no data; ``strength`` and
    ``tolerance``: settled once strength * |mean of the neighbours - value| is below the tolerance everywhere."""

    key: int
    axes: tuple[Axis, Axis, Axis]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    start: float = 0.0
    connectivity: int = 6
    strength: float = 0.5
    tolerance: float = 1e-4
    iterations: int = 200
    side: int = SIDE
    most_coarse: int = MOST_COARSE

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(a.nodes for a in self.axes)

    @property
    def bricks(self) -> tuple[int, int, int]:
        return tuple(-(-n // self.side) for n in self.shape)

    @property
    def cell(self) -> int:
        side = 8
        while np.prod([-(-n // side) for n in self.shape], dtype=float) > self.most_coarse:
            side *= 2
        return side

    @property
    def coarse(self) -> int:
        return int(np.prod([-(-n // self.cell) for n in self.shape]))

    def place(self, brick: int) -> tuple[int, int, int]:
        _, b, c = self.bricks
        return brick // (b * c), brick // c % b, brick % c

    def number(self, place) -> int | None:
        if any(not 0 <= p < n for p, n in zip(place, self.bricks, strict=True)):
            return None
        return (place[0] * self.bricks[1] + place[1]) * self.bricks[2] + place[2]

    def ranges(self, brick: int) -> list[np.ndarray]:
        """Node numbers of a brick along the axes."""
        return [np.arange(p * self.side, min(n, (p + 1) * self.side)) for p, n in zip(self.place(brick), self.shape, strict=True)]

    def coords(self, brick: int) -> list[np.ndarray]:
        return [np.where(i == a.nodes - 1, a.high, a.low + i * a.step) for i, a in zip(self.ranges(brick), self.axes, strict=True)]

    def cells(self, brick: int, margin: int = 0) -> np.ndarray:
        """The coarse cell of each node of a brick (with a margin around it, -1 beyond the grid)."""
        across = [-(-n // self.cell) for n in self.shape]
        parts = []
        for i, n in zip(self.ranges(brick), self.shape, strict=True):
            i = np.arange(i[0] - margin, i[-1] + 1 + margin)
            parts.append(np.where((i >= 0) & (i < n), i // self.cell, -1))
        a, b, c = np.meshgrid(*parts, indexing="ij")
        return np.where((a < 0) | (b < 0) | (c < 0), -1, (a * across[1] + b) * across[2] + c)


def _around(padded: np.ndarray, connectivity: int) -> np.ndarray:
    """Sums over the neighbours of a padded array's inside."""
    n = [s - 2 for s in padded.shape]
    out = np.zeros(n, padded.dtype)
    for d in offsets(connectivity):
        out += padded[tuple(slice(1 + o, 1 + o + s) for o, s in zip(d, n, strict=True))]
    return out


def _layer(d: tuple[int, int, int], near: bool) -> tuple[slice, ...]:
    """Where a brick's layer for the neighbour at ``d`` lies in its own array, or (not ``near``) in the padded array of the
    brick that gets it from ``d``."""
    if near:
        return tuple(slice(None) if o == 0 else slice(-1, None) if o > 0 else slice(0, 1) for o in d)
    return tuple(slice(1, -1) if o == 0 else slice(-1, None) if o > 0 else slice(0, 1) for o in d)


def _send(problem: Problem, brick: int, kinds: np.ndarray, own: np.ndarray, layer_of: np.ndarray) -> pa.RecordBatch:
    """The brick's own row, and its layers for its neighbours (``part``: where these see them come from)."""
    to, part, all_kinds, data = [brick], [OWN], [kinds.tobytes()], [own.tobytes()]
    for d in AROUND:
        other = problem.number([p + o for p, o in zip(problem.place(brick), d, strict=True)])
        if d != (0, 0, 0) and other is not None:
            at = _layer(d, True)
            to.append(other)
            part.append(AROUND.index(tuple(-o for o in d)))
            all_kinds.append(np.ascontiguousarray(kinds[at]).tobytes())
            data.append(np.ascontiguousarray(layer_of[at]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([problem.key] * len(to), pa.int32()), pa.array(to, pa.int32()), pa.array(part, pa.int32()), pa.array(all_kinds, pa.binary()), pa.array(data, pa.binary())], names=["problem", "brick", "part", "kinds", "data"])


def _gather(problem: Problem, group: pa.Table, rows: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(brick, kinds, own arrays, padded kinds, padded layer) of a brick from what was sent to it."""
    brick = group.column("brick")[0].as_py()
    shape = tuple(len(r) for r in problem.ranges(brick))
    padded, around = np.zeros([s + 2 for s in shape]), np.zeros([s + 2 for s in shape], np.uint8)
    kinds = own = None
    for part, kind, data in zip(*(group.column(c).to_pylist() for c in ("part", "kinds", "data")), strict=True):
        at = _layer(AROUND[part], False)
        if part == OWN:
            kinds, own = np.frombuffer(kind, np.uint8).reshape(shape), np.frombuffer(data).reshape(rows, *shape).copy()
            around[at] = kinds
        else:
            around[at] = np.frombuffer(kind, np.uint8).reshape(around[at].shape)
            padded[at] = np.frombuffer(data).reshape(padded[at].shape)
    return brick, kinds, own, around, padded


def _row(problem: Problem, brick: int, kinds: np.ndarray, arrays: np.ndarray, gamma=0.0, delta=0.0, worst=0.0, sums=None, links=b"", bad=0) -> pa.Table:
    cells = problem.cells(brick)
    found, which = np.unique(cells, return_inverse=True)
    total = np.bincount(which.ravel(), (sums if sums is not None else np.zeros(cells.shape)).ravel(), len(found))
    values = [problem.key, brick, kinds.tobytes(), arrays.tobytes(), float(gamma), float(delta), float(worst), found.astype("<i4").tobytes(), total.tobytes(), links, int(bad)]
    kinds_ = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds_, strict=True)], names=[c.split()[0] for c in STATE.split(", ")])


def _begin(problems: dict[int, Problem]) -> Callable:
    """A brick from the observed nodes in it: kinds of nodes and first values, sent round."""

    def run(group: pa.Table) -> pa.Table:
        problem, brick = problems[group.column("problem")[0].as_py()], group.column("brick")[0].as_py()
        ranges = problem.ranges(brick)
        inside = [(c >= a) & (c <= b) for c, a, b in zip(problem.coords(brick), problem.low, problem.high, strict=True)]
        kinds = np.where(inside[0][:, None, None] & inside[1][:, None] & inside[2], FREE, OUTSIDE).astype(np.uint8)
        x = np.where(kinds == FREE, problem.start, 0.0)
        value = group.column("value").to_numpy()
        seen = ~np.isnan(value)
        at = tuple(group.column(c).to_numpy()[seen].astype(int) - r[0] for c, r in zip(INDEX, ranges, strict=True))
        x[at], kinds[at] = value[seen], FIXED
        return pa.Table.from_batches([_send(problem, brick, kinds, x[None], x)])

    return run


def _residual(problems: dict[int, Problem], arrays: int) -> Callable:
    """A brick's first state from its values and its neighbours' layers: residual, its coarse sums, and the numbers of links
    between coarse cells."""

    def run(group: pa.Table) -> pa.Table:
        problem = problems[group.column("problem")[0].as_py()]
        brick, kinds, own, around, x = _gather(problem, group, arrays)
        x[1:-1, 1:-1, 1:-1] = own[0]
        degree = _around((around != OUTSIDE).astype(float), problem.connectivity)
        kinds = np.where((kinds == FREE) & (degree == 0), FIXED, kinds).astype(np.uint8)  # nothing around: the value stays
        free = kinds == FREE
        r = np.where(free, _around(np.where(around != OUTSIDE, x, 0.0), problem.connectivity) - degree * own[0], 0.0)
        cells, n = problem.cells(brick, 1), problem.coarse
        here, free_around = cells[1:-1, 1:-1, 1:-1], (around == FREE) & (cells >= 0)
        keys, counts = [(here[free] * n + here[free])], [degree[free]]
        for d in offsets(problem.connectivity):
            at = tuple(slice(1 + o, 1 + o + s) for o, s in zip(d, kinds.shape, strict=True))
            both = free & free_around[at]
            keys.append(here[both] * n + cells[at][both])
            counts.append(np.full(int(both.sum()), -1.0))
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        links = key.astype("<i8").tobytes() + np.bincount(which, np.concatenate(counts), len(key)).astype("<f8").tobytes()
        zero = np.zeros_like(r)
        worst = np.abs(np.where(free, r / np.maximum(degree, 1), 0)).max(initial=0.0)
        bad = int((~np.isfinite(own[0]) & (kinds != OUTSIDE)).sum())
        return _row(problem, brick, kinds, np.stack([own[0], degree, r, zero, zero, zero, zero]), worst=worst, sums=r, links=links, bad=bad)

    return run


def _smoothed(r: np.ndarray, degree: np.ndarray, free: np.ndarray, connectivity: int) -> np.ndarray:
    """Chebyshev steps towards the solution within a brick, from nothing: a fixed symmetric operator."""
    top, bottom = 2.0, 2.0 / SPREAD
    middle, half = (top + bottom) / 2, (top - bottom) / 2
    weight = np.where(free, 1 / np.maximum(degree, 1), 0.0)
    padded = np.zeros([s + 2 for s in r.shape])
    e = padded[1:-1, 1:-1, 1:-1]
    step = weight * r / middle
    e += step
    rho = half / middle
    for _ in range(STEPS - 1):
        rest = r - degree * e + _around(padded, connectivity)
        after = 1 / (2 * middle / half - rho)
        step = after * rho * step + (2 * after / half) * weight * rest
        e += step
        rho = after
    return e.copy()


def _advance(problems: dict[int, Problem], steps: dict[int, tuple[float, float]], coarse: dict[int, np.ndarray]) -> Callable:
    """Takes the step of the round before, smooths the residual, and sends the new direction's layers."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                problem, brick = problems[row["problem"]], row["brick"]
                shape = tuple(len(r) for r in problem.ranges(brick))
                kinds = np.frombuffer(row["kinds"], np.uint8).reshape(shape)
                x, degree, r, p, s, z, w = np.frombuffer(row["data"]).reshape(7, *shape).copy()
                alpha, beta = steps[problem.key]
                p, s = z + beta * p, w + beta * s
                x, r = x + alpha * p, r - alpha * s
                free = kinds == FREE
                z = np.where(free, _smoothed(r, degree, free, problem.connectivity) + coarse[problem.key][problem.cells(brick)], 0.0)
                yield _send(problem, brick, kinds, np.stack([x, degree, r, p, s, z, w]), z)

    return run


def _multiply(problems: dict[int, Problem]) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        problem = problems[group.column("problem")[0].as_py()]
        brick, kinds, own, _, padded = _gather(problem, group, 7)
        x, degree, r, p, s, z, _ = own
        padded[1:-1, 1:-1, 1:-1] = z
        w = np.where(kinds == FREE, degree * z - _around(padded, problem.connectivity), 0.0)
        worst = np.abs(np.where(kinds == FREE, r / np.maximum(degree, 1), 0)).max(initial=0.0)
        return _row(problem, brick, kinds, np.stack([x, degree, r, p, s, z, w]), (r * z).sum(), (z * w).sum(), worst, w)

    return run


def _resend(problems: dict[int, Problem]) -> Callable:
    """A settled brick's values, sent round once more."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                problem, brick = problems[row["problem"]], row["brick"]
                shape = tuple(len(r) for r in problem.ranges(brick))
                x = np.frombuffer(row["data"]).reshape(7, *shape)[0].copy()
                yield _send(problem, brick, np.frombuffer(row["kinds"], np.uint8).reshape(shape), x[None], x)

    return run


@dataclass
class _Course:
    """A problem's numbers on the driver."""

    inverse: np.ndarray
    residual: np.ndarray  # coarse sums
    direction: np.ndarray
    gamma: float = 0.0
    alpha: float = 0.0
    beta: float = 0.0
    iterations: int = 0
    worst: float = float("inf")

    def step(self, gamma: float, delta: float, product_: np.ndarray) -> None:
        self.beta = gamma / self.gamma if self.gamma else 0.0
        below = delta - (self.beta * gamma / self.alpha if self.alpha else 0.0)
        self.alpha = gamma / below if below else 0.0
        self.gamma = gamma
        self.direction = product_ + self.beta * self.direction
        self.residual = self.residual - self.alpha * self.direction


def _totals(rows: list, problems: dict[int, Problem]) -> dict[int, dict]:
    out = {k: {"gamma": 0.0, "delta": 0.0, "worst": 0.0, "bad": 0, "sums": np.zeros(p.coarse)} for k, p in problems.items()}
    for r in sorted(rows, key=lambda r: (r["problem"], r["brick"])):
        t = out[r["problem"]]
        t["gamma"], t["delta"], t["bad"] = t["gamma"] + r["gamma"], t["delta"] + r["delta"], t["bad"] + r["bad"]
        t["worst"] = float("nan") if np.isnan(r["worst"]) else max(t["worst"], r["worst"])
        t["sums"][np.frombuffer(r["cells"], "<i4")] += np.frombuffer(r["sums"])
    return out


def _coarse_inverse(links: list[bytes], n: int) -> np.ndarray:
    a = np.zeros(n * n)
    for data in links:
        half = len(data) // 16
        np.add.at(a, np.frombuffer(data, "<i8", half), np.frombuffer(data, "<f8", half, 8 * half))
    a = a.reshape(n, n)
    a[np.diag_indices(n)] += np.where(a.diagonal() == 0, 1.0, a.diagonal() * 1e-12)
    return np.linalg.inv(a)


def settle(spark: SparkSession, problems: list[Problem], observed: DataFrame) -> tuple[DataFrame, dict[int, dict]]:
    """(field, reports). ``observed``: problem, ix, iy, iz, value, one row for each observed node. The field has problem, ix, iy,
    iz, x, y, z, value and is_nodata for every node.

    A report has ``converged``, ``iterations``, ``max_delta`` (from the residual worked out anew at the end), ``supported`` and, where a problem
    failed, its ``error``: DSI_NON_FINITE or DSI_NOT_CONVERGED. A problem that fails doesn't hold up the others.
    """
    by = {p.key: p for p in problems}
    reports: dict[int, dict] = {}
    of = lambda value: F.element_at(F.create_map(*(F.lit(v) for p in problems for v in (p.key, value(p)))), F.col("problem"))
    numbers = [F.floor(F.col(c) / of(lambda p: p.side)).cast("int") for c in INDEX]
    across = [of(lambda p, j=j: p.bricks[j]) for j in (1, 2)]
    seen = observed.select("problem", ((numbers[0] * across[0] + numbers[1]) * across[1] + numbers[2]).cast("int").alias("brick"), *(F.col(c).cast("int").alias(c) for c in INDEX), F.col("value").cast("double").alias("value"))
    every = spark.createDataFrame([(p.key, b) for p in problems for b in range(int(np.prod(p.bricks)))], "problem int, brick int")  # a row for each brick
    every = every.select("problem", "brick", *(F.lit(0).alias(c) for c in INDEX), F.lit(float("nan")).alias("value"))
    keys = ["problem", "brick"]
    sent = seen.unionByName(every).groupBy(*keys).applyInArrow(_begin(by), SENT)
    state = made = written(sent.groupBy(*keys).applyInArrow(_residual(by, 1), STATE))
    rows = state.drop("kinds", "data").collect()  # sums of each brick
    first, links = _totals(rows, by), {k: [r["links"] for r in rows if r["problem"] == k] for k in by}
    courses = {k: _Course(_coarse_inverse(links[k], p.coarse), first[k]["sums"], np.zeros(p.coarse), worst=first[k]["worst"]) for k, p in by.items()}
    active, done = set(by), None
    while True:
        leaving = set()
        for k in active:
            c, p = courses[k], by[k]
            if not np.isfinite(c.worst) or first[k]["bad"]:
                reports[k] = {"error": "DSI_NON_FINITE"}
            elif p.strength * c.worst < p.tolerance:
                reports[k] = {}
            elif c.iterations >= p.iterations:
                reports[k] = {"error": "DSI_NOT_CONVERGED"}
            else:
                continue
            leaving.add(k)
        if leaving:
            part = checkpointed(state.where(F.col("problem").isin(*leaving)))
            done = part if done is None else done.unionByName(part)
            state, active = state.where(~F.col("problem").isin(*leaving)), active - leaving
        if not active:
            break
        steps = {k: (courses[k].alpha, courses[k].beta) for k in active}
        corrections = {k: courses[k].inverse @ courses[k].residual for k in active}
        moved = state.select("problem", "brick", "kinds", "data").mapInArrow(_advance(by, steps, corrections), SENT)
        state = written(moved.groupBy(*keys).applyInArrow(_multiply(by), STATE))
        forgotten(made)
        made = state
        totals = _totals(state.drop("kinds", "data", "links").collect(), {k: by[k] for k in active})
        for k in active:
            t, c = totals[k], courses[k]
            c.worst, c.iterations = t["worst"], c.iterations + 1
            c.step(t["gamma"], t["delta"], t["sums"])
    forgotten(made)
    final = checkpointed(done.select("problem", "brick", "kinds", "data").mapInArrow(_resend(by), SENT).groupBy(*keys).applyInArrow(_residual(by, 1), STATE))
    last = _totals(final.drop("kinds", "data", "links").collect(), by)
    for k, p in by.items():
        delta = p.strength * last[k]["worst"]
        good = "error" not in reports[k] and delta < 2 * p.tolerance  # the residual was carried on by recurrence
        reports[k] |= {"converged": good, "iterations": courses[k].iterations, "max_delta": delta}
        if not good and "error" not in reports[k]:
            reports[k]["error"] = "DSI_NOT_CONVERGED"
    return final.select("problem", "brick", "kinds", "data").mapInArrow(_nodes(by), f"problem int, {', '.join(f'{c} int' for c in INDEX)}, {', '.join(f'{c} double' for c in AXES)}, value double, is_nodata boolean"), reports


def _nodes(problems: dict[int, Problem]) -> Callable:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                problem, brick = problems[row["problem"]], row["brick"]
                ranges = problem.ranges(brick)
                shape = tuple(map(len, ranges))
                index = [i.ravel() for i in np.meshgrid(*ranges, indexing="ij")]
                coords = [c.ravel() for c in np.meshgrid(*problem.coords(brick), indexing="ij")]
                outside = np.frombuffer(row["kinds"], np.uint8) == OUTSIDE
                value = np.frombuffer(row["data"]).reshape(7, *shape)[0].ravel()
                arrays = [pa.array(np.full(len(value), problem.key), pa.int32()), *(pa.array(i, pa.int32()) for i in index), *(pa.array(c, pa.float64()) for c in coords), pa.array(value, pa.float64(), mask=outside), pa.array(outside)]
                yield pa.RecordBatch.from_arrays(arrays, names=["problem", *INDEX, *AXES, "value", "is_nodata"])

    return run


def failed(reports: dict[int, dict]) -> None:
    for k, r in sorted(reports.items()):
        if "error" in r:
            raise GeoError(r["error"], problem=k, iterations=r["iterations"], max_delta=r["max_delta"])
