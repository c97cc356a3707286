"""Regression forests on spatial features, all forests of an experiment (problems) grown together.

A tree is grown level by level, on whole numbers of copies that a hash of row, problem and tree draws (Poisson with mean 1).
While a node holds more than LOCAL rows, a level is one pass over the samples: tasks add up histograms over (problem, tree,
node, feature, bin), streams of them are summed by problem and tree, and the best cuts go to the driver (a handful for each tree,
since a few levels bring nodes under LOCAL rows).  Then every node's rows meet in a task that grows the rest with exact
cuts, all nodes of a level at a time.  Queries are sent to the nodes that they fall into and are answered there: the trees
themselves never leave their tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.shared import checkpointed

LOCAL = 200_000  # rows of a problem or node that a task finishes
BINS = 64
TIE = 1e-12  # scores as near as this are equal: the first cut of the first feature counts, whatever order rows were added in
TREES_PER_TASK = 5
MOST_PLACES = 50_000  # of a problem, where rows are added up by places
SHARES = 8  # tasks among which the rows of a place are dealt
HELD_BYTES = 64 * 2**20  # sums that a task holds
COPIES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])  # Poisson with mean 1


@dataclass(frozen=True)
class Settings:
    trees: int = 160
    depth: int = 18
    leaf: int = 2
    share: float = 0.8  # of the features that a node looks at
    seed: int = 20260813


def features(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred and scaled places with their radius, products and squares."""
    s = (x - centre) / scale
    a, b = s[:, 0], s[:, 1]
    out = [a, b, np.hypot(a, b), a * b, a * a, b * b]
    if x.shape[1] == 3:
        c = s[:, 2]
        out += [c, a * c, b * c, c * c]
    return np.stack(out, axis=1)


def copies(rows: np.ndarray, seed: int, problem: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    h = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + problem * 8191 + tree) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(COPIES, (h >> np.uint64(11)).astype(np.float64) / 2.0**53, "right")


@dataclass
class Tree:
    """Nodes with the feature and cut that send a row left (value <= cut) or right; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def find(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            at = node[rows]
            inner = self.feature[at] >= 0
            rows, at = rows[inner], at[inner]
            node[rows] = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return node


def _allowed(rng: np.random.Generator, nodes: int, total: int, share: float) -> np.ndarray:
    """Which features each node looks at."""
    return np.argsort(np.argsort(rng.random((nodes, total)), axis=1), axis=1) < max(1, int(share * total))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, leaf: int, share: float, rng: np.random.Generator, rows: np.ndarray | None = None) -> Tree:
    """A tree by exact cuts that lower the squared error most; a leaf holds at least ``leaf`` different rows. ``rows``: how many
    rows an entry stands for (then ``y`` is their mean); each one, where it isn't given."""
    n, total = x.shape
    grouped = np.ones(n) if rows is None else rows.astype(float)
    orders = [np.argsort(x[:, f], kind="stable") for f in range(total)]
    wy = w * y
    parts: list[tuple[np.ndarray, ...]] = []
    at = np.zeros(n, np.int64)  # each row's node within the level
    level, made = 1, 1
    for left_over in range(depth, -1, -1):
        size = np.bincount(at[orders[0]], minlength=level)
        weight = np.bincount(at[orders[0]], w[orders[0]], level)
        total_wy = np.bincount(at[orders[0]], wy[orders[0]], level)
        value = total_wy / np.maximum(weight, 1e-300)
        best, feature, cut = total_wy**2 / np.maximum(weight, 1e-300), np.full(level, -1), np.zeros(level)
        best = best + 1e-12 * np.abs(best) + 1e-300
        if left_over:
            start = np.cumsum(size) - size
            allowed = _allowed(rng, level, total, share)
            of = np.repeat(np.arange(level), size)
            held = np.bincount(at[orders[0]], grouped[orders[0]], level)
            for f in range(total):
                o = orders[f]
                values = x[o, f]
                rank = np.cumsum(grouped[o])
                rank = rank - (rank[start] - grouped[o[start]])[of]
                room = (rank >= leaf) & (held[of] - rank >= leaf)
                w_left, s_left = np.cumsum(w[o]), np.cumsum(wy[o])
                w_left, s_left = w_left - (w_left[start] - w[o[start]])[of], s_left - (s_left[start] - wy[o[start]])[of]
                good = room & allowed[of, f]
                good[:-1] &= values[:-1] < values[1:]
                good[-1:] = False
                k = np.flatnonzero(good)
                if not len(k):
                    continue
                lw, ls = w_left[k], s_left[k]
                score = ls**2 / lw + (total_wy[of[k]] - ls) ** 2 / (weight[of[k]] - lw)
                own, begin = np.unique(of[k], return_index=True)
                top = np.maximum.reduceat(score, begin)
                hit = np.flatnonzero(score >= np.repeat(top * (1 - TIE), np.diff(np.append(begin, len(k)))))
                _, one = np.unique(of[k[hit]], return_index=True)
                place = k[hit[one]]
                better = top > best[own] * (1 + TIE)
                own, place = own[better], place[better]
                best[own], feature[own], cut[own] = top[better], f, (values[place] + values[place + 1]) / 2
        split = feature >= 0
        child = np.where(split, made + 2 * (np.cumsum(split) - 1), 0)
        parts.append((feature, cut, child, child + split, value))
        if not split.any():
            break
        number = np.cumsum(split) - 1
        rows = orders[0]
        kept = split[at[rows]]
        goes = rows[kept]
        node = at[goes]
        at[rows[~kept]] = -1
        at[goes] = 2 * number[node] + (x[goes, feature[node]] > cut[node])
        level = 2 * int(split.sum())
        made += level
        for f in range(total):
            o = orders[f][at[orders[f]] >= 0]
            orders[f] = o[np.argsort(at[o], kind="stable")]
    return Tree(*(np.concatenate(p) for p in zip(*parts, strict=True)))


@dataclass
class _Problem:
    key: int
    settings: Settings
    rows: int
    centre: np.ndarray
    scale: np.ndarray
    edges: np.ndarray | None = None  # of the bins, feature by feature
    tops: dict[int, Tree] | None = None  # the upper levels of each tree, where LOCAL rows are exceeded
    open: dict[int, dict[int, int]] | None = None  # leaves of the upper levels and the rows there


def _batches(batches: Iterator[pa.RecordBatch], axes: list[str], problems: dict[int, _Problem]):
    """(problem, rows, features, values, is_query) of each problem in a batch."""
    for batch in batches:
        key = batch.column("problem").to_numpy()
        x = np.stack([batch.column(a).to_numpy() for a in axes], axis=1)
        row, y, asks = batch.column("row").to_numpy(), batch.column("value").to_numpy(zero_copy_only=False), batch.column("asks").to_numpy(zero_copy_only=False)
        for k in np.unique(key).tolist():
            if k in problems:
                at = key == k
                yield problems[k], row[at], features(x[at], problems[k].centre, problems[k].scale), y[at], asks[at]


def _histograms(axes: list[str], problems: dict[int, _Problem]):
    """A task's sums (copies, values, rows) over node, feature and bin of the nodes that are too large."""

    def run(batches):
        held: dict[tuple[int, int], tuple[list[int], np.ndarray]] = {}
        for p, rows, x, y, asks in _batches(batches, axes, problems):
            rows, x, y = rows[~asks], x[~asks], y[~asks]
            bins = np.stack([np.searchsorted(p.edges[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
            for t, nodes in p.open.items():
                big = sorted(n for n, size in nodes.items() if size > LOCAL)
                if not big:
                    continue
                w = copies(rows, p.settings.seed, p.key, t)
                leaf = p.tops[t].find(x)
                which = np.searchsorted(big, leaf)
                use = (w > 0) & (which < len(big)) & (np.array(big)[np.minimum(which, len(big) - 1)] == leaf)
                _, sums = held.setdefault((p.key, t), (big, np.zeros((3, len(big), x.shape[1], BINS))))
                for f in range(x.shape[1]):
                    place = which[use] * BINS + bins[use, f]
                    for j, v in enumerate((w[use], w[use] * y[use], np.ones(int(use.sum())))):
                        sums[j, :, f] += np.bincount(place, v, len(big) * BINS).reshape(len(big), BINS)
        for (k, t), (_, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["problem", "tree", "sums"])

    return run


def _cuts(problems: dict[int, _Problem], level: int):
    """Adds up the histograms of a tree as they come, and cuts its large nodes at the edge of a bin."""

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, t, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums = np.frombuffer(data)
                held[k, t] = held[k, t] + sums if (k, t) in held else sums.copy()
        for (k, t), flat in held.items():
            p = problems[k]
            big = sorted(n for n, size in p.open[t].items() if size > LOCAL)
            total = len(flat) // (3 * len(big) * BINS)
            sums = flat.reshape(3, len(big), total, BINS)
            w, s, n = np.cumsum(sums, axis=3)
            allowed = _allowed(np.random.default_rng((p.settings.seed, k, t, level)), len(big), total, p.settings.share)
            rest_w, rest_s, rest_n = w[:, :, -1:] - w, s[:, :, -1:] - s, n[:, :, -1:] - n
            good = (n >= p.settings.leaf) & (rest_n >= p.settings.leaf) & allowed[:, :, None]
            score = np.where(good, s**2 / np.maximum(w, 1e-300) + rest_s**2 / np.maximum(rest_w, 1e-300), -np.inf).reshape(len(big), -1)
            best = score.argmax(axis=1)
            for i, node in enumerate(big):
                f, b = divmod(int(best[i]), BINS)
                if np.isfinite(score[i, best[i]]):
                    values = [k, t, node, f, float(p.edges[f][b]), int(n[i, f, b]), int(rest_n[i, f, b]), float(s[i, f, b] / w[i, f, b]), float(rest_s[i, f, b] / rest_w[i, f, b])]
                else:
                    values = [k, t, node, -1, 0.0, 0, 0, 0.0, 0.0]
                kinds = [pa.int32()] * 4 + [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=["problem", "tree", "node", "feature", "cut", "n_left", "n_right", "v_left", "v_right"])

    return run


def _upper_levels(rows: DataFrame, axes: list[str], problems: dict[int, _Problem]) -> None:
    """Cuts the nodes of more than LOCAL rows, one pass for a level of all trees of all problems."""
    large = {k: p for k, p in problems.items() if p.rows > LOCAL}
    if not large:
        return
    samples = rows.where(~F.col("asks") & F.col("problem").isin(*large))
    shares = [i / BINS for i in range(1, BINS)]
    for r in samples.groupBy("problem").agg(*(F.percentile_approx(a, shares, 10_000).alias(a) for a in axes)).collect():
        p = large[r["problem"]]
        # Edges on the features themselves, from the axes' ranks put together at random: bins only have to be fine enough.
        rng = np.random.default_rng(p.settings.seed)
        x = features(np.stack([rng.choice(np.array(r[a], float), 20_000) for a in axes], axis=1), p.centre, p.scale)
        p.edges = np.quantile(x, shares, axis=0).T.copy()
        leaf = Tree(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1))
        p.tops = dict.fromkeys(range(p.settings.trees), leaf)
        p.open = {t: {0: p.rows} for t in p.tops}
    for level in range(max(p.settings.depth for p in large.values())):
        if not any(size > LOCAL for p in large.values() for nodes in p.open.values() for size in nodes.values()):
            break
        told = samples.mapInArrow(_histograms(axes, large), "problem int, tree int, sums binary").repartition("problem", "tree")
        told = told.mapInArrow(_cuts(large, level), "problem int, tree int, node int, feature int, cut double, n_left bigint, n_right bigint, v_left double, v_right double")
        for r in told.collect():  # a row for each large node
            p, t, node = large[r["problem"]], r["tree"], r["node"]
            if r["feature"] < 0 or level + 1 >= p.settings.depth:
                p.open[t][node] = min(p.open[t][node], LOCAL)  # nothing to cut: its rows stay together
                continue
            top = p.tops[t]
            k = len(top.feature)
            grown = Tree(*(np.concatenate([a, b]) for a, b in zip((top.feature, top.cut, top.left, top.right, top.value), ([-1, -1], [0.0, 0.0], [0, 0], [0, 0], [r["v_left"], r["v_right"]]), strict=True)))
            grown.feature[node], grown.cut[node], grown.left[node], grown.right[node] = r["feature"], r["cut"], k, k + 1
            p.tops[t] = grown
            del p.open[t][node]
            p.open[t] |= {k: r["n_left"], k + 1: r["n_right"]}


def _deal(axes: list[str], problems: dict[int, _Problem], names: list[str]):
    """Sends rows to where trees are grown: several trees at once, or a node of the upper levels."""

    def out(p: _Problem, first: int, node: int, rows, x, y, asks) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, p.key), pa.int32()), pa.array(np.full(n, first), pa.int32()), pa.array(np.full(n, node), pa.int32()), pa.array(rows), *(pa.array(x[:, j]) for j in range(len(names))), pa.array(y, pa.float64()), pa.array(asks)], names=["problem", "tree", "node", "row", *names, "value", "asks"])

    def run(batches):
        for p, rows, x, y, asks in _batches(batches, axes, problems):
            if p.tops is None:
                for first in range(0, p.settings.trees, TREES_PER_TASK):
                    yield out(p, first, -1, rows, x, y, asks)
                continue
            for t, top in p.tops.items():
                leaf, drawn = top.find(x), asks | (copies(rows, p.settings.seed, p.key, t) > 0)
                for node in np.unique(leaf).tolist():
                    at = drawn & (leaf == node)
                    yield out(p, t, node, rows[at], x[at], y[at], asks[at])

    return run


def _answers(problems: dict[int, _Problem], names: list[str]):
    """Grows the trees of a group and answers its queries: one number for each tree."""

    def run(group: pa.Table) -> pa.Table:
        p, first, node = problems[group.column("problem")[0].as_py()], group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        rows, y = group.column("row").to_numpy(), group.column("value").to_numpy()
        x = np.stack([group.column(c).to_numpy() for c in names], axis=1)
        asks = group.column("asks").to_numpy()
        order = np.lexsort((rows, asks))  # what comes first doesn't depend on the shuffle
        rows, x, y, asks = rows[order], x[order], y[order], asks[order]
        train, ask = ~asks, x[asks]
        s, found = p.settings, []
        depth = s.depth if node < 0 else max(0, s.depth - _depth(p.tops[first], node))
        for t in range(first, min(first + TREES_PER_TASK, s.trees)) if node < 0 else [first]:
            w = copies(rows[train], s.seed, p.key, t)
            use = w > 0
            if not use.any():
                found.append(np.full(len(ask), float(y[train].mean()) if train.any() else np.nan))
                continue
            tree = grow(x[train][use], y[train][use], w[use].astype(float), depth, s.leaf, s.share, np.random.default_rng((s.seed, p.key, t, node + 1)))
            found.append(tree.value[tree.find(ask)])
        each = np.stack(found, axis=1)
        return pa.table({"problem": pa.array(np.full(len(ask), p.key), pa.int32()), "query_id": pa.array(rows[asks]), "first": pa.array(np.full(len(ask), first), pa.int32()), "found": pa.array(list(each), pa.list_(pa.float64()))})

    return run


def _depth(tree: Tree, node: int) -> int:
    depth = 0
    while node:
        node = int(np.flatnonzero(((tree.left == node) | (tree.right == node)) & (tree.feature >= 0))[0])
        depth += 1
    return depth


def _tallies(axes: list[str], problems: dict[int, _Problem]):
    """What a task's rows at each place add up to in each tree: copies, copies of values, and rows that were drawn."""

    def told(p: _Problem, places: dict[bytes, int], sums: np.ndarray, plain: np.ndarray):
        at = np.array([np.frombuffer(k) for k in places])
        for first in range(0, p.settings.trees, TREES_PER_TASK):
            part = sums[:, : len(places), first : first + TREES_PER_TASK]
            for i in range(0, len(places), 5000):
                n = len(at[i : i + 5000])
                lists = [pa.array(list(part[j, i : i + 5000]), pa.list_(pa.float64())) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p.key), pa.int32()), pa.array(np.full(n, first), pa.int32()), *(pa.array(at[i : i + 5000, j]) for j in range(len(axes))), *lists, *(pa.array(plain[j, i : i + n]) for j in range(2))], names=["problem", "tree", *axes, "w", "s", "n", "total", "rows"])

    def run(batches):
        held: dict[int, tuple[dict[bytes, int], np.ndarray, np.ndarray]] = {}
        for batch in batches:
            key, row, y = batch.column("problem").to_numpy(), batch.column("row").to_numpy(), batch.column("value").to_numpy()
            x = np.stack([batch.column(a).to_numpy() for a in axes], axis=1) + 0.0
            for k in np.unique(key).tolist():
                p, mine = problems[k], key == k
                own, inverse = np.unique(x[mine], axis=0, return_inverse=True)
                inverse = inverse.reshape(-1)
                places, sums, plain = held.get(k) or ({}, np.zeros((3, 0, p.settings.trees)), np.zeros((2, 0)))
                index = np.array([places.setdefault(v.tobytes(), len(places)) for v in own])
                if len(places) > sums.shape[1]:
                    more = max(len(places), 2 * sums.shape[1]) - sums.shape[1]
                    sums, plain = np.pad(sums, ((0, 0), (0, more), (0, 0))), np.pad(plain, ((0, 0), (0, more)))
                count = lambda v: np.bincount(inverse, v, len(own))  # noqa: B023, E731
                plain[0, index] += count(y[mine])
                plain[1, index] += count(None)
                for t in range(p.settings.trees):
                    w = copies(row[mine], p.settings.seed, k, t)
                    for j, v in enumerate((w, w * y[mine], w > 0)):
                        sums[j, index, t] += count(v)
                held[k] = places, sums, plain
                if sums.nbytes > HELD_BYTES:
                    yield from told(p, *held.pop(k))
        for k, one in held.items():
            yield from told(problems[k], *one)

    return run


def _grown(axes: list[str], problems: dict[int, _Problem]):
    """Grows the trees of a group on places and answers its queries."""

    def run(group: pa.Table, asked: pa.Table) -> pa.Table:
        found, k, first, ids = [], 0, 0, np.zeros(0, np.int64)
        if len(group) and len(asked):
            k, first = group.column("problem")[0].as_py(), group.column("tree")[0].as_py()
            p, ids = problems[k], asked.column("query_id").to_numpy()
            s = p.settings
            own, inverse = np.unique(np.stack([group.column(a).to_numpy() for a in axes], axis=1), axis=0, return_inverse=True)
            add = lambda v: np.bincount(inverse.reshape(-1), v, len(own))
            x, ask = features(own, p.centre, p.scale), features(np.stack([asked.column(a).to_numpy() for a in axes], axis=1), p.centre, p.scale)
            lists = [np.array(group.column(c).combine_chunks().flatten()).reshape(len(group), -1) for c in ("w", "s", "n")]
            mean = float(group.column("total").to_numpy().sum() / group.column("rows").to_numpy().sum())
            for t in range(first, min(first + TREES_PER_TASK, s.trees)):
                w, wy, n = (add(v[:, t - first]) for v in lists)
                use = w > 0
                if not use.any():
                    found.append(np.full(len(ask), mean))
                    continue
                tree = grow(x[use], wy[use] / w[use], w[use], s.depth, s.leaf, s.share, np.random.default_rng((s.seed, k, t, 0)), n[use])
                found.append(tree.value[tree.find(ask)])
        each = list(np.stack(found, axis=1)) if found else []
        return pa.table({"problem": pa.array(np.full(len(ids), k), pa.int32()), "query_id": pa.array(ids), "first": pa.array(np.full(len(ids), first), pa.int32()), "found": pa.array(each, pa.list_(pa.float64()))})

    return run


def predict_forests(samples: DataFrame, queries: DataFrame, settings: dict[int, Settings], axes: list[str]) -> DataFrame:
    """(problem, query_id, value, spread): mean and population deviation of the trees' answers. ``samples``: problem, source_row, axes,
    value (all finite); ``queries``: problem, query_id, axes. Problems without samples have no rows."""
    place = [F.col("problem").cast("int").alias("problem"), *((F.col(a).cast("double") + 0.0).alias(a) for a in axes)]
    samples = checkpointed(samples.where(F.col("problem").isin(*settings)).select(*place, F.col("source_row").cast("bigint").alias("row"), F.col("value").cast("double").alias("value")))
    asked = checkpointed(queries.where(F.col("problem").isin(*settings)).select(*place, F.col("query_id").cast("bigint").alias("query_id")))
    # A place is asked about once.
    spots = checkpointed(asked.select("problem", *axes).distinct().withColumn("_spot", F.monotonically_increasing_id()))
    held = {r["problem"]: r["n"] for r in samples.select("problem", *axes).distinct().groupBy("problem").agg(F.count("*").alias("n")).collect()}
    problems = {}
    for r in samples.groupBy("problem").agg(F.count("*").alias("n"), *(f(a).alias(f"{a}{i}") for a in axes for i, f in enumerate((F.avg, F.stddev_pop)))).collect():  # a row for each problem
        problems[r["problem"]] = _Problem(r["problem"], settings[r["problem"]], r["n"], np.array([r[f"{a}0"] for a in axes]), np.array([r[f"{a}1"] or 1.0 for a in axes]))
    repeated = {k: p for k, p in problems.items() if held[k] <= MOST_PLACES and 2 * held[k] <= p.rows}
    single = {k: p for k, p in problems.items() if k not in repeated}
    told = None
    if repeated:
        kinds = f"problem int, tree int, {', '.join(f'{a} double' for a in axes)}, w array<double>, s array<double>, n array<double>, total double, rows double"
        mine = samples.where(F.col("problem").isin(*repeated)).repartition("problem", *axes, F.pmod("row", F.lit(SHARES)))
        tallied = mine.mapInArrow(_tallies(axes, repeated), kinds)
        firsts = F.element_at(F.create_map(*(F.lit(x) for k, p in repeated.items() for x in (k, p.settings.trees - 1))), F.col("problem"))
        ask = spots.where(F.col("problem").isin(*repeated)).select("problem", F.explode(F.sequence(F.lit(0), firsts, F.lit(TREES_PER_TASK))).alias("tree"), *axes, F.col("_spot").alias("query_id"))
        told = tallied.groupBy("problem", "tree").cogroup(ask.groupBy("problem", "tree")).applyInArrow(_grown(axes, repeated), "problem int, query_id bigint, first int, found array<double>")
    if single or not problems:
        rows = samples.withColumn("asks", F.lit(False)).select("problem", "row", *axes, "value", "asks")
        rows = rows.unionByName(spots.select("problem", F.col("_spot").alias("row"), *axes, F.lit(0.0).alias("value"), F.lit(True).alias("asks"))).where(F.col("problem").isin(*single))
        _upper_levels(rows, axes, single)
        names = [f"f{j}" for j in range(10 if len(axes) == 3 else 6)]
        dealt = rows.mapInArrow(_deal(axes, single, names), f"problem int, tree int, node int, row bigint, {', '.join(f'{n} double' for n in names)}, value double, asks boolean")
        part = dealt.groupBy("problem", "tree", "node").applyInArrow(_answers(single, names), "problem int, query_id bigint, first int, found array<double>")
        told = part if told is None else told.unionByName(part)
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "found"))), lambda s: s["found"]))
    out = told.groupBy("problem", "query_id").agg(every.alias("e"))  # as many numbers as trees
    n = F.size("e")
    out = out.withColumn("value", F.aggregate("e", F.lit(0.0), lambda a, b: a + b) / n)
    out = out.select("problem", F.col("query_id").alias("_spot"), "value", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, b: a + (b - F.col("value")) * (b - F.col("value"))) / n).alias("spread"))
    return asked.join(spots.join(out, ["problem", "_spot"]), ["problem", *axes]).select("problem", "query_id", "value", "spread")
