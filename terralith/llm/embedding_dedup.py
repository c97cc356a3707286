"""Embedding near-dedup: a subspace pigeonhole join.

Cosine >= c means a squared distance of unit vectors of at most t = 2 - 2c.  The vectors are turned by a random rotation
and split into blocks of ``BLOCK`` dimensions; if a pair is within t, it is within t * (dimensions of the block) /
(all dimensions) in one block at least.  Each block is range-joined under that budget:

* pivots (k-means on a bounded sample) cut the block into cells; a vector visits its own cell, and another cell only if
  the plane between the two pivots is within the block's radius, which every partner in that cell needs. The number of
  pivots is the one that, by the sample, has a vector sent to the fewest tiles and compared with the fewest vectors: many
  where the vectors are clustered, one where a block's radius is too wide for any cell to be spared;
* two cells meet in tiles of at most ``TILE`` vectors a side, so no task holds a cell, however hot;
* within a tile, pairs within the budget are candidates, and candidates are verified exactly in double precision.

A pair that is within budget in several blocks counts in the block where it uses the smallest part of its budget (the
first of those within TIE of it, so that rounding can't change the choice), so links are counted once.  Vectors of
different lengths have no cosine: each length has a grid of its own.  Tiles return counts per vector and a spanning forest of their links, never
the links themselves.  Equal vectors are one node, with a number of its own, that carries its number of copies; ids are joined
to the nodes at the end, so an id that stands on several vectors doesn't tie them together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import saved
from terralith.llm.components import connected_components

BLOCK = 16
TILE = 8192
SAMPLE = (8192, 131_072)  # vectors for the pivots: a hundredth of all, within these bounds
SAMPLE_BYTES = 1 << 28  # which comes before the lower bound
PIVOTS = (1, 8, 64, 512, 4096)
ROWS = 2048  # vectors that are held against the pivots at a time
TIE = 1e-9
SLACK = 1e-5  # for the single-precision filter before the exact test


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(7).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(block: np.ndarray, k: int) -> np.ndarray:
    """k-means, started from rows spread evenly over the sample."""
    out = block[np.linspace(0, len(block) - 1, k).astype(int)].copy()
    for _ in range(6):
        near = np.argmin((out * out).sum(axis=1) - 2 * block @ out.T, axis=1)
        for j in range(k):
            if (near == j).any():
                out[j] = block[near == j].mean(axis=0)
    return np.unique(out, axis=0)


class _Grid:
    """Cells of every block. ``visits``: for each vector and block its cell, and all cells it has to visit."""

    def __init__(self, sample: np.ndarray, many: int, budget: float) -> None:
        self.dims = sample.shape[1]
        self.turn = rotation(self.dims)
        self.edges = list(range(0, self.dims, BLOCK)) + [self.dims]
        self.budgets = np.array([budget * (b - a) / self.dims for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)])
        self.pivots = [self._chosen(block, t, many) for block, t in zip(self.blocks(sample), self.budgets, strict=True)]

    @classmethod
    def _chosen(cls, block: np.ndarray, budget: float, many: int) -> np.ndarray:
        best = None
        for k in PIVOTS:
            if k > 1 and k * 8 > len(block):
                break
            pivots = _pivots(block, k)
            own, near = cls._near(block, pivots, budget)
            held = np.bincount(own, minlength=len(pivots)) * (many / len(block))  # vectors that a cell will hold
            cost = float((near @ (np.ceil(held / TILE) + held / TILE)).mean())
            if best is None or cost < best[0]:
                best = cost, pivots
        return best[1]

    @staticmethod
    def _near(block: np.ndarray, p: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and which cells it has to visit."""
        between = np.sqrt(np.maximum(0, (p * p).sum(axis=1)[:, None] - 2 * p @ p.T + (p * p).sum(axis=1)))
        owns, nears = [], []
        for i in range(0, len(block), ROWS):
            rows = block[i : i + ROWS]
            d2 = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ p.T + (p * p).sum(axis=1)
            own = np.argmin(d2, axis=1)
            gap = d2 - d2[np.arange(len(d2)), own][:, None]  # twice the distance to the plane, times that of the pivots
            owns.append(own)
            nears.append(gap <= 2 * math.sqrt(budget) * (1 + SLACK) * between[own] + SLACK)
        return np.concatenate(owns), np.concatenate(nears)

    def blocks(self, units: np.ndarray) -> list[np.ndarray]:
        turned = units @ self.turn
        return [turned[:, a:b] for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def visits(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k, block in enumerate(self.blocks(units)):
            yield k, *self._near(block, self.pivots[k], self.budgets[k])


def _deal(grid_of, chunks_of, dims: int):
    """For each vector the tiles that it takes part in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, chunks = grid_of.value, chunks_of.value
        for batch in batches:
            ids, copies, column = batch.columns
            units = _units(_matrix(column, dims))
            name = ids.to_numpy()
            hashed = (name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for k, own, near in grid.visits(units):
                row, cell = np.nonzero(near)
                mine = own[row]
                low, high, side = np.minimum(mine, cell), np.maximum(mine, cell), (mine > cell).astype(np.int64)
                own_chunks, other_chunks = chunks[k][mine], chunks[k][cell]
                own_chunk = (hashed[row] % own_chunks.astype(np.uint64)).astype(np.int64)
                for c in range(int(other_chunks.max(initial=0))):
                    at = c < other_chunks
                    same = mine == cell
                    swap = same & (own_chunk > c)
                    first = np.where(same, np.minimum(own_chunk, c), np.where(side == 0, own_chunk, c))
                    second = np.where(same, np.maximum(own_chunk, c), np.where(side == 0, c, own_chunk))
                    which = np.where(same, swap.astype(np.int64), side)
                    take = pa.array(row[at])
                    cols = [pa.array(np.full(int(at.sum()), k), pa.int32()), *(pa.array(x[at], pa.int32()) for x in (low, high, first, second, which))]
                    yield pa.RecordBatch.from_arrays([*cols, ids.take(take), copies.take(take), column.take(take)], names=["block", "low", "high", "first", "second", "side", "id", "copies", "embedding"])

    return deal


def _forest(u: np.ndarray, v: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept_u, kept_v = [], []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            kept_u.append(a)
            kept_v.append(b)
    return kept_u, kept_v


def _meet(grid_of, dims: int, least: float):
    """One tile: how many vectors each one links with here, and a forest of the links."""

    def meet(group: pa.Table) -> pa.Table:
        grid = grid_of.value
        group = group.combine_chunks()
        ids, copies, side = group.column("id").to_numpy(), group.column("copies").to_numpy(), group.column("side").to_numpy()
        k = group.column("block")[0].as_py()
        within = group.column("low")[0].as_py() == group.column("high")[0].as_py() and group.column("first")[0].as_py() == group.column("second")[0].as_py()
        units = _units(_matrix(group.column("embedding").combine_chunks(), dims))
        blocks = grid.blocks(units)
        part = blocks[k].astype(np.float32)
        length = (part * part).sum(axis=1)
        left = np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        count = np.zeros(len(ids), np.int64)
        us, vs = [], []
        for i in range(0, len(left), 256):
            rows = left[i : i + 256]
            d2 = length[rows][:, None] - 2 * part[rows] @ part[right].T + length[right]
            a, b = np.nonzero(d2 <= grid.budgets[k] * (1 + SLACK) + SLACK)
            a, b = rows[a], right[b]
            if within:
                a, b = a[a < b], b[a < b]
            for j in range(0, len(a), 200_000):
                x, y = a[j : j + 200_000], b[j : j + 200_000]
                good = np.einsum("ij,ij->i", units[x], units[y]) >= least
                x, y = x[good], y[good]
                used = np.stack([((p[x] - p[y]) ** 2).sum(axis=1) / t for p, t in zip(blocks, grid.budgets, strict=True)])
                mine = np.argmax(used <= used.min(axis=0) + TIE, axis=0) == k
                x, y = x[mine], y[mine]
                count += np.bincount(x, copies[y], len(ids)).astype(np.int64) + np.bincount(y, copies[x], len(ids)).astype(np.int64)
                fu, fv = _forest(x, y, len(ids))
                us += fu
                vs += fv
        if len(us) > len(ids):
            us, vs = _forest(np.array(us), np.array(vs), len(ids))
        seen = np.flatnonzero(count)
        u = np.concatenate((ids[seen], ids[us])) if us else ids[seen]
        v = pa.concat_arrays([pa.nulls(len(seen), pa.int64()), pa.array(ids[vs] if vs else ids[:0], pa.int64())])
        n = np.concatenate((count[seen], np.zeros(len(us), np.int64)))
        return pa.table({"u": pa.array(u, pa.int64()), "v": v, "n": pa.array(n, pa.int64())})

    return meet


def _met(nodes: DataFrame, dims: int, many: int, least: float, kind: str) -> DataFrame:
    """What the tiles return for the ``many`` vectors of ``dims`` numbers."""
    spark = nodes.sparkSession
    most = max(1, SAMPLE_BYTES // (8 * dims))
    sample = nodes.orderBy(F.xxhash64("embedding")).limit(min(SAMPLE[1], most, max(SAMPLE[0], many // 100))).select("embedding").toArrow().column(0).combine_chunks()
    grid = _Grid(_units(_matrix(sample, dims)), many, 2 - 2 * least)
    grid_of = spark.sparkContext.broadcast(grid)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own, _ in grid_of.value.visits(_units(_matrix(batch.column(0), dims))):
                cell, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["block", "cell", "n"])

    chunks = [np.ones(len(p), np.int64) for p in grid.pivots]
    for r in nodes.select("embedding").mapInArrow(cells, "block int, cell int, n bigint").groupBy("block", "cell").agg(F.sum("n").alias("n")).collect():  # blocks times pivots
        chunks[r["block"]][r["cell"]] = -(-r["n"] // TILE)
    chunks_of = spark.sparkContext.broadcast(chunks)
    tile = "block int, low int, high int, first int, second int, side int, id bigint, copies bigint, embedding " + kind
    dealt = nodes.select(F.col("node").alias("id"), "copies", "embedding").mapInArrow(_deal(grid_of, chunks_of, dims), tile)
    return saved(dealt.groupBy("block", "low", "high", "first", "second").applyInArrow(_meet(grid_of, dims, least), "u bigint, v bigint, n bigint"))


def embedding_links(df: DataFrame, id_col: str, vector_col: str, least: float = 0.9) -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors with a cosine of at least ``least``), ``component_id`` (the
    smallest id reachable by links) and ``kept`` (its id is the component's).

    Vectors of one length are compared with one another. Null and zero vectors and those with null or non-finite parts
    link with nothing and are their own component; so do rows with a null id, whose component is null. Rows that repeat an id and
    a vector count once as partners and are returned each; rows of one id with other vectors are vectors of their own, each
    with its links and its component. An empty table gives an empty result; other columns aren't
    read.
    """
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    nodes = saved(rows.where(sound).distinct().groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    lengths = nodes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    met = spark.createDataFrame([], "u bigint, v bigint, n bigint")
    for r in lengths:
        met = met.unionByName(_met(nodes.where(F.size("embedding") == r["d"]), r["d"], r["n"], least, kind))
    links = met.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    names = connected_components(met.where("v is not null").select("u", "v"))
    known = nodes.select("node", "least", "copies").join(links, "node", "left").join(names.withColumnRenamed("id", "node"), "node", "left")
    known = saved(known.select("node", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("group")))
    least = known.groupBy("group").agg(F.min("least").alias("component"))
    known = known.join(least, "group").select("node", "links", "component").join(nodes.select("node", F.xxhash64("embedding").alias("h"), "embedding"), "node")
    keyed = rows.withColumn("h", F.when(sound, F.xxhash64("embedding")))
    k = known.select("h", F.col("embedding").alias("same"), "links", "component")
    out = keyed.join(k, (keyed["h"] == k["h"]) & (F.col("embedding") == F.col("same")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
