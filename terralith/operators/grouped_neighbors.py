"""Nearest neighbours of many sample sets in one search.

``by`` names a set: queries meet samples of their own set only, and every set has cells of its own width.  ``apart`` names a
share of a set that a query mustn't see (in cross-validation the fold that it is held out with), so that sets needn't be
copied for every fold.  Otherwise the search is that of ``neighbors.nearest``: rounds of equi-joins on cells with growing
rings, beginning with finer cells where samples are crowded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.scalar import distance
from terralith.operators.neighbors import CROWDED, FINER, LEVELS
from terralith.operators.shared import checkpointed

NOBODY = -1  # the share of samples and queries that belong to none


def _of(values: dict, by: str) -> Column:
    """The number that a set has in ``values`` (as many as there are sets)."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v)))), F.col(by))


def _cells(axes: list[str], width: Column) -> dict[str, Column]:
    return {f"_c{a}": F.floor(F.col(a) / width).cast("long") for a in axes}


def nearest_by(queries: DataFrame, samples: DataFrame, k: int, by: str, axes: list[str], apart: str | None = None) -> DataFrame:
    """(query_id, by, source_row, value, d, k): each query's nearest samples of its set, ties by source_row. ``queries``: query_id,
    ``by``, axes and ``apart``; ``samples``: source_row, ``by``, axes, value and ``apart``. A null share sees everything."""
    share = F.coalesce(F.col(apart).cast("int"), F.lit(NOBODY)).alias("_apart") if apart else F.lit(NOBODY).alias("_apart")
    place = Window.partitionBy(by, *axes, "_apart").orderBy("source_row")
    held = checkpointed(samples.select("source_row", by, *axes, "value", share).withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= k).drop("_k"))
    found = held.groupBy(by).agg(F.count("*").alias("n"), *(f(a).alias(f"{a}{i}") for a in axes for i, f in enumerate((F.min, F.max)))).collect()  # a row for each set
    schema = queries.select("query_id", by).schema
    if not found:
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        return queries.sparkSession.createDataFrame([], f"{kind}, source_row bigint, value double, d double, k int")
    widths, low, high = {}, {a: {} for a in axes}, {a: {} for a in axes}
    for r in found:
        spans = [max(r[f"{a}1"] - r[f"{a}0"], 0.0) for a in axes]
        volume = math.prod(s for s in spans if s > 0) or 1.0
        widths[r[by]] = max((volume * k / r["n"]) ** (1 / max(1, sum(s > 0 for s in spans))), max(spans) / 1e6, 1e-9)
        for a in axes:
            low[a][r[by]], high[a][r[by]] = r[f"{a}0"], r[f"{a}1"]
    width = _of(widths, by)
    mine = queries.select("query_id", by, *axes, share).where(F.col(by).isin(*widths))
    # How many samples a query can find: those of its set but for its own share.
    shares = held.groupBy(by, F.col("_apart").alias("_apart")).agg(F.count("*").alias("_own")).where(F.col("_apart") != NOBODY)
    mine = mine.join(F.broadcast(shares), [by, "_apart"], "left")  # a row for each share of each set
    total = _of({r[by]: r["n"] for r in found}, by)
    mine = mine.withColumn("_want", F.least(F.lit(float(k)), total - F.coalesce("_own", F.lit(0)))).drop("_own")
    best = Window.partitionBy(by, "query_id").orderBy("d", "source_row")

    def meet(open_: DataFrame, scale: float, ring: int) -> DataFrame:
        w = width / scale
        q = open_.select("query_id", by, F.col("_apart").alias("_q"), *(F.col(a).alias(f"q_{a}") for a in axes), *(F.sequence(c - ring, c + ring).alias(name) for name, c in _cells(axes, w).items()))
        for name in _cells(axes, w):
            q = q.withColumn(name, F.explode(name))
        celled = held.withColumns(_cells(axes, w))
        near = q.join(celled, [by, *_cells(axes, w)]).where((F.col("_q") != F.col("_apart")) | (F.col("_q") == NOBODY))
        near = near.withColumn("d", distance([F.col(f"q_{a}") for a in axes], [F.col(a) for a in axes]))
        return near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select("query_id", by, "source_row", "value", "d", "k")

    reach = F.ceil(F.greatest(*(F.greatest(F.abs(F.col(a) - _of(low[a], by)), F.abs(F.col(a) - _of(high[a], by))) for a in axes), F.lit(0.0)) / width) + 1
    most = int(mine.agg(F.max(reach)).first()[0] or 1)
    rings = [1]
    while rings[-1] < most:
        rings.append(min(rings[-1] * 2, most))
    levels: list[DataFrame] = []
    while len(levels) < LEVELS:
        names = list(_cells(axes, width))
        crowded = held.withColumns(_cells(axes, width / FINER ** len(levels))).groupBy(by, *names).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED * k).drop("_n")
        if not crowded.limit(1).count():
            break
        levels.append(crowded)
    open_ = mine.withColumn("_from", F.lit(0))
    for i, crowded in enumerate(levels, 1):
        hot = open_.where(F.col("_from") == i - 1).withColumns(_cells(axes, width / FINER ** (i - 1))).join(crowded, [by, *_cells(axes, width)], "left_semi").select(by, "query_id", F.lit(i).alias("_hot"))
        open_ = open_.join(hot, [by, "query_id"], "left").withColumn("_from", F.coalesce("_hot", "_from")).drop("_hot")
    rounds = [(FINER**i, 1) for i in range(len(levels), 0, -1)] + [(1.0, r) for r in rings]
    out, open_ = None, checkpointed(open_)
    for i, (scale, ring) in enumerate(rounds):
        now = open_.where(F.col("_from") >= max(0, len(levels) - i))
        top = checkpointed(meet(now, scale, ring))
        if i == len(rounds) - 1:
            return top if out is None else out.unionByName(top)
        reached = top.groupBy(by, "query_id").agg(F.count("*").alias("_n"), F.max("d").alias("_far"))
        done = reached.join(now.select(by, "query_id", "_want"), [by, "query_id"]).where((F.col("_n") == F.col("_want")) & (F.col("_far") <= ring * width / scale)).select(by, "query_id")
        part = top.join(done, [by, "query_id"], "left_semi")
        out = part if out is None else out.unionByName(part)
        open_ = checkpointed(open_.join(done, [by, "query_id"], "left_anti"))
        if not open_.limit(1).count():
            return out
