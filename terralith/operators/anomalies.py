"""Thresholded anomalies and their connected components on a grid (4 neighbours in the plane, 6 in space).

Labels spread by grouped minima: every node sends its label to its neighbours' places, takes the least it gets, and then
follows its label's own label.  Each round is written out, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.operators.errors import GeoError
from terralith.operators.grid import INDEX, offsets, support, valid
from terralith.operators.shared import checkpointed, numbered


def anomaly_nodes(grid: DataFrame, threshold: float, direction: str = "high", gates: dict[str, float] | None = None) -> DataFrame:
    """Nodes at or beyond the threshold whose uncertainty layers are within their gates; nodes without a gated layer's
    value are out. A gate whose layer isn't there is a failure, never ignored."""
    absent = sorted(set(gates or {}) - set(grid.columns))
    if absent:
        raise GeoError("ANOMALY_UNCERTAINTY_UNAVAILABLE", layers=absent)
    v = F.col("value")
    keep: Column = v >= threshold if direction == "high" else v <= threshold
    for layer, most in (gates or {}).items():
        keep = keep & (F.col(layer) <= most)
    return valid(grid).where(keep)


def labelled(nodes: DataFrame, flat: bool = False) -> DataFrame:
    """``nodes`` with ``label``, the least node number of its component, in scan order (x slowest)."""
    key = F.struct(*INDEX)
    rows = checkpointed(nodes.withColumn("_key", key).withColumn("label", key))
    around = F.array(*(F.struct(*((F.col(n) + o).alias(n) for n, o in zip(INDEX, d, strict=True))) for d in offsets(4 if flat else 6)))
    while True:
        sent = rows.select("label", F.explode(around).alias("_to"))
        least = sent.groupBy("_to").agg(F.min("label").alias("_least"))
        near = rows.join(least, rows["_key"] == least["_to"], "left").withColumn("_new", F.least("label", F.coalesce("_least", "label"))).drop("_to", "_least")
        near = checkpointed(near)
        jump = near.select(F.col("_key").alias("_at"), F.col("_new").alias("_far"))
        moved = near.join(jump, F.col("_new") == F.col("_at"), "left").withColumn("_next", F.least("_new", F.coalesce("_far", "_new")))
        moved = checkpointed(moved.select(*[c for c in nodes.columns], "_key", F.col("_next").alias("label"), (F.col("_next") != F.col("label")).alias("_moved")))
        if not moved.where("_moved").limit(1).count():
            return moved.drop("_moved", "_key")
        rows = moved.drop("_moved")


def components(grid: DataFrame, threshold: float, direction: str = "high", min_nodes: int = 1, flat: bool = False, gates: dict[str, float] | None = None) -> DataFrame:
    """One row per component: number (in scan order after the size filter), nodes, measure, bounds, weighted centroid,
    extremes and mean, and whether it touches the grid's boundary."""
    edges = grid.agg(*(f(i).alias(f"{i}_{n}") for i in INDEX for n, f in (("lo", F.min), ("hi", F.max)))).first()
    touches = F.lit(False)
    for i in INDEX[: 2 if flat else 3]:
        touches = touches | F.col(i).isin(edges[f"{i}_lo"], edges[f"{i}_hi"])
    rows = labelled(anomaly_nodes(support(grid, 2 if flat else 3), threshold, direction, gates), flat)
    w = F.col("measure")
    stats = rows.groupBy("label").agg(
        F.count("*").alias("support_node_count"), F.sum(w).alias("support_measure"), *(f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))),
        *((F.sum(F.col(c) * w) / F.sum(w)).alias(f"{c}_centroid") for c in ("x", "y", "z")), F.min("value").alias("value_min"), F.max("value").alias("value_max"), F.avg("value").alias("value_mean"), F.bool_or(touches).alias("touches_grid_boundary"),
        *(f(layer).alias(f"{layer}_{n}") for layer in gates or {} for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))),
    ).where(F.col("support_node_count") >= min_nodes)
    return numbered(stats, ["label"], "component_id", 1).drop("label")


LOW_FIRST = 1_000_000


def ranked_components(grid: DataFrame, min_nodes: int = 1, most: int = 10, flat: bool = False, gates: dict[str, float] | None = None) -> DataFrame:
    """High components (from the third quartile) and low ones (to the first): by support, extreme value and number; the
    first ones of each direction are lettered, and the numbers of low ones begin after LOW_FIRST."""
    low, high = exact_quantiles(valid(grid), "value", [0.25, 0.75])
    out = None
    for direction, t in (("high", high), ("low", low)):
        part = components(grid, t, direction, min_nodes, flat, gates).withColumn("direction", F.lit(direction))
        extreme = F.desc("value_max") if direction == "high" else F.asc("value_min")
        best = part.orderBy(F.desc("support_measure"), extreme, "component_id").limit(most)
        best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("support_measure"), extreme, "component_id")))  # over ``most`` rows
        best = best.withColumn("component_id", F.col("component_id") + (0 if direction == "high" else LOW_FIRST))
        out = best if out is None else out.unionByName(best)
    letter = F.char(F.lit(64) + F.col("rank"))
    return out.withColumn("letter", F.when(F.col("rank") <= 26, F.when(F.col("direction") == "low", F.concat(F.lit("低-"), letter)).otherwise(letter)))
