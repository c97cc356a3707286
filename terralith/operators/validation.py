"""Spatial folds without leakage, out-of-fold records, and their evidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.errors import GeoError
from terralith.operators.shared import numbered

MOST_GROUPS = 500_000  # that the driver balances one by one: as many as the rows that a stored dataset may have


def groups_2d(points: DataFrame, folds: int) -> DataFrame:
    """Cells of an nx by nx grid, nx = max(2, ceil(sqrt(3 folds)))."""
    nx = max(2, math.ceil(math.sqrt(3 * folds)))
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    at = lambda c, lo, hi: F.greatest(F.lit(0), F.least(F.lit(nx - 1), F.floor((F.col(c) - lo) / F.lit(((hi - lo) or 1.0) / nx))))
    return points.withColumn("group_key", (at("x", b[0], b[1]) * nx + at("y", b[2], b[3])).cast("long"))


def groups_3d(points: DataFrame) -> DataFrame:
    """Whole XY columns, numbered in the order of their rounded x, then y. Both axes are rounded by one tolerance, which
    follows the wider of the two. The columns are numbered on their distinct keys; the rows take the number by a join."""
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if b[0] is None:
        return points.withColumn("group_key", F.lit(None).cast("long"))
    step = F.lit(max(max(b[1] - b[0], b[3] - b[2]) * 1e-9, 1e-8))
    keyed = points.withColumn("_kx", F.floor((F.col("x") - b[0]) / step)).withColumn("_ky", F.floor((F.col("y") - b[2]) / step))
    columns = numbered(keyed.select("_kx", "_ky").distinct(), ["_kx", "_ky"], "group_key")
    return keyed.join(columns, ["_kx", "_ky"]).drop("_kx", "_ky")


def assign_folds(groups: list[tuple[int, int]], folds: int, seed: int) -> dict[int, int]:
    """Groups in a seeded order, each to the fold with the fewest rows so far (the first of equals)."""
    if len(groups) < folds:
        raise GeoError("TOO_FEW_GROUPS", groups=len(groups), folds=folds)
    groups = sorted(groups)
    load, out = [0] * folds, {}
    for i in np.random.default_rng(seed).permutation(len(groups)).tolist():
        key, n = groups[i]
        f = load.index(min(load))
        load[f] += n
        out[key] = f
    return out


def fold_table(points: DataFrame, dimension: str, folds: int = 5, seed: int = 42, holdout: float | None = None, dealt: bool = False, grouped: DataFrame | None = None) -> DataFrame:
    """(group_key, fold_index): in which fold a group validates.

    Groups go to the emptiest fold in a seeded order. That is one step after the other on the driver, which sees a row
    for each group and at most MOST_GROUPS. ``dealt`` is for more: groups are numbered in the order of a seeded hash by
    all tasks and dealt round the folds (with ``holdout`` the first share of them is held out).
    """
    if grouped is None:
        grouped = groups_3d(points) if dimension == "3d" else groups_2d(points, folds)
    sizes = grouped.groupBy("group_key").agg(F.count("*").alias("n"))
    groups = sizes.count()
    if groups < (folds if holdout is None else 2):
        raise GeoError("TOO_FEW_GROUPS", groups=groups, folds=folds)
    if dealt:
        placed = numbered(sizes.withColumn("_h", F.xxhash64(F.lit(seed), "group_key")), ["_h", "group_key"], "_i")
        if holdout is None:
            return placed.select("group_key", (F.col("_i") % folds).cast("int").alias("fold_index"))
        return placed.where(F.col("_i") < max(1, min(groups - 1, round(groups * holdout)))).select("group_key", F.lit(0).alias("fold_index"))
    if groups > MOST_GROUPS:
        raise GeoError("TOO_MANY_GROUPS", groups=groups, most=MOST_GROUPS)
    counts = sorted((r["group_key"], r["n"]) for r in sizes.collect())
    if holdout is None:
        table = assign_folds(counts, folds, seed)
    else:
        want, have, table = round(sum(n for _, n in counts) * holdout), 0, {}
        for i in np.random.default_rng(seed).permutation(len(counts)).tolist():
            if have >= want or len(table) == len(counts) - 1:
                break
            table[counts[i][0]] = 0
            have += counts[i][1]
    return points.sparkSession.createDataFrame(sorted(table.items()), "group_key bigint, fold_index int")


def fold_assignments(points: DataFrame, dimension: str, folds: int = 5, seed: int = 42, dealt: bool = False) -> DataFrame:
    """(fold_index, source_row, group_key, role, leakage_detected) for every fold and row."""
    grouped = groups_3d(points) if dimension == "3d" else groups_2d(points, folds)
    rows = grouped.select("source_row", "group_key").join(fold_table(points, dimension, folds, seed, dealt=dealt, grouped=grouped), "group_key")
    return with_roles(rows.withColumnRenamed("fold_index", "own"), folds)


def with_roles(rows: DataFrame, folds: int) -> DataFrame:
    """``rows`` (source_row, group_key, own: the fold in which the row validates) as assignments. A group leaks in a fold if
    some of its rows train there and others validate."""
    every = rows.select("source_row", "group_key", "own", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold_index"))
    out = every.withColumn("role", F.when(F.col("own") == F.col("fold_index"), "validation").otherwise("training"))
    leaks = out.groupBy("fold_index", "group_key").agg((F.min("role") != F.max("role")).alias("leakage_detected"))
    return out.join(leaks, ["fold_index", "group_key"]).select("fold_index", "source_row", "group_key", "role", "leakage_detected")


def check_assignments(assignments: DataFrame) -> None:
    """Each row validates once, and no group has both roles in a fold."""
    wrong = assignments.groupBy("source_row").agg(F.count_if(F.col("role") == "validation").alias("n")).where("n <> 1").count()
    leaks = assignments.where("leakage_detected").count()
    if wrong or leaks:
        raise GeoError("FOLD_LEAKAGE", rows=wrong, leaks=leaks)


def fold_evidence(assignments: DataFrame, most_groups: int = 200) -> DataFrame:
    v = F.col("role") == "validation"
    groups = assignments.where(v).select("fold_index", "group_key").distinct()
    from_groups = groups.groupBy("fold_index").agg(F.count("*").alias("group_count"), F.array_join(F.slice(F.array_sort(F.collect_list("group_key")), 1, most_groups), ";").alias("groups"))
    counts = assignments.groupBy("fold_index").agg(F.count_if(~v).alias("training_count"), F.count_if(v).alias("validation_count"), F.bool_or("leakage_detected").alias("leakage"))
    return counts.join(from_groups, "fold_index", "left")


def out_of_fold(points: DataFrame, assignments: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions (source_row, fold_index, predicted, is_nodata) against the plan and the truth; NoData is null."""
    plan = assignments.where("role = 'validation'").select("source_row", "fold_index")
    odd = plan.join(predictions.select("source_row", "fold_index").withColumn("there", F.lit(1)), ["source_row", "fold_index"], "full_outer")
    n = odd.where("there is null").count() + predictions.select("source_row", "fold_index").exceptAll(plan).count()
    if n:
        raise GeoError("OOF_MISMATCH", rows=n)
    rows = predictions.join(points.select("source_row", "x", "y", "z", F.col("value").alias("observed")), "source_row")
    p = F.when(~F.col("is_nodata"), F.col("predicted"))
    e = p - F.col("observed")
    return rows.select("source_row", "fold_index", "x", "y", "z", "observed", p.alias("predicted"), e.alias("residual"), F.abs(e).alias("absolute_error"), (e * e).alias("squared_error"), "is_nodata")


def fold_rmse(oof: DataFrame) -> DataFrame:
    return oof.where(~F.col("is_nodata")).groupBy("fold_index").agg(F.sqrt(F.avg("squared_error")).alias("rmse"), F.count("*").alias("valid_count"))


def ml_suitability(points: DataFrame, dimension: str) -> DataFrame:
    """(samples, groups, level): supported from 200 samples in 30 groups, experimental from 80 in 15."""
    keys = ["x", "y"] if dimension == "3d" else ["group_key"]
    rows = points if dimension == "3d" else groups_2d(points, 5)
    s = rows.agg(F.count("*").alias("samples")).join(F.broadcast(rows.select(*keys).distinct().agg(F.count("*").alias("groups"))))
    return s.withColumn("level", F.when((F.col("samples") >= 200) & (F.col("groups") >= 30), "supported").when((F.col("samples") >= 80) & (F.col("groups") >= 15), "experimental").otherwise("not_recommended"))


def expand_search(space: dict[str, list], mode: str = "grid") -> list[dict]:
    """Every combination, parameters in the order of their names; manual is exactly one, a grid at most 50."""
    out: list[dict] = [{}]
    for k in sorted(space):
        if not isinstance(space[k], list):
            raise GeoError("SEARCH_VALUES_NOT_A_LIST", parameter=k)
        out = [o | {k: v} for o in out for v in space[k]]
    if (mode == "manual" and len(out) != 1) or not 1 <= len(out) <= 50:
        raise GeoError("SEARCH_SIZE", candidates=len(out), mode=mode)
    return out
