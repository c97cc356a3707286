"""Relational operators over stored runs: latest rows, versions, case cards, comparable candidates and baselines.

The tables are ordinary DataFrames (cases, datasets, experiments, runs, candidates); nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.errors import GeoError

CONTRACT = ["method", "folds", "seed", "holdout_fraction"]
SCORES = ["rmse", "mae", "r2", "bias"]
KRIGING = "ordinary_kriging"


def latest(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """The last (or first) row of each key by ``order``: a grouped extreme of whole rows, so no group is sorted."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg((F.min(row) if first else F.max(row)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def next_version(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """(key, next): versions are dense, so the next one is the highest and one."""
    return versions.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next"))


def newest(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    return df.orderBy(*order).limit(most)


def case_cards(*sources: DataFrame) -> DataFrame:
    """Cards of every kind in one table; columns that a kind lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def candidates_of_runs(experiments: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate with its run and experiment; ``selectable`` if both ended well."""
    chain = candidates.join(runs.withColumnRenamed("status", "run_status"), "run_id").join(experiments, "experiment_id")
    return chain.withColumn("selectable", (F.col("status") == "succeeded") & (F.col("run_status") == "succeeded"))


def case_counts(cases: DataFrame, datasets: DataFrame, experiments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case_id, datasets, experiments, results, can_restore, can_purge): each child table is counted for itself before it
    meets the cases. A trashed case can be restored; one without results can be purged."""
    out = cases
    for name, child in (("datasets", datasets), ("experiments", experiments), ("results", candidates)):
        out = out.join(child.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    n = [F.coalesce(c, F.lit(0)).alias(c) for c in ("datasets", "experiments", "results")]
    return out.select("case_id", *n, F.col("trashed").alias("can_restore"), (F.col("trashed") & F.col("results").isNull()).alias("can_purge"))


def comparable_catalog(chain: DataFrame) -> DataFrame:
    """(dataset, experiment_id, candidates): the selectable candidates with finite scores by experiment, newest first.
    An experiment's candidates are a configured list of at most fifty a run."""
    finite = F.lit(True)
    for c in ("rmse", "mae", "bias"):
        finite = finite & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    rows = chain.where(F.col("selectable") & finite)
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("age"), "candidate_id")))
    return rows.groupBy("dataset", "experiment_id").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda s: s["candidate_id"].cast("string")), ";").alias("candidates"))


def mismatches(selected: DataFrame) -> DataFrame:
    """(code), sorted: why the selected candidates can't be ranked together; empty if they can. Two to four candidates of
    one dataset."""
    s = selected.agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("ids"), F.count_distinct("dataset").alias("datasets"), *(F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in (*CONTRACT, "fold_fingerprint", "population_fingerprint", "common_valid_count"))).first()
    if not 2 <= s["n"] <= 4 or s["ids"] != s["n"]:
        raise GeoError("COMPARISON_SELECTION_INVALID", candidates=s["n"], distinct=s["ids"])
    if s["datasets"] > 1:
        raise GeoError("COMPARISON_DATASET_MISMATCH", datasets=s["datasets"])
    shared = [f"validation_{c}_mismatch" for c in CONTRACT if s[c] > 1] + [f"{c}_mismatch" for c in ("fold_fingerprint", "common_valid_count") if s[c] > 1] + ["metric_population_fingerprint_mismatch"] * (s["population_fingerprint"] > 1)
    name = F.col("candidate_id").cast("string")
    own = [F.when(~F.col("selectable"), F.concat(F.lit("candidate_not_succeeded:"), name))]
    for c in SCORES:
        v = F.col(c)
        own.append(F.when(v.isNull(), F.lit(None) if c == "r2" else F.concat(F.lit(f"missing_{c}:"), name)).when(F.isnan(v), F.concat(F.lit(f"nan_{c}:"), name)).when(F.abs(v) == float("inf"), F.concat(F.lit(f"inf_{c}:"), name)))
    codes = selected.select(F.explode(F.array_compact(F.array(*own))).alias("code"))
    if shared:
        codes = codes.unionByName(selected.sparkSession.createDataFrame([(c,) for c in shared], "code string"))
    return codes.distinct().orderBy("code")


def ranked(selected: DataFrame) -> DataFrame:
    """(rank, candidate_id): rmse up, mae up, r2 down, the parameters' text, the id. A selection is a few rows."""
    order = [F.col("rmse").asc_nulls_last(), F.col("mae").asc_nulls_last(), F.col("r2").desc_nulls_last(), F.col("parameters"), F.col("candidate_id").cast("string")]
    return selected.select("candidate_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def baseline_of(results: DataFrame) -> DataFrame:
    """For every result the best comparable kriging baseline: (candidate_id, baseline_id, rmse_change, rmse_percent,
    mae_change, mae_percent, improved, reason).

    Comparable: another succeeded kriging result of the same dataset, validation contract, folds and number of common
    rows, with finite errors; the lowest rmse, then the lowest id. The two best of each contract are enough, since only
    the result itself is left out; so the join is small whatever the number of results.
    """
    keys = ["dataset", *CONTRACT, "fold_fingerprint", "common_valid_count"]
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    there = F.col("fold_fingerprint").isNotNull() & (F.col("common_valid_count") >= 0)
    usable = results.where((F.col("algorithm") == KRIGING) & (F.col("status") == "succeeded") & finite("rmse") & finite("mae") & there)
    row = F.struct("rmse", F.col("candidate_id").alias("id"), "mae")
    best = usable.groupBy(*keys).agg(F.min(row).alias("first"))
    side = lambda df, p: df.withColumnsRenamed({k: f"{p}_{k}" for k in keys})
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}_{k}")) for k in keys]
    second = usable.join(side(best, "b"), same("b")).where(F.col("candidate_id") != F.col("first.id")).groupBy(*keys).agg(F.min(row).alias("second"))
    met = results.join(side(best, "b"), same("b"), "left").join(side(second, "s"), same("s"), "left")
    base = F.when(F.col("first.id") != F.col("candidate_id"), F.col("first")).otherwise(F.col("second"))
    met = met.select("candidate_id", "rmse", "mae", base.alias("base"))
    known = F.col("base").isNotNull() & finite("rmse") & finite("mae")
    change = lambda c: F.when(known, F.col(c) - F.col(f"base.{c}"))
    share = lambda c: F.when(known & (F.col(f"base.{c}") != 0), (F.col(c) - F.col(f"base.{c}")) / F.col(f"base.{c}") * 100)
    return met.select(
        "candidate_id", F.when(known, F.col("base.id")).alias("baseline_id"), change("rmse").alias("rmse_change"), share("rmse").alias("rmse_percent"), change("mae").alias("mae_change"), share("mae").alias("mae_percent"),
        F.when(known, F.col("rmse") < F.col("base.rmse")).alias("improved"), F.when(~known, "ML_KRIGING_BASELINE_NOT_COMPARABLE").alias("reason"),
    )


def preparation_state(cases: DataFrame, versions: DataFrame) -> DataFrame:
    """(case_id, state) from the latest version that wasn't abandoned: needs_upload, mapping, quality_review, ready, or
    blocked (also where the stored file's hash differs). ``versions``: case_id, version, abandoned, mapped, confirmed,
    blocked, file_hash, found_hash."""
    last = latest(versions.where(~F.col("abandoned")), ["case_id"], ["version"])
    state = (
        F.when(F.col("version").isNull(), "needs_upload").when(F.col("blocked") | ~F.col("file_hash").eqNullSafe(F.col("found_hash")), "blocked").when(~F.col("mapped"), "mapping")
        .when(~F.col("confirmed"), "quality_review").otherwise("ready")
    )
    return cases.select("case_id").join(last, "case_id", "left").select("case_id", state.alias("state"))
