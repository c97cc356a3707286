"""Quality gate of standardized points, contract checks and train/validation disjointness: one wide aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.quantiles import exact_quantiles
from terralith.functions.scalar import coerced, is_finite
from terralith.operators.errors import GeoError

NODATA = -9999.0
LEAST_POINTS = {"2d": 10, "3d": 20}
MAD_TIMES, MOST_COORDINATE, MOST_VALUE, MOST_INVALID = 6.0, 1e7, 1e9, 0.05
BLOCKERS = ["MISSING_NUMERIC", "NON_FINITE", "NODATA_VALUE", "CONFLICTING_COORDINATE", "INSUFFICIENT_VALID_POINTS", "DEGENERATE_EXTENT"]
WARNINGS = ["DUPLICATE_ROWS", "EXTREME_VALUES", "SPARSE_DISTRIBUTION", "SUSPICIOUS_MAGNITUDE", "HIGH_INVALID_RATIO"]


def quality_issues(points: DataFrame, dimension: str = "2d") -> DataFrame:
    """(code, severity, axis, n): one row for each rule that the points break."""
    axes = ["x", "y", "z"] if dimension == "3d" else ["x", "y"]
    ok, v = F.col("is_numeric_valid"), F.col("value")
    infinite = F.lit(False)
    for c in [*axes, "value"]:
        infinite = infinite | F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))
    over = F.lit(False)
    for c in ("x", "y"):
        over = over | (F.abs(F.col(c)) > MOST_COORDINATE)
    over = over | (F.abs(v) > MOST_VALUE)
    s = points.agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("valid"), F.count_if(infinite).alias("infinite"), F.count_if(ok & (v == NODATA)).alias("nodata"), F.count_if(ok & over).alias("large"),
        *(F.count_distinct(F.when(ok, F.col(c))).alias(f"{c}_places") for c in ("x", "y")), *(F.min(F.when(ok, F.col(c))).alias(f"{c}_min") for c in axes), *(F.max(F.when(ok, F.col(c))).alias(f"{c}_max") for c in axes),
    ).first()
    valid = points.where(ok)
    places = valid.groupBy(*axes).agg((F.min("value") != F.max("value")).alias("differ"))
    conflicts = places.agg(F.count_if("differ")).first()[0]
    repeated = points.groupBy(*axes, "value").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0] or 0
    extreme = 0
    if s["valid"] >= 4:
        middle = exact_quantiles(valid, "value", [0.5])[0]
        spread = valid.select(F.abs(v - middle).alias("d"))
        mad = exact_quantiles(spread, "d", [0.5])[0]
        if mad > 0:
            extreme = spread.where(F.col("d") > MAD_TIMES * mad).count()
    found: list[tuple] = []

    def tell(code: str, n: int, axis: str | None = None, when: bool | None = None) -> None:
        if n > 0 if when is None else when:
            found.append((code, "blocker" if code in BLOCKERS else "warning", axis, int(n)))

    tell("MISSING_NUMERIC", s["rows"], when=s["valid"] == 0)
    tell("NON_FINITE", s["infinite"])
    tell("NODATA_VALUE", s["nodata"])
    tell("CONFLICTING_COORDINATE", conflicts)
    tell("INSUFFICIENT_VALID_POINTS", s["valid"], when=0 < s["valid"] < LEAST_POINTS[dimension])
    for c in axes:
        tell("DEGENERATE_EXTENT", 1, c, when=s["valid"] > 0 and s[f"{c}_min"] == s[f"{c}_max"])
    tell("DUPLICATE_ROWS", repeated)
    tell("EXTREME_VALUES", extreme)
    tell("SPARSE_DISTRIBUTION", min(s["x_places"], s["y_places"]), when=s["valid"] > 0 and min(s["x_places"], s["y_places"]) < 3)
    tell("SUSPICIOUS_MAGNITUDE", s["large"])
    tell("HIGH_INVALID_RATIO", s["rows"] - s["valid"], when=s["rows"] > 0 and (s["rows"] - s["valid"]) / s["rows"] > MOST_INVALID)
    return points.sparkSession.createDataFrame(found, "code string, severity string, axis string, n bigint")


def quality_status(issues: DataFrame) -> str:
    kinds = {r["severity"] for r in issues.select("severity").distinct().collect()}
    return "blocked" if "blocker" in kinds else "warnings" if kinds else "passed"


def check_confirmation(issues: DataFrame, offered: list[str]) -> None:
    """The confirmed warnings must be exactly the open ones."""
    wanted = {r["code"] for r in issues.where("severity = 'warning'").select("code").distinct().collect()}
    if wanted != set(offered):
        raise GeoError("WARNINGS_NOT_CONFIRMED", missing=sorted(wanted - set(offered)), unknown=sorted(set(offered) - wanted))


def contract_checks(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """(check, passed, n) for a table with X, Y, Z and RHO: required columns, finite cells, positive values that are not
    the NoData mark, distinct places, and the number of rows."""
    need = ["X", "Y", "Z", "RHO"]
    absent = [c for c in need if c not in df.columns]
    spark = df.sparkSession
    if absent:
        return spark.createDataFrame([("required_columns", False, len(absent))], "check string, passed boolean, n bigint")
    numbers = df.select(*(coerced(F.col(c)).alias(c) for c in need))
    bad = F.lit(False)
    for c in need:
        bad = bad | ~F.coalesce(is_finite(F.col(c)), F.lit(False))
    s = numbers.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.count_if((F.col("RHO") <= 0) | (F.col("RHO") == NODATA)).alias("values")).first()
    places = numbers.select("X", "Y", "Z").distinct().count()
    rows = [("required_columns", True, 0), ("finite_cells", s["bad"] == 0, s["bad"]), ("positive_values", s["values"] == 0, s["values"]), ("distinct_places", places == s["rows"], s["rows"] - places), ("row_count", expected_rows in (None, s["rows"]), s["rows"])]
    return spark.createDataFrame(rows, "check string, passed boolean, n bigint")


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, places, nulls): one aggregate, then one row per column."""
    one = df.agg(*(f(F.col(c)).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("places", F.count_distinct), ("nulls", lambda x: F.count_if(x.isNull())))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_min").cast("double").alias("min"), F.col(f"{c}_max").cast("double").alias("max"), F.col(f"{c}_places").alias("places"), F.col(f"{c}_nulls").alias("nulls")) for c in columns))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def shared_columns(train: DataFrame, validation: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Places that stand in both parts; none if the split is clean."""
    keys = keys or ["x", "y"]
    return train.select(*keys).intersect(validation.select(*keys))


def partition_identity(parts: list[DataFrame], source: DataFrame, keys: list[str]) -> DataFrame:
    """(overlap, missing, foreign): rows in two parts, source rows in none, rows that the source lacks."""
    every = parts[0].select(*keys).withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.select(*keys).withColumn("part", F.lit(i)))
    counted = every.groupBy(*keys).agg(F.count_distinct("part").alias("parts")).withColumn("seen", F.lit(1))
    both = counted.join(source.select(*keys).distinct().withColumn("there", F.lit(1)), keys, "full_outer")
    return both.agg(F.count_if(F.col("parts") > 1).alias("overlap"), F.count_if(F.col("seen").isNull()).alias("missing"), F.count_if(F.col("there").isNull()).alias("foreign"))


def axis_check(axis: DataFrame, coord: str = "coord") -> DataFrame:
    """(nodes, increasing, even): a regular axis has two nodes at least, and all within (1e-6 + 1e-9) * max(1, span) of
    even spacing."""
    s = axis.agg(F.count("*").alias("n"), F.min(coord).alias("lo"), F.max(coord).alias("hi"), F.count_distinct(coord).alias("places")).first()
    tolerance = (1e-6 + 1e-9) * max(1.0, (s["hi"] or 0) - (s["lo"] or 0))
    step = (s["hi"] - s["lo"]) / (s["n"] - 1) if s["n"] > 1 else 0.0
    off = axis.select(F.abs(F.col(coord) - (F.lit(s["lo"]) + F.round((F.col(coord) - s["lo"]) / F.lit(step or 1.0)) * F.lit(step))).alias("d")).agg(F.max("d")).first()[0] if s["n"] else None
    row = (s["n"], s["n"] == s["places"], s["n"] >= 2 and s["n"] == s["places"] and off is not None and off <= tolerance)
    return axis.sparkSession.createDataFrame([row], "nodes bigint, increasing boolean, even boolean")
