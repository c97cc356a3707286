"""Stored tables: verified writes, grids read back, predictions and truths from text, preset sources."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.functions.scalar import coerced, column_id, is_finite
from terralith.operators.errors import GeoError
from terralith.operators.experiments import rows_fingerprint
from terralith.operators.grid import INDEX, grid_statistics
from terralith.operators.shared import checkpointed

NODATA = -9999.0
WKT = r"^\s*POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$"
# Depth bands, each from its lower edge up to below its upper one, the last with both.
DEPTH_BANDS = [("深部 [-840,-630) m", -840.0, -630.0), ("中深部 [-630,-420) m", -630.0, -420.0), ("中浅部 [-420,-210) m", -420.0, -210.0), ("浅部 [-210,0] m", -210.0, 0.0)]


def _paths(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_verified(df: DataFrame, path: str, order: list[str]) -> dict:
    """Writes Parquet beside ``path``, reads it back, and only then puts it in the place of what stood there. Returns rows and
    the fingerprint of all rows in ``order``."""
    spark = df.sparkSession
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    back = spark.read.parquet(staged)
    told = {"rows": back.count(), "sha256": rows_fingerprint(back, order)}
    if told != {"rows": df.count(), "sha256": rows_fingerprint(df, order)}:
        raise GeoError("WRITE_NOT_VERIFIED", path=path)
    fs, at = _paths(spark, path)
    fs.delete(at, True)
    if not fs.rename(_paths(spark, staged)[1], at):
        raise GeoError("WRITE_NOT_PUBLISHED", path=path)
    return told


def write_grid(grid: DataFrame, path: str, **more) -> dict:
    """A grid and its metadata (counts, extremes, fingerprint, and what is given) below ``path``."""
    spark = grid.sparkSession
    s = grid_statistics(grid).first().asDict()
    meta = write_verified(grid, f"{path}/nodes", INDEX) | {k: v for k, v in s.items()} | more
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def load_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    fs, at = _paths(spark, f"{path}/nodes")
    if not fs.exists(at):
        raise GeoError("GRID_NOT_MATERIALIZED", path=path)
    return spark.read.parquet(f"{path}/nodes"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def with_row_number(df: DataFrame) -> DataFrame:
    """``df`` with ``row``, its rows' numbers in the order of their files, without a one-task sort."""
    placed = checkpointed(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task
    return placed.join(F.broadcast(before), "_part").withColumn("row", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def depth_band(z: Column) -> Column:
    last = len(DEPTH_BANDS) - 1
    return F.coalesce(*(F.when((z >= a) & ((z <= b) if i == last else (z < b)), name) for i, (name, a, b) in enumerate(DEPTH_BANDS)))


def read_truth(raw: DataFrame) -> DataFrame:
    """(row, x, y, z, observed, column_id, depth_band) of a table with X, Y, Z and RHO."""
    n = with_row_number(raw.select(*(coerced(F.col(c)).alias(a) for c, a in (("X", "x"), ("Y", "y"), ("Z", "z"), ("RHO", "observed")))))
    return n.select("row", "x", "y", "z", "observed", column_id(F.col("x"), F.col("y")).alias("column_id"), depth_band(F.col("z")).alias("depth_band"))


def import_predictions(raw: DataFrame, truth: DataFrame, candidate: str, nodata: float = NODATA, tolerance: float = 1e-8) -> tuple[DataFrame, dict]:
    """Predictions (SmUserID, Attribute, Geometry as a WKT point) against the truth, row by row, and how many places differ
    by more than ``tolerance``. The numbers of rows have to agree."""
    need = [c for c in ("SmUserID", "Attribute", "Geometry") if c not in raw.columns]
    if need:
        raise GeoError("PREDICTION_COLUMNS_MISSING", columns=need)
    at = lambda k: F.regexp_extract("Geometry", WKT, k).try_cast("double")
    rows = with_row_number(raw.select(coerced(F.col("Attribute")).alias("a"), at(1).alias("px"), at(2).alias("py")))
    n, m = rows.count(), truth.count()
    if n != m:
        raise GeoError("PREDICTION_ROWS_DIFFER", predictions=n, truth=m)
    p = F.when(F.coalesce(is_finite(F.col("a")), F.lit(False)) & (F.col("a") != nodata), F.col("a"))
    met = truth.join(rows, "row").withColumn("predicted", p).withColumn("_off", (F.abs(F.col("px") - F.col("x")) > tolerance) | (F.abs(F.col("py") - F.col("y")) > tolerance))
    s = met.agg(F.count("*").alias("row_count"), F.count_if(F.coalesce("_off", F.lit(False))).alias("xy_mismatch_count"), F.count_if(F.col("predicted").isNull()).alias("nodata_count"), F.count("predicted").alias("valid_count")).first().asDict()
    e = F.col("predicted") - F.col("observed")
    out = met.select(F.lit(candidate).alias("candidate"), (F.col("row") + 1).alias("source_row"), "x", "y", "z", "column_id", "depth_band", "observed", "predicted", F.col("predicted").isNull().alias("is_nodata"), e.alias("error"), F.abs(e).alias("abs_error"), F.when(F.col("observed") != 0, e / F.col("observed")).alias("relative_error"))
    return out, s


def check_preset(raw: DataFrame, columns: list[str], rows: int, places: int = 3) -> DataFrame:
    """A preset's table as numbers; rejected unless header, number of rows, finite cells and distinct places are as
    registered."""
    if raw.columns != columns:
        raise GeoError("PRESET_SOURCE_INVALID", reason="header", expected=columns)
    numbers = raw.select(*(coerced(F.col(f"`{c}`")).alias(c) for c in columns))
    odd = F.lit(False)
    for c in columns:
        odd = odd | ~F.coalesce(is_finite(F.col(f"`{c}`")), F.lit(False))
    s = numbers.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
    for reason, broken in (("row_count", s["n"] != rows), ("not_finite", s["odd"] > 0)):
        if broken:
            raise GeoError("PRESET_SOURCE_INVALID", reason=reason, rows=s["n"], odd=s["odd"])
    if numbers.groupBy(*columns[:places]).count().where("count > 1").limit(1).count():
        raise GeoError("PRESET_SOURCE_INVALID", reason="duplicate_places")
    return numbers


def verify_baseline(points: DataFrame, baseline: dict, fingerprint: str, allowed: list[dict], most_cells: int = 1_000_000) -> DataFrame:
    """(check, passed) of a frozen baseline against its source: hash, rows, rule, folds, winner, scores, grid and bounds."""
    b = baseline
    s = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in ("x", "y", "z") for k, f in ((0, F.min), (1, F.max)))).first()
    columns = points.select("x", "y").distinct().count()
    cells = math.prod(b["grid"]["nodes"])
    finite = all(isinstance(v, (int, float)) and math.isfinite(v) for v in b["metrics"].values())
    inside = all(lo <= s[f"{c}0"] and s[f"{c}1"] <= hi for c, (lo, hi) in zip(("x", "y", "z"), b["grid"]["bounds"], strict=False))
    rows = [("source_sha256", b["sha256"] == fingerprint), ("rows", b["rows"] == s["n"]), ("rule", b["rule"] == ["rmse_asc", "mae_asc", "r2_desc", "canonical_params_asc"]), ("folds", 2 <= b["validation"]["folds"] <= columns), ("winner", b["winner"] in allowed), ("metrics", finite), ("common_rows", 0 < b["common_valid"] <= s["n"]), ("cells", 0 < cells <= most_cells), ("bounds", inside)]
    return points.sparkSession.createDataFrame([(k, bool(v)) for k, v in rows], "check string, passed boolean")
