"""Point sources: reading, inspecting and standardizing tables of samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.functions.scalar import coerced, is_finite
from terralith.operators.errors import GeoError

STANDARD = ["source_row", "x", "y", "z", "value", "is_numeric_valid"]
MOST_ROWS, MOST_BYTES, PREVIEW = 500_000, 50 * 2**20, 20
# Names that suggest a role.
SYNONYMS = {
    "x": ["x", "easting", "east", "lon", "longitude", "经度"],
    "y": ["y", "northing", "north", "lat", "latitude", "纬度"],
    "z": ["z", "depth", "elevation", "alt", "height", "深度", "高程"],
    "value": ["value", "rho", "val", "v", "grade", "vx", "属性", "值"],
}


@dataclass(frozen=True)
class Mapping:
    """Columns that play the roles; ``z`` only in three dimensions."""

    x: str
    y: str
    value: str
    z: str | None = None
    coordinate_kind: str = "projected"  # local_linear, projected or geographic

    @property
    def dimension(self) -> str:
        return "3d" if self.z else "2d"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark before the first name is dropped."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", mode="FAILFAST")
    return raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "parquet": lambda s, p: s.read.parquet(p), "json": lambda s, p: s.read.json(p), "orc": lambda s, p: s.read.orc(p)}
    if suffix not in readers:
        raise GeoError("DATASET_FORMAT_UNSUPPORTED", suffix=suffix)
    return readers[suffix](spark, path)


def check_byte_limit(spark: SparkSession, path: str, most: int = MOST_BYTES) -> None:
    """The limit of an uploaded source; ``path`` may be in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if size > most:
        raise GeoError("DATASET_TOO_LARGE", bytes=size, most=most)


def check_row_limit(df: DataFrame, most: int = MOST_ROWS) -> None:
    if df.limit(most + 1).count() > most:
        raise GeoError("DATASET_TOO_LARGE", most=most)


def column_types(df: DataFrame) -> DataFrame:
    """(column, kind): numeric if every value is a number and not blank, else text. One pass."""
    bad = [F.count_if(coerced(F.col(f"`{c}`")).isNull()).alias(c) for c in df.columns]
    one = df.agg(*bad)
    names = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`") == 0, "numeric").otherwise("text").alias("kind")) for c in df.columns))
    return one.select(F.explode(names).alias("s")).select("s.*")


def role_candidates(columns: list[str]) -> dict[str, str]:
    lower = {c.strip().lower(): c for c in columns}
    return {role: next(lower[n] for n in names if n in lower) for role, names in SYNONYMS.items() if any(n in lower for n in names)}


def inspect(df: DataFrame) -> dict:
    return {"columns": [tuple(r) for r in column_types(df).collect()], "rows": df.count(), "preview": [r.asDict() for r in df.limit(PREVIEW).collect()], "mapping": role_candidates(df.columns)}


def standardize(df: DataFrame, mapping: Mapping, order_by: str | None = None) -> DataFrame:
    """The six standard columns. ``order_by``: a unique column that numbers the rows; without it the file order does.

    Rows are numbered without bringing them into one task: places within the tasks are added to the tasks' row counts.
    """
    if mapping.coordinate_kind == "geographic":
        raise GeoError("GEOGRAPHIC_COORDINATES_UNSUPPORTED")
    roles = {"x": mapping.x, "y": mapping.y, "z": mapping.z, "value": mapping.value}
    numbers = [coerced(F.col(f"`{c}`")).alias(k) if c else F.lit(None).cast("double").alias(k) for k, c in roles.items()]
    needed = [k for k, c in roles.items() if c]
    if order_by is None:
        placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
        counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
        before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task
        numbered = placed.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("source_row"), *numbers)
    else:
        numbered = df.select(F.col(order_by).cast("long").alias("source_row"), *numbers)
    valid = is_finite(F.col(needed[0]))
    for k in needed[1:]:
        valid = valid & is_finite(F.col(k))
    return numbered.select("source_row", "x", "y", "z", "value", F.coalesce(valid, F.lit(False)).alias("is_numeric_valid"))


def points_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select((F.col("p_partkey") + 1).alias("source_row"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), F.lit(None).cast("double").alias("z"), F.col("p_retailprice").alias("value"), F.lit(True).alias("is_numeric_valid"))


def points_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_orderkey") + 1).alias("source_row"), (F.col("o_custkey") % 40).cast("double").alias("x"), F.month("o_orderdate").cast("double").alias("y"), F.dayofmonth("o_orderdate").cast("double").alias("z"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 41 != 0).alias("is_numeric_valid"))


def points_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("event_id") + 1).alias("source_row"), F.col("user_id").cast("double").alias("x"), F.hour("ts").cast("double").alias("y"), F.dayofmonth("ts").cast("double").alias("z"), F.when(F.col("event_id") % 37 != 0, F.col("value")).alias("value"), (F.col("event_id") % 37 != 0).alias("is_numeric_valid"))


# The same views in SQL, for the independent texts.
SQL_2D = "pts AS (SELECT p_partkey + 1 AS source_row, p_size::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y, NULL::DOUBLE AS z, p_retailprice AS value, true AS ok FROM part)"
SQL_3D = "pts AS (SELECT o_orderkey + 1 AS source_row, (o_custkey % 40)::DOUBLE AS x, month(o_orderdate)::DOUBLE AS y, day(o_orderdate)::DOUBLE AS z, o_totalprice AS value, o_orderkey % 41 <> 0 AS ok FROM orders)"
SQL_EVENTS = "pts AS (SELECT event_id + 1 AS source_row, user_id::DOUBLE AS x, hour(ts)::DOUBLE AS y, day(ts)::DOUBLE AS z, CASE WHEN event_id % 37 <> 0 THEN value END AS value, event_id % 37 <> 0 AS ok FROM events)"
