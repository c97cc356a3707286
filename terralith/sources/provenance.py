"""The provenance table beside a dataset: where each modelled row comes from, one row for each, and joins that hold to it."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators.errors import GeoError

# The columns that a declared provenance table has.
COLUMNS = ["source_row", "point_id", "line_id", "x_local_m", "y_local_m", "z_local_m", "vx_km_s", "source_sample_ids", "sample_count", "vx_min_km_s", "vx_max_km_s", "vx_sample_std_km_s"]
SHOWN = 20  # keys that a failure names


def key_counts(provenance: DataFrame, rows: DataFrame, key: str = "source_row") -> DataFrame:
    """One row: provenance rows with a ``null_keys``, ``repeated_keys`` (keys that stand there more than once), ``matched`` keys, ``unmatched`` (keys of
    ``rows`` without provenance), ``unused`` (the other way round) and ``repeated_rows`` (keys more than once in ``rows``).

    Both sides are counted by key in one grouping; nothing is joined, so a key that fills a side is one row of each task.
    """
    side = lambda df, here: df.select(F.col(key).alias("k"), F.lit(int(here)).cast("bigint").alias("p"), F.lit(int(not here)).cast("bigint").alias("r"))
    each = side(provenance, True).unionByName(side(rows, False)).groupBy("k").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    known, both = F.col("k").isNotNull(), (F.col("p") > 0) & (F.col("r") > 0)
    count = lambda test: F.count_if(known & test)
    return each.agg(
        F.coalesce(F.sum(F.when(~known, F.col("p"))), F.lit(0)).alias("null_keys"), count(F.col("p") > 1).alias("repeated_keys"), count(both).alias("matched"),
        count(F.col("p") == 0).alias("unmatched"), count(F.col("r") == 0).alias("unused"), count(F.col("r") > 1).alias("repeated_rows"),
    )


def load(spark: SparkSession, path: str, declared: bool = True) -> DataFrame | None:
    """The declared provenance table, or nothing where none is declared. Failures: PROVENANCE_ARTIFACT_MISSING,
    PROVENANCE_ARTIFACT_INVALID (it can't be read), PROVENANCE_SCHEMA_MISMATCH, PROVENANCE_DUPLICATE_SOURCE_ROW (null or repeated)."""
    if not declared:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise GeoError("PROVENANCE_ARTIFACT_MISSING", path=path)
    try:
        table = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        raise GeoError("PROVENANCE_ARTIFACT_INVALID", path=path, error=str(e)[:200]) from e
    absent = [c for c in COLUMNS if c not in table.columns]
    if absent:
        raise GeoError("PROVENANCE_SCHEMA_MISMATCH", missing=absent)
    n = key_counts(table, table.limit(0)).first()
    if n["null_keys"] or n["repeated_keys"]:
        raise GeoError("PROVENANCE_DUPLICATE_SOURCE_ROW", null=n["null_keys"], repeated=n["repeated_keys"])
    return table


def ensure_coverage(provenance: DataFrame, rows: DataFrame) -> None:
    """Every row has its provenance; else PROVENANCE_SOURCE_ROW_UNMATCHED with the number and the first SHOWN keys."""
    n = key_counts(provenance, rows).first()["unmatched"]
    if n:
        lost = rows.select("source_row").distinct().join(provenance.select("source_row"), "source_row", "left_anti").orderBy("source_row").limit(SHOWN).collect()
        raise GeoError("PROVENANCE_SOURCE_ROW_UNMATCHED", rows=n, first=[r["source_row"] for r in lost])


def attributed(rows: DataFrame, provenance: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their provenance; each side has a key once (PROVENANCE_NOT_ONE_TO_ONE), rows without
    provenance have nulls."""
    n = key_counts(provenance, rows).first()
    if n["repeated_keys"] or n["repeated_rows"] or n["null_keys"]:
        raise GeoError("PROVENANCE_NOT_ONE_TO_ONE", repeated=n["repeated_keys"], rows=n["repeated_rows"], null=n["null_keys"])
    return rows.join(provenance.select("source_row", *columns), "source_row", "left")
