"""Steps that several operators need: written intermediate results, row numbers without a one-task sort, group quantiles."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _folder(spark) -> str:
    """The folder in spark.checkpoint.dir. Only where all runs on one machine may it be unset: then a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that spark.checkpoint.dir names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the same folder: for the states of long courses, which ``forgotten`` deletes one by one."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes tables that were ``written`` and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with ``name``: its rows' numbers in the order of ``order``.

    Rows are dealt by ranges of the order and sorted within the tasks; a row's number is its place there and the rows of
    the tasks before. The dealt rows are written first, since a second dealing may cut elsewhere.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task
    out = placed.join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + first).drop("_part", "_at", "_before")


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``probs``): exact quantiles of each group with linear interpolation between ranks.
    No task holds a group: all rows are numbered by group and value, and only the wanted ranks are looked up."""
    rows = numbered(df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null"), [*keys, "_v"], "_row")
    spans = rows.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    at = lambda p: F.lit(float(p)) * (F.col("_size") - 1)
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.col("_first") + step(at(p))).cast("long").alias("_row"), (at(p) - F.floor(at(p))).alias("share")) for name, p in probs.items() for side, step in (("low", F.floor), ("high", F.ceil))))
    wanted = spans.select(*keys, F.explode(asked).alias("w")).select(*keys, "w.*")
    met = wanted.join(rows.select("_row", "_v"), "_row")
    ends = met.groupBy(*keys, "name").agg(F.max(F.when(F.col("side") == "low", F.col("_v"))).alias("a"), F.max(F.when(F.col("side") == "high", F.col("_v"))).alias("b"), F.first("share").alias("share"))
    found = ends.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in probs))


def largest_remainders(sizes: dict[int, int], seats: int) -> dict[int, int]:
    """Seats in proportion to sizes by largest remainders, ties to the lower key; never more than the size."""
    total = sum(sizes.values())
    if total <= seats:
        return dict(sizes)
    exact = {k: seats * n / total for k, n in sizes.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(sizes, key=lambda k: (-(exact[k] - out[k]), k))[: seats - sum(out.values())]:
        out[k] += 1
    return out
