"""Small helpers shared by the operators: table access, tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with so many underscores before them that no column of ``df`` has one of them."""
    taken = {c.lower() for c in df.columns}
    before = "_"
    while any((before + n).lower() in taken for n in names):
        before += "_"
    return [before + n for n in names]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_there: list[DataFrame] = []  # saved tables of this driver that haven't been deleted


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where all runs on one machine may it be unset: then a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage: what follows reads files that survive the loss of executors, and knows their size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # shuffle files go with the write; nothing reads them after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    _there.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``saved`` tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _there[:] = [x for x in _there if x is not t]


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are saved inside are deleted at the end, also after an error, but for those that are handed to what it
    yields: the ones that the result is read from."""
    before, kept = list(_there), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        dropped(*(t for t in list(_there) if not any(t is x for x in [*before, *kept])))
