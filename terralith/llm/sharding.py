"""Sharding by histogram sort: splitters found by counting exact bytes below candidate keys, then one exchange.

Rows are sorted by a 128-bit key: a hash of the text, then a hash of the id, as hex digits.  Rows of equal text
therefore lie side by side, and a group stays in one shard unless the tolerance needs a cut inside it, which the
second half of the key allows.  Each round counts rows and bytes in cells that share a prefix of the key: first all
cells of three digits, then only the cells in which a splitter falls, three digits deeper.  A round brings at most
4096 sums per splitter to the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import saved

DIGITS = 3
KEY_DIGITS = 48  # 16 each of the text's hash, the id's and the row number, which tells repeated rows apart


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[str]:
    """Keys (prefixes, ascending) at which shards 1, 2, ... begin. ``keyed`` has key and size.

    A splitter is settled once the bytes below it are within ``tolerance`` of a shard's mean from its target, or no
    row lies between the two nearest candidates.
    """
    whole = keyed.groupBy(F.substring("key", 1, DIGITS).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total = sum(r["size"] for r in whole)
    slack = tolerance * total / shards
    open_at = {k: (0, whole) for k in range(1, shards)}
    settled: dict[int, str] = {}
    digits = DIGITS
    while open_at:
        deeper: dict[int, tuple[int, str]] = {}
        for k, (below, cells) in open_at.items():
            target = total * k / shards
            for r in sorted(cells, key=lambda r: r["cell"]):
                if below + r["size"] < target:
                    below += r["size"]
                    continue
                before, after = target - below, below + r["size"] - target
                if min(before, after) <= slack or r["n"] == 1 or digits >= KEY_DIGITS:
                    settled[k] = r["cell"] if before <= after else r["cell"] + "g"  # g sorts behind every digit
                else:
                    deeper[k] = (below, r["cell"])
                break
            else:
                settled[k] = "g"
        if not deeper:
            break
        digits += DIGITS
        wanted = sorted({c for _, c in deeper.values()})
        parts = keyed.where(F.substring("key", 1, digits - DIGITS).isin(wanted)).groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        open_at = {k: (below, [p for p in parts if p["cell"].startswith(c)]) for k, (below, c) in deeper.items()}
    return [settled[k] for k in range(1, shards)]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's task and its place among the task's rows of the same shard."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        place = np.zeros(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            place[at] = seen.get(s, 0) + np.arange(len(at))
            seen[s] = seen.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "part", "place"])


def shard_rows(df: DataFrame, id_col: str, text_col: str, shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """One row per row of ``df``: id, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``law`` (bytes),
    ``shard``, ``slot`` (place in the shard, in key order, without gaps) and ``grown_shard`` (null under this law).

    Null texts are empty, null ids are allowed, repeated rows are placed each; an empty table gives an empty result.
    Other columns aren't read.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    slim = df.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), half(data).alias("t"), half(F.col(id_col)).alias("i"))
    row = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    keyed = saved(slim.select("id", "size", "text_crc32", F.concat("t", "i", row).alias("key")))
    rows = keyed.count()
    edges = splitters(keyed, shards, tolerance) if rows else []
    shard = sum((F.when(F.col("key") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    parts = max(shards, rows // 200_000)
    placed = keyed.withColumn("shard", shard).repartitionByRange(parts, "key").sortWithinPartitions("key")
    kind = df.schema[id_col].dataType.simpleString()
    placed = saved(placed.mapInArrow(_numbered, f"id {kind}, size bigint, text_crc32 bigint, key string, shard int, part int, place bigint"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()  # a row for each task, and for each shard's edge
    start, offsets = {}, []
    for r in sorted(counts, key=lambda r: (r["shard"], r["part"])):
        offsets.append((r["shard"], r["part"], start.get(r["shard"], 0)))
        start[r["shard"]] = start.get(r["shard"], 0) + r["n"]
    before = df.sparkSession.createDataFrame(offsets, "shard int, part int, before bigint")
    out = placed.join(F.broadcast(before), ["shard", "part"])  # as many rows as tasks and shards
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
