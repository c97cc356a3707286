"""Best-fit packing of token sequences, with certified bounds and repacking of the partitions that miss them.

1. One pass over the texts: tokens by a public tokenizer, one closing id, cut into pieces of at most ``capacity``.
2. The pieces are dealt over tasks by a hash, each packs its own by best-fit decreasing and compares its number of
   sequences with a lower bound from dual feasible functions.  A task that meets its bound is certified: it hands on
   only the documents of its emptiest sequence.  One that misses it hands on those of its emptier half.
3. What is handed on is dealt again over fewer tasks by another hash and packed again, until one task's worth is left.

No task ever holds more than its share of (id, length) pairs; texts and ids don't leave the first pass.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm import tokens
from terralith.llm.common import saved

TASK_PIECES = 20_000
ROUNDS = 4
MOST_LEFT = 200_000  # in the last round's one task; beyond it the last round is dealt over tasks as well


def lower_bound(lengths: np.ndarray, capacity: int, many: np.ndarray | None = None) -> int:
    """Sequences that any packing needs: the best of the sum of lengths and of the dual feasible functions that round
    lengths over ``capacity - e`` up to the whole and those under ``e`` down to nothing. ``many``: of each length."""
    if not len(lengths):
        return 0
    if many is None:
        lengths, many = np.unique(lengths, return_counts=True)
    order = np.argsort(lengths)
    lengths, many = lengths[order].astype(np.int64), many[order].astype(np.int64)
    sums, n = np.concatenate(([0], np.cumsum(lengths * many))), np.concatenate(([0], np.cumsum(many)))
    best = -(-int(sums[-1]) // capacity)
    half = int(np.searchsorted(lengths * 2, capacity, "right"))
    small = np.concatenate(([0], lengths[:half]))
    for e in small[np.linspace(0, len(small) - 1, min(len(small), 256)).astype(int)]:
        whole = max(int(np.searchsorted(lengths, capacity - e, "right")), half)
        low = int(np.searchsorted(lengths, e, "left"))
        room = (n[whole] - n[half]) * capacity - (sums[whole] - sums[half])  # beside those over a half, up to capacity - e
        rest = sums[half] - sums[low]  # from e to a half
        best = max(best, int(n[-1] - n[half]) + max(0, -(-int(rest - room) // capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's sequence and offset. Among equal gaps the one opened first takes the piece."""
    order = np.argsort(-lengths, kind="stable")
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: dict[int, list[int]] = {}
    kept: list[int] = []  # the gaps that occur, ascending
    opened = 0
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(kept, n)
        if at == len(kept):
            b, gap, opened = opened, capacity, opened + 1
        else:
            gap = kept[at]
            b = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                kept.pop(at)
        seq[i], off[i] = b, capacity - gap
        if left := gap - n:
            if left not in gaps:
                gaps[left] = []
                bisect.insort(kept, left)
            gaps[left].append(b)
    return seq, off


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = tokens.WordCoder(tokenizer)
    last = np.array([end_id], np.uint32).tobytes()
    names = ["id", "row", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        ids, rows, text = batch.columns
        at, cols = [], [[] for _ in names[2:]]
        for i, data in enumerate(coder.encode(text)):
            data += last
            for k, a in enumerate(range(0, len(data), 4 * capacity)):
                part = data[a : a + 4 * capacity]
                at.append(i)
                for c, v in zip(cols, (k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    c.append(v)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(take), rows.take(take), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)


def _packed(group: pa.Table, capacity: int, last: bool) -> pa.Table:
    """One task's share: ``sequence`` within the share, ``offset``, and ``stays`` (false: handed on)."""
    group = group.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
    lengths = group.column("length").to_numpy()
    seq, off = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(seq, lengths)
    stays = np.ones(len(fill), bool)
    bound = lower_bound(lengths, capacity)
    if not last:
        emptiest = np.argsort(fill, kind="stable")
        missed = len(fill) > bound
        stays[emptiest[: max(1, len(fill) // 2) if missed else 1]] = False
        stays[fill == capacity] = True
    cols = {"sequence": seq, "offset": off, "stays": stays[seq], "task_sequences": np.full(len(seq), len(fill)), "task_bound": np.full(len(seq), bound)}
    for name, values in cols.items():
        group = group.append_column(name, pa.array(values))
    return group


def _packer(capacity: int, last: bool):
    return lambda group: _packed(group, capacity, last)


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``; and what
    certifies the packing: how many sequences the task made that packed it (``task_sequences``), how many its pieces need
    (``task_bound``), and how many all pieces need (``least_sequences``).

    A text's ids end in ``end_id``; only texts of more than ``capacity`` ids are cut. Null and empty texts are one
    piece of the closing id. Repeated rows are packed each; an empty table gives an empty result; other columns aren't
    read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    schema = f"id {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = saved(texts.mapInArrow(lambda b: _cut(b, tokenizer, capacity, end_id), schema))
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # a row for each length up to the capacity
    least = lower_bound(sizes.column(0).to_numpy(), capacity, sizes.column(1).to_numpy())
    left, done = pieces, []
    for step in range(ROUNDS):
        n = left.count()
        if not n:
            break
        last = step == ROUNDS - 1 or (step > 0 and n <= TASK_PIECES)
        shares = 1 if last and n <= MOST_LEFT else max(1, -(-n // (TASK_PIECES << step)))
        dealt = left.withColumn("share", F.pmod(F.xxhash64(F.lit(step), "row", "piece"), F.lit(shares)))
        out = dealt.groupBy("share").applyInArrow(_packer(capacity, last or shares == 1), f"{schema}, share bigint, sequence bigint, offset bigint, stays boolean, task_sequences bigint, task_bound bigint")
        out = saved(out)
        done.append(out.where("stays").select("id", "row", "piece", "start", "length", "ids_crc32", "offset", "task_sequences", "task_bound", (F.lit(step << 60) + F.shiftleft("share", 32) + F.col("sequence")).alias("sequence_id")))
        if last or shares == 1:
            break
        left = out.where("not stays").select("id", "row", "piece", "start", "length", "ids_crc32")
    zero = F.lit(0).cast("bigint")
    every = done[0] if done else pieces.withColumns({c: zero for c in ("sequence_id", "offset", "task_sequences", "task_bound")})
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "task_sequences", "task_bound", F.lit(least).cast("bigint").alias("least_sequences"))
