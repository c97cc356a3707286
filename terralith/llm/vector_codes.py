"""Vector code compression: product codebooks by Lloyd's rounds with heaps of bounds (Heap Lloyd).

Vectors become whole numbers and are cut into PARTS equal parts; every position of a part has a codebook of its own.  Rounds
assign each part to its nearest entry and move the entries to the means of their parts.

The vectors are held in blocks, one row of a table each.  A block keeps a heap for each part position and entry: the parts
assigned to the entry, ordered by the slack of their bounds (distance to the second nearest entry minus distance to the
nearest).  When entries move, a part's slack shrinks by no more than its entry's drift and the largest drift of another
entry.  These drifts add up over the rounds; a part's key is its slack plus what had added up when it was last looked at, so
a heap is popped while its least key is at most the sum of today, and only popped parts are held against all entries
again, exactly.  A heap is an array in ascending order: a part's parent is never behind it, pops come off the front, and
parts that have been looked at are merged in again.

Blocks send sums of the parts that have changed their entry, never vectors; the driver sees the codebooks and these sums
(as many numbers as the codebooks have, whatever the number of vectors).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import dropped, saved

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 8192  # vectors
BLOCK_BYTES = 1 << 23
SMALL = 1 << 26  # up to this size squares of 64-bit numbers can be added up; larger ones are Python's whole numbers
MARGIN = 1e-9  # of the keys, for rounding

STATE = "ids array<bigint>, labels array<{label}>, values binary, wide boolean, assigned binary, keys binary, heaps binary, sums array<string>"


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of every component: 64-bit numbers, or Python's where they are large."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) * SCALE)
    return x.astype(np.int64) if np.abs(x).max(initial=0) <= SMALL else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(-1, dims)


def _squares(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts to entries."""
    d = part[:, None, :] - book[None, :, :]
    return (d * d).sum(axis=2)


def _look(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries (ties to the lower) and the slack of each part, to the next nearest entry."""
    d = _squares(part, book)
    near = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d])
    at = np.arange(len(d))
    best = np.sqrt(d[at, near].astype(np.float64))
    if d.shape[1] == 1:
        return near, np.full(len(d), np.inf)
    rest = d.astype(np.float64)
    rest[at, near] = np.inf
    return near, np.sqrt(rest.min(axis=1)) - best


class _Block:
    """Vectors of one block with their entries and heaps. ``keys`` and ``assigned`` are per part position and vector,
    ``heaps`` the vectors by (entry, key)."""

    def __init__(self, values: np.ndarray, books: list[np.ndarray]) -> None:
        n, dims = values.shape
        self.values, self.width = values, dims // PARTS
        self.assigned, self.keys, self.heaps = np.zeros((PARTS, n), np.uint8), np.zeros((PARTS, n)), np.zeros((PARTS, n), np.int32)
        self.sums: dict[tuple[int, int], list[int]] = {}
        self.looked = 0
        for p in range(PARTS):
            self._place(p, np.arange(n), books[p], np.zeros(len(books[p])), first=True)

    def part(self, p: int, at) -> np.ndarray:
        return self.values[at, p * self.width : (p + 1) * self.width]

    def _move(self, p: int, at: np.ndarray, entries: np.ndarray, sign: int) -> None:
        for e in np.unique(entries).tolist():
            rows = self.part(p, at[entries == e])
            held = self.sums.setdefault((p, e), [0] * (self.width + 1))
            for j, v in enumerate([len(rows), *(int(x) for x in rows.sum(axis=0))]):
                held[j] += sign * v

    def _place(self, p: int, at: np.ndarray, book: np.ndarray, spent: np.ndarray, first: bool = False) -> None:
        """Looks at the parts ``at`` again and puts them into the heaps of their entries."""
        self.looked += len(at)
        near, slack = _look(self.part(p, at), book)
        moved = np.ones(len(at), bool) if first else near != self.assigned[p, at]
        if not first:
            self._move(p, at[moved], self.assigned[p, at[moved]], -1)
        self._move(p, at[moved], near[moved], 1)
        self.assigned[p, at], self.keys[p, at] = near, slack + spent[near]
        self.heaps[p] = np.lexsort((self.keys[p], self.assigned[p]))

    def pop(self, p: int, spent: np.ndarray) -> np.ndarray:
        """The parts at the front of the heaps whose bounds no longer hold."""
        heap = self.heaps[p]
        edge = np.searchsorted(self.assigned[p, heap], np.arange(len(spent) + 1))
        keys = self.keys[p, heap]
        out = [heap[a : a + int(np.searchsorted(keys[a:b], s + MARGIN * (1 + s), "right"))] for a, b, s in zip(edge[:-1].tolist(), edge[1:].tolist(), spent.tolist(), strict=True)]
        return np.concatenate(out)

    def round(self, books: list[np.ndarray], spent: list[np.ndarray]) -> None:
        self.sums = {}
        for p in range(PARTS):
            at = self.pop(p, spent[p])
            if len(at):
                self._place(p, at, books[p], spent[p])

    def errors(self, books: list[np.ndarray]) -> list[int | None]:
        total = 0
        for p in range(PARTS):
            d = self.part(p, slice(None)) - books[p][self.assigned[p]]
            total = total + (d * d).sum(axis=1)
        return [int(x) if int(x) < 1 << 63 else None for x in total]

    def stored(self, ids: pa.Array, labels: pa.Array) -> pa.RecordBatch:
        wide = self.values.dtype == object
        values = "\n".join(" ".join(map(str, r)) for r in self.values).encode() if wide else self.values.astype("<i8").tobytes()
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        binary = lambda data: pa.array([data], pa.binary())
        sums = pa.array([[" ".join(map(str, (p, e, *v))) for (p, e), v in sorted(self.sums.items())]], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([one(ids), one(labels), binary(values), pa.array([wide]), binary(self.assigned.tobytes()), binary(self.keys.tobytes()), binary(self.heaps.tobytes()), sums], names=["ids", "labels", "values", "wide", "assigned", "keys", "heaps", "sums"])

    @classmethod
    def restored(cls, row: dict, n: int) -> _Block:
        out = cls.__new__(cls)
        data = row["values"]
        out.values = np.array([[int(x) for x in line.split()] for line in data.decode().split("\n")], object) if row["wide"] else np.frombuffer(data, "<i8").reshape(n, -1)
        out.width = out.values.shape[1] // PARTS
        out.assigned = np.frombuffer(row["assigned"], np.uint8).reshape(PARTS, n).copy()
        out.keys = np.frombuffer(row["keys"], np.float64).reshape(PARTS, n).copy()
        out.heaps = np.frombuffer(row["heaps"], np.int32).reshape(PARTS, n).copy()
        out.sums, out.looked = {}, 0
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, _Block]]:
    """The blocks of a table of states."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten()
            row = {c: batch.column(c)[i].as_py() for c in ("values", "wide", "assigned", "keys", "heaps")}
            yield ids, labels, _Block.restored(row, len(ids))


def _moved(books: list[list[list[int]]], counts: list[list[list[int]]], state: DataFrame) -> list[list[list[int]]]:
    """The codebooks after the blocks' changes of sums: entries that hold no part stay. ``counts`` (sums so far) is updated."""
    line = F.split("s", " ")
    rows = state.select(F.explode("sums").alias("s")).select(line[0].cast("int").alias("p"), line[1].cast("int").alias("e"), F.posexplode(F.slice(line, 3, 1_000_000)).alias("j", "v"))
    for r in rows.groupBy("p", "e", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # numbers of the codebooks
        counts[r["p"]][r["e"]][r["j"]] += int(r["v"])
    return [[[s // c[0] for s in c[1:]] if c[0] else entry for entry, c in zip(book, held, strict=True)] for book, held in zip(books, counts, strict=True)]


def _arrays(books: list[list[list[int]]]) -> list[np.ndarray]:
    small = all(abs(v) <= SMALL for book in books for entry in book for v in entry)
    return [np.array(book, np.int64 if small else object) for book in books]


def _drifts(old: list[list[list[int]]], new: list[list[list[int]]]) -> list[np.ndarray]:
    """What each entry's slacks may lose: its own drift and the largest of another entry."""
    out = []
    for a, b in zip(old, new, strict=True):
        drift = np.array([float(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))) ** 0.5 for p, q in zip(a, b, strict=True)])
        other = np.array([np.delete(drift, e).max(initial=0.0) for e in range(len(drift))])
        out.append((drift + other) * (1 + MARGIN))
    return out


def compress_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of ``df``: id, ``code`` (an entry's number in two hex digits for each part), ``error`` (squared
    distances of its parts to their final entries), ``label_error`` (the errors of its label together; null labels are one
    group) and ``codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors have one length, the commonest that
    PARTS divides (of equals the least); rows of other lengths, empty ones included, are kept with a null code and error.
    The codebooks begin with the ``entries`` (256 at most) smallest ids, null ids last; of equal ids the vector that sorts
    first. Fewer vectors make fewer entries. Repeated rows count each. An error over 63 bits is null. An empty table, or one
    without a vector to code, has no codebooks, and the hash is that of the empty text. Other columns aren't read.
    """
    spark, label = df.sparkSession, df.schema[label_col].dataType.simpleString()
    vector = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False)))
    size = F.size(vector)
    commonest = rows.where((size > 0) & (size % PARTS == 0)).groupBy(size.alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    dims = commonest["d"] if commonest else 0
    fitting = rows.where(size == dims) if dims else rows.limit(0)
    # The one small sample that the method itself asks for.
    seeds = [r["v"] for r in fitting.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    whole = [[int(np.floor(x * SCALE)) for x in v] for v in seeds]
    width = dims // PARTS
    books = [[v[p * width : (p + 1) * width] for v in whole] for p in range(PARTS)] if dims else []
    counts = [[[0] * (width + 1) for _ in book] for book in books]
    schema = STATE.format(label=label)
    state = None

    def start(given: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
            for batch in batches:
                for i in range(0, batch.num_rows, most):
                    part = batch.slice(i, most)
                    yield _Block(_numbers(part.column(2), dims), given).stored(part.column(0), part.column(1))

        return run

    def again(given: list[np.ndarray], spent: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, block in _blocks(batches):
                block.round(given, spent)
                yield block.stored(ids, labels)

        return run

    def coded(given: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, block in _blocks(batches):
                codes = [bytes(c).hex() for c in block.assigned.T]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(block.errors(given), pa.int64())], names=["id", "label", "code", "error"])

        return run

    out = rows.where(size != dims).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if dims:
        spent = [np.zeros(len(book)) for book in books]
        state = saved(fitting.select("id", "label", "v").mapInArrow(start(_arrays(books)), schema))
        for _ in range(rounds):
            new = _moved(books, counts, state)
            spent = [s + d for s, d in zip(spent, _drifts(books, new), strict=True)]
            books, before = new, state
            state = saved(before.mapInArrow(again(_arrays(books), spent), schema))
            dropped(before)
        out = saved(state.mapInArrow(coded(_arrays(books)), f"id bigint, label {label}, code string, error bigint")).unionByName(out)
        dropped(state)
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    sums = out.groupBy(F.col("label").alias("same")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    met = out.join(sums, F.col("label").eqNullSafe(F.col("same")), "left")
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
