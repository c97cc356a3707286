"""Codes against Lloyd's rounds in plain whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terralith.llm")

from terralith.llm import vector_codes
from terralith.llm.vector_codes import PARTS

KIND = "vec_id bigint, embedding array<double>, label int"


def brute(rows, dims, entries, rounds):
    sound = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in sound if len(v) == dims]
    order = sorted(((i is None, i or 0, v, k) for k, (i, v, _) in enumerate((r for r in sound if len(r[1]) == dims))))
    width = dims // PARTS
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(PARTS)]
    books = [[list(cut(kept[k][1])[p]) for *_, k in order[:entries]] for p in range(PARTS)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: far(part, books[p][e])) for p, part in enumerate(cut(v))] for _, v, _ in kept]
    for _ in range(rounds):
        found = near()
        for p in range(PARTS):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, found, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = [(i, bytes(c).hex(), sum(far(part, books[p][c[p]]) for p, part in enumerate(cut(v))), label) for (i, v, label), c in zip(kept, near(), strict=True)]
    out += [(i, None, None, c) for i, v, c in sound if len(v) != dims]
    of = {}
    for _, _, e, label in out:
        of[label] = of.get(label, 0) + e if e is not None else of.get(label)
    return sorted(((i, code, e, of[label], digest) for i, code, e, label in out), key=str)


def clustered(seed, n, dims, spread=0.3):
    rng = np.random.RandomState(seed)
    centres = rng.standard_normal((12, dims))
    return [(int(i * 3 % 1009), [float(x) for x in centres[rng.randint(12)] + spread * rng.standard_normal(dims)], int(rng.randint(4)) if rng.rand() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize(("dims", "entries", "rounds"), [(32, 64, 2), (16, 7, 5), (48, 1, 2), (16, 300, 0)])
def test_codes_match_brute_force(spark, monkeypatch, dims, entries, rounds):
    monkeypatch.setattr(vector_codes, "BLOCK", 40)
    rows = clustered(5, 250, dims)
    rows += [(2000, None, 1), (2001, [float("nan")] * dims, 1), (2002, [None] + [1.0] * (dims - 1), 1), (2003, [float("inf")] * dims, 2), (2004, [], 3), (2005, [1.0] * (dims + 1), 9), (None, [0.25] * dims, 1), rows[4], rows[4], (0, [-1.0] * dims, 1)]
    if entries > 256:
        rows = rows[:200]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("id", "v", "code", "error", "same", "d", "n")}).repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress_vectors(df, "vec_id", "embedding", "label", min(entries, 256), rounds).collect()), key=str)
    assert got == brute(rows, dims, min(entries, 256), rounds)


def test_large_components(spark):
    """Numbers beyond 64 bits are compared exactly; an error that 63 bits can't hold is null."""
    rng = np.random.RandomState(8)
    rows = [(i, [float(x) for x in rng.standard_normal(16) * 10.0 ** rng.randint(0, 22)], 1) for i in range(60)]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compress_vectors(spark.createDataFrame(rows, KIND), "vec_id", "embedding", "label", 5).collect()}
    want = {r[0]: (r[1], r[2] if r[2] < 2**63 else None) for r in brute(rows, 16, 5, 2)}
    assert got == want and any(e is None for _, e in want.values())


def test_codes_of_nothing(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert vector_codes.compress_vectors(spark.createDataFrame([], KIND), "vec_id", "embedding", "label").count() == 0
    rows = vector_codes.compress_vectors(spark.createDataFrame([(1, [1.0, 2.0], None)], KIND), "vec_id", "embedding", "label").collect()
    assert [tuple(r) for r in rows] == [(1, None, None, None, empty)]


def test_heaps_spare_work():
    """A round pops some parts, not all, and those left have kept their nearest entry."""
    values = np.floor(np.array([r[1] for r in clustered(2, 4000, 64, 0.1)]) * 256).astype(np.int64)
    old = [[values[k, p * 4 : p * 4 + 4].tolist() for k in range(64)] for p in range(PARTS)]
    block = vector_codes._Block(values, vector_codes._arrays(old))
    spent = [np.zeros(64)] * PARTS
    for _ in range(3):
        new = [[[x + 1 if e % 9 == 0 else x for x in entry] for e, entry in enumerate(book)] for book in old]
        spent = [s + d for s, d in zip(spent, vector_codes._drifts(old, new), strict=True)]
        old, block.looked = new, 0
        books = vector_codes._arrays(new)
        block.round(books, spent)
        assert 0 < block.looked < 0.8 * values.shape[0] * PARTS
        for p in range(PARTS):
            assert (block.assigned[p] == vector_codes._look(block.part(p, slice(None)), books[p])[0]).all()
