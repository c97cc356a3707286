"""Exact quantiles by repeated histograms: no sort, and no group of values in one task.

A pass counts the values between two bounds in equal cells; the next pass looks only into the cells that hold a wanted
rank, until a cell is small enough to be listed.  The driver sees a bounded number of cell counts.
"""

from __future__ import annotations

import bisect
import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1024
LISTED = 20_000  # values that the driver may sort


def exact_quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation between the two nearest ranks, over the non-null values (all finite)."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    wanted = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    found: dict[int, float] = {}
    open_: list[tuple[float, float, int, list[int]]] = [(low, high, 0, wanted)]  # bounds, rows below, ranks
    if n <= LISTED:
        values = sorted(r[0] for r in v.collect())
        found, open_ = {k: values[k] for k in wanted}, []
    found |= {k: a for a, b, _, ranks in open_ if a == b for k in ranks}
    open_ = [o for o in open_ if o[0] != o[1]]
    while open_:
        # One pass over all open stretches (they don't overlap), then one that lists the cells that are small enough.
        listed, wider, x = [], [], F.col("v")
        chosen = lambda make: F.coalesce(*(F.when((x >= a) & (x <= b), make(i, a, b)) for i, (a, b, *_) in enumerate(open_)))  # noqa: B023, E731
        cell = lambda i, a, b: F.least(F.lit(CELLS - 1), F.floor((x - a) / ((b - a) / CELLS))) if (b - a) / CELLS > 0 else F.lit(0)  # noqa: B023, E731
        counted = v.select("v", chosen(lambda i, a, b: F.lit(i)).alias("s"), chosen(cell).alias("c")).where("s is not null")
        cells: dict[int, list] = {}
        for r in sorted(counted.groupBy("s", "c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
            cells.setdefault(r["s"], []).append(r)
        for i, (_, _, below, ranks) in enumerate(open_):
            for r in cells[i]:
                mine = [k for k in ranks if below <= k < below + r["n"]]
                if mine and r["lo"] == r["hi"]:
                    found |= dict.fromkeys(mine, r["lo"])
                elif mine:
                    (listed if r["n"] <= LISTED else wider).append((r["lo"], r["hi"], below, mine))
                below += r["n"]
        if listed:
            inside = [(x >= a) & (x <= b) for a, b, *_ in listed]
            values = sorted(r[0] for r in v.where(reduce(lambda p, q: p | q, inside)).collect())  # LISTED values for each rank at most
            for a, _, below, ranks in listed:
                at = bisect.bisect_left(values, a)
                found |= {k: values[at + k - below] for k in ranks}
        open_ = wider
    out = []
    for p in probs:
        at = p * (n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out
