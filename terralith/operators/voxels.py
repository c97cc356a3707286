"""Cells of voxel tiles as plain rows (tile, x, y, z, weight): duplicates, conflicts and the registered envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.scalar import is_finite
from terralith.operators.errors import GeoError

PLACES = 3


def distinct_cells(tiles: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row per place, rounded to three decimals, with the weight of the first tile by name. Weights of one place that
    differ by more than ``tolerance`` are a conflict."""
    key = [F.round(c, PLACES).alias(c) for c in ("x", "y", "z")]
    found = tiles.select("tile", *key, "weight").groupBy("x", "y", "z").agg(F.min_by("weight", "tile").alias("weight"), (F.max("weight") - F.min("weight") > tolerance).alias("_conflict"))
    n = found.where("_conflict").count()
    if n:
        raise GeoError("VOXEL_CONFLICT", places=n)
    return found.drop("_conflict")


def conflicts(tiles: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(x, y, z, tiles, low, high) of the places whose weights disagree."""
    key = [F.round(c, PLACES).alias(c) for c in ("x", "y", "z")]
    found = tiles.select(*key, "weight").groupBy("x", "y", "z").agg(F.count("*").alias("tiles"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    return found.where(F.col("high") - F.col("low") > tolerance)


def summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("x", "y", "z", "weight") for n, f in (("min", F.min), ("max", F.max))))


def violations(cells: DataFrame, expected: int, ratio: tuple[float, float], most: int, values: tuple[float, float, float], envelope: dict[str, tuple[float, float]], tolerance: float) -> DataFrame:
    """(rule, n) for every rule that the cells break: none at all, too many, a number outside ``ratio`` times the expected
    one, parts that aren't finite, weights outside (low, high, slack), and axes that leave the envelope."""
    finite = F.lit(True)
    for c in ("x", "y", "z", "weight"):
        finite = finite & F.coalesce(is_finite(F.col(c)), F.lit(False))
    low, high, slack = values
    out = {c: (F.col(c) < a - tolerance) | (F.col(c) > b + tolerance) for c, (a, b) in envelope.items()}
    s = cells.agg(F.count("*").alias("n"), F.count_if(~finite).alias("odd"), F.count_if((F.col("weight") < low - slack) | (F.col("weight") > high + slack)).alias("values"), *(F.count_if(v).alias(c) for c, v in out.items())).first()
    rules = [("empty", 1, s["n"] == 0), ("too_many", s["n"], s["n"] > most), ("count_window", s["n"], 0 < s["n"] and not expected * ratio[0] <= s["n"] <= expected * ratio[1]), ("not_finite", s["odd"], s["odd"] > 0), ("value_range", s["values"], s["values"] > 0), *((f"envelope_{c}", s[c], s[c] > 0) for c in envelope)]
    return cells.sparkSession.createDataFrame([(r, int(n)) for r, n, broken in rules if broken], "rule string, n bigint")
