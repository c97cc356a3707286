"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Words (runs of letters and digits, lower-cased) are hashed.  Three fixed masks of six words, spread over six, eight and
ten positions, give every position of every text three seeds; positions that a mask ignores may differ.  The seeds of
the benchmark and of the corpus are joined, and around each hit the aligned words are compared: the text is
contaminated if, in some stretch of ``STRETCH`` aligned words that touches the seed, at least ``EQUAL`` per cent are equal.
An item of fewer than six words is one seed as a whole: it is found where it stands word for word.

Two fixed-size bit tables keep most positions from ever becoming rows: one of the benchmark's word pairs (all masks
begin with two words in a row), one of its seeds.  Their size doesn't go with the data; where a large benchmark fills
them, more rows reach the join, which stays exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import fresh, saved
from terralith.llm.line_dedup import let

MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 1, 3, 6, 8, 9))
SPAN, LEAST = 10, 6  # words that a mask spans at most; words of a mask
STRETCH, EQUAL = 13, 80
PAIR_BITS, SEED_BITS = 17, 18
MOST_BROADCAST = 200_000  # seeds of the benchmark, of some 300 bytes each


def _words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seed(h: Column, i: Column, m: int) -> Column:
    return F.xxhash64(F.lit(m), *(h[i + k] for k in MASKS[m]))


def _around(h: Column, i: Column) -> Column:
    """The words from STRETCH - 1 before a seed to as many behind it; null beyond the ends of the text."""
    return F.transform(F.sequence(F.lit(1 - STRETCH), F.lit(SPAN + STRETCH - 2)), lambda d: F.when(i + d >= 0, F.get(h, F.greatest(i + d, F.lit(0)))))


def _pair(h: Column, i: Column) -> Column:
    return F.xxhash64(h[i], h[i + 1])


def _bits(values: DataFrame, bits: int) -> Column:
    """A literal bit table of one column of hashes: 2**bits bits, whatever the number of values."""
    at = values.select(F.pmod(F.col(values.columns[0]), F.lit(1 << bits)).cast("int").alias("b")).distinct()
    words = np.zeros(1 << (bits - 6), np.uint64)
    for r in at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.collect_list(F.col("b").bitwiseAND(63)).alias("n")).collect():
        for n in r["n"]:
            words[r["w"]] |= np.uint64(1) << np.uint64(n)
    return F.array(*(F.lit(int(w)) for w in words.view(np.int64)))


def _has(table: Column, bits: int, value: Column) -> Column:
    return let(F.pmod(value, F.lit(1 << bits)), lambda b: F.getbit(table[F.shiftright(b, 6).cast("int")], b.bitwiseAND(63).cast("int")) == 1)


def _whole(h: Column, i: Column, n: int) -> Column:
    """The seed of ``n`` words in a row, for items of just as many."""
    return F.xxhash64(F.lit(-n), *(h[i + k] for k in range(n)))


def _masked(h: Column, positions: Column) -> Column:
    """(seed, pos) for each position and each mask that fits there."""
    one = lambda i: F.array(*(F.struct(F.when(i + MASKS[m][-1] < F.size(h), _seed(h, i, m)).alias("seed"), i.alias("pos")) for m in range(len(MASKS))))
    return F.filter(F.flatten(F.transform(positions, one)), lambda s: s["seed"].isNotNull())


def _positions(h: Column, words: int = LEAST) -> Column:
    """Where ``words`` words in a row can begin."""
    return F.when(F.size(h) >= words, F.sequence(F.lit(0), F.size(h) - words)).otherwise(F.array().cast("array<int>"))


def _item_seeds(h: Column) -> Column:
    short = F.coalesce(*(F.when(F.size(h) == n, F.array(F.struct(_whole(h, F.lit(0), n).alias("seed"), F.lit(0).alias("pos")))) for n in range(1, LEAST)), F.array().cast("array<struct<seed:bigint,pos:int>>"))
    return F.concat(_masked(h, _positions(h)), short)


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """One row per text and benchmark item that overlap: ``id_col``, ``_text`` (hash of the text), ``item_col`` and
    ``equal``, the most equal words in a stretch.

    Null and empty texts and items, and those without letters and digits, overlap with nothing. In items of fewer than
    STRETCH words the stretch is the item. Repeated rows give one row. An empty table on either side gives an empty
    result. Only the named columns are read, so others may have any name; if both ids have one name, the item's is
    returned with ``item_`` before it.
    """
    of_item = let(_words(F.col(item_text_col)), lambda h: F.transform(_item_seeds(h), lambda s: F.struct(s["seed"].alias("seed"), _around(h, s["pos"]).alias("item_words"), F.size(h).alias("item_n"))))
    seeds = saved(benchmark.select(F.col(item_col).alias("_item"), F.explode(of_item).alias("s")).select("_item", "s.*"))
    first_two = lambda h: F.when((F.size(h) > 1) & (F.size(h) < LEAST), F.array(_pair(h, F.lit(0)))).otherwise(F.transform(_positions(h), lambda i: _pair(h, i)))
    pairs = benchmark.select(F.explode(let(_words(F.col(item_text_col)), first_two)).alias("p"))
    short = sorted(r["item_n"] for r in seeds.where(F.col("item_n") < LEAST).select("item_n").distinct().collect())  # five at most
    pair_table, seed_table = _bits(pairs, PAIR_BITS), _bits(seeds.select("seed"), SEED_BITS)

    def near(h: Column) -> Column:
        met = F.filter(_positions(h, 2), lambda i: _has(pair_table, PAIR_BITS, _pair(h, i)))
        whole = lambda n: F.transform(F.filter(_positions(h, 1) if n == 1 else met, lambda i: i + n <= F.size(h)), lambda i: F.struct(_whole(h, i, n).alias("seed"), i.alias("pos")))
        known = F.filter(F.concat(_masked(h, met), *map(whole, short)), lambda s: _has(seed_table, SEED_BITS, s["seed"]))
        return F.transform(known, lambda s: F.struct(s["seed"].alias("seed"), _around(h, s["pos"]).alias("words")))

    found = let(_words(F.col(text_col)), near)
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), F.explode(found).alias("s")).select("_id", "_text", "s.seed", "s.words")
    small = seeds.count() <= MOST_BROADCAST
    met = rows.join(F.broadcast(seeds) if small else seeds, "seed")
    same = F.zip_with("words", "item_words", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    size = F.least(F.lit(STRETCH), F.col("item_n"))
    most = let(same, lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.size(e) - size + 1), lambda k: F.aggregate(F.slice(e, k, size), F.lit(0), lambda a, b: a + b))))
    met = met.select("_id", "_text", "_item", size.alias("size"), most.alias("equal")).where(F.col("equal") * 100 >= F.col("size") * EQUAL)
    item = item_col if item_col != id_col else f"item_{item_col}"
    return met.groupBy("_id", "_text", "_item").agg(F.max("equal").alias("equal")).select(F.col("_id").alias(id_col), "_text", F.col("_item").alias(item), "equal")


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The rows of ``df`` that overlap with no benchmark item, with all their columns, whatever their names."""
    own, text = fresh(df, "leak_id", "leak_text")
    leaks = find_leaks(df, benchmark, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias(own), F.col("_text").alias(text)).distinct()
    return df.join(leaks, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(text)), "left_anti")
