"""Phrase collocation mining with hashed buckets (PCY/DHP).

Phrases are counted length by length, one scan of the texts for each.  The scan for length k

* counts phrases of k words exactly, but only those whose two phrases of k - 1 words are frequent (Apriori) and whose
  bucket held enough phrases in the scan before (PCY);
* hashes the phrases of k + 1 words whose two parts have passed that test into 2**BITS buckets (DHP).

What goes from one scan to the next are two bitmaps of 2**BITS bits, whatever the size of the corpus: which buckets are
full enough, and the places of the phrases that are frequent.  Different phrases may share a place, so a bitmap only
spares work; the counts are those of the words themselves.  A task's bucket counts stop at the least frequency (a byte
each) and are added up by streams of blocks, so no task holds more than its blocks.

Everything is per language, which is part of a word's hash.  Counting is vectorised over chunks of about CHUNK bytes of
text and pre-aggregated there; the words of a chunk are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm import hashing
from terralith.llm.common import dropped, saved

BITS = 26
BLOCK = 16  # bits of a place within its block
CHUNK = 1 << 23
AT_ONCE = 1 << 15  # rows that a task hands over at once
LEAST = 10
LONGEST = 3
SHARE = 50  # per cent of a phrase's occurrences that lie in one longer phrase
TOP = 2000
SALTS = 32
SCALE = 1_000_000
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True

ROWS = "lang string, w1 string, w2 string, w3 string, place bigint, n bigint, block int, at binary, held binary"


class _Words:
    """The words of a chunk: hashes with the language in them, pieces, and dense numbers."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = hashing._LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        self.lower = data.tobytes()
        starts, ends, found = [], [], []
        for a, b in hashing.pieces_of(data) if len(data) else []:
            start, end = hashing.runs(~_GAP[data[a:b]])
            found.append(hashing.span_hashes(data[a:b], start, end))
            starts.append((start + a).astype(np.int32))  # a text is shorter than 2**31 bytes
            ends.append((end + a).astype(np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, plain = join(starts, np.int32), join(ends, np.int32), join(found, np.uint64)
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[data]).astype(np.int32), self.start).astype(np.int32)
        edge = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        self.langs, of = np.unique(np.array(langs, object), return_inverse=True)
        own = np.array([hashing.words_of([b"lang:" + x.encode().hex().encode()])[0][0] for x in self.langs], np.uint64)
        self.lang = of.astype(np.int32)[np.searchsorted(edge.astype(np.int32), self.start, "right")] if len(self.start) else np.zeros(0, np.int32)
        self.hash = hashing.mixed(plain ^ own[self.lang]) if len(plain) else plain

    def places(self, size: int, bits: int) -> np.ndarray:
        h = self.hash if size == 1 else hashing.windows(self.hash, size)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First positions and numbers of the different phrases of ``size`` words that begin ``at``."""
        _, which = np.unique(self.hash, return_inverse=True)
        kinds = int(which.max(initial=0)) + 1
        key, most = which[at], kinds
        for j in range(1, size):
            if most * kinds >= 1 << 62:
                _, key = np.unique(key, return_inverse=True)
                most = int(key.max(initial=0)) + 1
            key, most = key * kinds + which[at + j], most * kinds
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return at[first], n

    def strings(self, at: np.ndarray) -> pa.Array:
        found, first, which = np.unique(self.hash[at], return_index=True, return_inverse=True)
        words = [self.lower[a:b] for a, b in zip(self.start[at[first]].tolist(), self.end[at[first]].tolist(), strict=True)]
        return pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(which))


def _has(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[_Words]:
    texts: list[bytes] = []
    langs: list[str] = []
    held = 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py().encode()
            if held and held + len(data) > chunk:
                yield _Words(texts, langs)
                texts, langs, held = [], [], 0
            texts.append(data)
            langs.append(lang.as_py())
            held += len(data) + 1
    if texts:
        yield _Words(texts, langs)


def _rows(words: _Words, at: np.ndarray, size: int, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The different phrases that begin ``at``, in batches of AT_ONCE, so that neither this side nor the JVM holds all as text."""
    every, counts = words.counted(at, size)
    for i in range(0, len(every), AT_ONCE):
        first, n = every[i : i + AT_ONCE], counts[i : i + AT_ONCE]
        none = pa.nulls(len(first), pa.string())
        columns = [words.strings(first + j) for j in range(size)] + [none] * (3 - size)
        lang = pa.array(words.langs.tolist(), pa.string()).take(pa.array(words.lang[first]))
        yield pa.RecordBatch.from_arrays([lang, *columns, pa.array(place[first]), pa.array(n, pa.int64()), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary()), pa.nulls(len(first), pa.binary())], names=[c.split()[0] for c in ROWS.split(", ")])


def _cells(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has in its buckets, block by block: places that aren't empty and their counts."""
    for block in range(len(held) >> BLOCK):
        part = held[block << BLOCK : (block + 1) << BLOCK]
        at = np.flatnonzero(part)
        if len(at):
            values = {"block": pa.array([block], pa.int32()), "at": pa.array([at.astype("<u2").tobytes()], pa.binary()), "held": pa.array([part[at].tobytes()], pa.binary())}
            kinds = {"place": pa.int64(), "n": pa.int64()}
            names = [c.split()[0] for c in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([values.get(c, pa.nulls(1, kinds.get(c, pa.string()))) for c in names], names=names)


def _scan(size: int, least: int, longest: int, bits: int, chunk: int, frequent, buckets):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint8) if size < longest else None
        for words in _chunks(batches, chunk):
            n = len(words.hash) - size + 1
            if n <= 0:
                continue
            place = words.places(size, bits)
            good = words.piece[:n] == words.piece[size - 1 :]
            if size > 1:
                good &= _has(buckets.value, place)
                part = words.places(size - 1, bits)
                good &= _has(frequent.value, part[:n]) & _has(frequent.value, part[1 : n + 1])
            at = np.flatnonzero(good)
            if len(at):
                yield from _rows(words, at, size, place)
            if held is not None and n > 1:
                both = good[:-1] & good[1:] & (words.piece[: n - 1] == words.piece[size:])
                where, many = np.unique(words.places(size + 1, bits)[both], return_counts=True)
                held[where] = np.minimum(held[where] + many, least)
        if held is not None:
            yield from _cells(held)

    return scan


def _full(least: int):
    """Adds up the counts of blocks as they come; returns which buckets of a block hold at least ``least``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, held in zip(*batch.columns, strict=True):
                cells = total.setdefault(block.as_py(), np.zeros(1 << BLOCK, np.uint8))
                where = np.frombuffer(at.as_py(), "<u2")
                cells[where] = np.minimum(cells[where].astype(np.int64) + np.frombuffer(held.as_py(), np.uint8), least)
        for block, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(cells >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return add


def _bucket_bitmap(scanned: DataFrame, least: int, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 6), np.uint64)
    blocks = scanned.where("block is not null").select("block", "at", "held").repartition("block").mapInArrow(_full(least), "block int, bits binary")
    size = 1 << (BLOCK - 6)
    for row in blocks.toLocalIterator():  # 2**bits bits at most
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], "<u8")
    return out


def _place_bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """The places of ``phrases`` as bits, put together by the tasks: 2**bits bits at most."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = phrases.groupBy(F.shiftright("place", 6).alias("i")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("i").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def count_phrases(df: DataFrame, text: Column, lang: Column, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(totals: lang, n; phrases: lang, w1, w2, w3, n): all words of each language, and the exact counts of the phrases of
    1 to ``longest`` words (three at most) that occur ``least`` times or more (2 to 255)."""
    spark: SparkSession = df.sparkSession
    rows = df.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit(UNKNOWN)).alias("lang")).where("text <> ''")
    frequent = buckets = totals = None
    out = []
    for size in range(1, longest + 1):
        scanned = saved(rows.mapInArrow(_scan(size, least, longest, bits, chunk, frequent, buckets), ROWS))
        found = scanned.where("block is null")
        if size == 1:
            totals = saved(found.groupBy("lang").agg(F.sum("n").alias("n")))
        keys = ["lang", *(f"w{j}" for j in range(1, size + 1)), "place"]
        counts = saved(found.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        if size < longest:
            buckets = spark.sparkContext.broadcast(_bucket_bitmap(scanned, least, bits))
            frequent = spark.sparkContext.broadcast(_place_bitmap(counts, bits))
        dropped(scanned)
        out.append(counts.select("lang", *(F.col(f"w{j}") if j <= size else F.lit(None).cast("string").alias(f"w{j}") for j in (1, 2, 3)), "n"))
    phrases = out[0]
    for more in out[1:]:
        phrases = phrases.unionByName(more)
    return totals, phrases


def _with_score(df: DataFrame) -> DataFrame:
    """``score`` = floor(SCALE * a * a / (l * r)), divided as whole numbers of up to 38 digits; at most SCALE, since no part
    is rarer than the whole."""
    return df.withColumn("score", F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))


def mine_collocations(df: DataFrame, text: Column, lang: Column, least: int = LEAST, share: int = SHARE, top: int = TOP, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Each language's first ``top`` phrases of two or three words: lang, ``rank`` (from 1), ``phrase``, ``a`` (its
    occurrences), ``l`` and ``r`` (those of the two parts at its lowest-scoring cut), ``n`` (the language's words) and
    ``score``.

    Phrases that occur less than ``least`` times, and those of which ``share`` per cent or more lie in one longer phrase,
    don't count. ``bits`` (16 or more) and ``chunk`` decide about work, not results. Null and empty texts have no words, a null language is UNKNOWN. Repeated rows count each; ties are broken
    by ``a``, then the phrase in byte order. An empty table gives an empty result; only the two columns are read.
    """
    totals, phrases = count_phrases(df, text, lang, least, LONGEST, bits, chunk)
    part = lambda *names: phrases.where(F.col(f"w{len(names)}").isNotNull() & (F.col(f"w{len(names) + 1}").isNull() if len(names) < 3 else F.lit(True))).select("lang", *(F.col(f"w{i + 1}").alias(w) for i, w in enumerate(names)), "n")
    one = lambda w, name: part(w).withColumnRenamed("n", name)
    two = lambda v, w, name: part(v, w).withColumnRenamed("n", name)
    pairs = two("w1", "w2", "a").join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    pairs = _with_score(pairs).select("lang", "w1", "w2", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    triples = part("w1", "w2", "w3").withColumnRenamed("n", "a")
    triples = triples.join(one("w1", "l1"), ["lang", "w1"]).join(one("w3", "r2"), ["lang", "w3"]).join(two("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(two("w1", "w2", "l2"), ["lang", "w1", "w2"])
    for k in (1, 2):
        triples = _with_score(triples.withColumns({"l": F.col(f"l{k}"), "r": F.col(f"r{k}")})).withColumn(f"cut{k}", F.struct("score", F.lit(k).alias("k"), "l", "r"))
    triples = triples.withColumn("cut", F.least("cut1", "cut2"))
    triples = saved(triples.select("lang", "w1", "w2", "w3", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    # The most frequent longer phrase around each pair of words.
    around = triples.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    around = around.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    alone = pairs.join(around, ["lang", "w1", "w2"], "left").where((100 * F.coalesce("longer", F.lit(0)) < share * F.col("a")))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    every = alone.select(*columns).unionByName(triples.select(*columns))
    # The first of each of SALTS parts of a language, then the first of these: no task ranks a whole language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    every = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
