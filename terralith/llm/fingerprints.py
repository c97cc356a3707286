"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text's tokens are its runs of other characters than white space, cut after TOKEN characters.  Its k-mers are its runs of
K tokens, numbered by occurrence: the second place of a k-mer is another element than the first.  An element's hash is its
point on a ring of 64-bit numbers, and entry i of the signature takes the TUPLE elements that follow point i on the ring
(the least ones under the order that begins there), puts them in the order of the text and hashes their k-mers as a tuple.
Two texts agree in an entry if they share these elements in the same order, so moved passages count as well as changed
ones.  The elements are sorted once for all entries; an entry is a binary search.

A text is compared with the next document and with an edited text made of both, so every text has to meet the next one:
documents are dealt into ranges of (id, hash of the text), whose first keys are found on the keys alone; the first rows of
a range are also sent to the range before, as the successors of its last rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import saved
from terralith.llm.line_dedup import let

TOKEN = 16  # characters
K = 3  # tokens
TUPLE = 2  # elements
ENTRIES = 64
ROWS_PER_RANGE = 500
MOST_RANGES = 65_536
NOTHING = 0  # the hash of an empty tuple


def _steps(size: Column) -> Column:
    """The powers of two up to ``size``, falling."""
    return F.filter(F.array(*(F.lit(1 << b) for b in range(30, -1, -1))), lambda x: x <= size)


def _count(steps: Column, size: Column, before) -> Column:
    """How many of ``size`` sorted items come ``before`` (a test of an index that is true up to some item), by halving."""
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= size) & before(at + s - 1), at + s).otherwise(at))


def _elements(text: Column) -> Column:
    """The elements sorted by their hashes: (hash, pos, kmer)."""
    tokens = F.regexp_extract_all(text, F.lit(rf"[^\s]{{1,{TOKEN}}}"), 0)
    kmer = lambda t, i: F.struct(F.xxhash64(*(F.get(t, i + j) for j in range(K))).alias("kmer"), i.alias("pos"))
    sorted_kmers = lambda t: F.when(F.size(t) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - K, F.lit(0))), lambda i: kmer(t, i))))

    def nth(s: Column, x: Column, i: Column) -> Column:
        """How many equal k-mers come before the one at place i of the sorted ones."""
        repeated = (i > 0) & (F.get(s, i - 1)["kmer"] == x["kmer"])
        return F.when(repeated, i - _count(_steps(i), i, lambda at: F.get(s, at)["kmer"] < x["kmer"])).otherwise(0)

    return let(let(tokens, sorted_kmers), lambda s: F.sort_array(F.transform(s, lambda x, i: F.struct(F.xxhash64(x["kmer"], nth(s, x, i)).alias("hash"), x["pos"].alias("pos"), x["kmer"].alias("kmer")))))


def signature(text: Column) -> Column:
    """ENTRIES 32-bit numbers. A text of fewer than K tokens is one k-mer; a text without tokens has NOTHING in every entry;
    with fewer than TUPLE elements an entry takes all there are."""
    points = F.array(*(F.lit(i * 2**64 // ENTRIES - 2**63) for i in range(ENTRIES)))

    def entry(e: Column, steps: Column, point: Column) -> Column:
        n = F.size(e)
        first = _count(steps, n, lambda at: F.get(e, at)["hash"] < point)
        chosen = lambda at: F.transform(F.sequence(F.lit(0), F.least(n, F.lit(TUPLE)) - 1), lambda j: F.get(e, (at + j) % n))
        ordered = F.sort_array(F.transform(let(first, chosen), lambda x: F.struct(x["pos"].alias("pos"), x["kmer"].alias("kmer"))))
        return F.shiftright(F.aggregate(ordered, F.lit(NOTHING).cast("bigint"), lambda h, x: F.xxhash64(h, x["kmer"])), 32).cast("int")

    every = lambda e: let(_steps(F.size(e)), lambda steps: F.transform(points, lambda p: entry(e, steps, p)))
    return let(_elements(text), lambda e: F.when(e.isNull(), F.array_repeat(F.lit(NOTHING), ENTRIES)).otherwise(every(e)))


def as_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(ENTRIES))


def _ranges(keys: DataFrame) -> list:
    """The least (id, h) of each range, in order: MOST_RANGES rows at most."""
    ranges = max(1, min(MOST_RANGES, -(-keys.count() // ROWS_PER_RANGE)))
    firsts = keys.repartitionByRange(ranges, "id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "h")).alias("k"))
    return [r["k"] for r in firsts.orderBy("k").collect()]


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, sig, next_text, next_sig): each text and the next one's, by ascending (id, hash of the text); the last one's
    next is the first. Texts are shuffled once."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    firsts = _ranges(saved(rows.select("id", "h")))
    held = spark.createDataFrame([(firsts,)], f"f array<struct<id:{kind},h:bigint>>").select(F.to_json("f", {"ignoreNullFields": "false"})).first()[0]
    held, key = F.from_json(F.lit(held), f"array<struct<id:{kind},h:bigint>>"), F.struct("id", "h")  # one constant for all rows
    n = F.lit(len(firsts))
    own = let(held, lambda f: _count(F.array(*(F.lit(1 << b) for b in range(len(firsts).bit_length(), -1, -1))), n, lambda at: F.get(f, at) <= key) - 1)
    placed = rows.withColumn("own", own)
    is_first = let(held, lambda f: F.get(f, F.col("own")) == key)
    copies = F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("copy")), F.when(is_first, F.struct(F.pmod(F.col("own") - 1, n).cast("int").alias("range"), F.lit(1).alias("copy"))))
    dealt = placed.withColumn("sig", signature(F.col("text"))).withColumn("to", F.explode(F.array_compact(copies))).select("id", "h", "text", "sig", "to.*")
    order = Window.partitionBy("range").orderBy("copy", "id", "h")
    met = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sig": F.lead("sig").over(order)})
    return met.where("copy = 0").select("id", "text", "sig", "next_text", "next_sig")


def fingerprint_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.

    The edited text is the text with its last half (rounded down) replaced by as much of the beginning of the next document
    (or all of it), by ascending id; the last document's next is the first, a lone document's itself. Null texts are
    empty; null ids come first, rows of one id in the order of a hash of their texts, and repeated rows are documents each.
    An empty table gives an empty result; other columns aren't read.
    """
    n = F.length("text").cast("bigint")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring("next_text", 1, half))
    out = with_next(df, id_col, text_col).withColumn("edited", edited).withColumn("edited_sig", signature(F.col("edited")))
    return out.select(
        F.col("id").alias(id_col), n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
