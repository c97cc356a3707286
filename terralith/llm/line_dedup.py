"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines are hashed as a window, by two hashes of 96 bits together (so chance hits stay away at any
size of the corpus).  A window that occurs more than once in the corpus is kept where
it occurs first (smallest id, then smallest line) and covers its three lines everywhere else; the union of covered
lines of a document is removed.  The windows are counted with partial aggregation (a window that fills a third of the
corpus is one row per task by then), and only the windows with a count over one meet the others in a join.  The covered lines
grow with the corpus, so they meet the texts in a shuffle at any size.

A blank line has a fixed value of its own within a window, so the place of a blank tells windows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import fresh, passing, saved

WINDOW = 3
LONG = 200  # characters of a line over which remove_repeated_passages cuts it at sentence ends
MARK = "\u0001"  # stands for the blank of a cut
BLANK = 0  # both hashes of a blank line


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(text: Column, size: int, same=lambda x: x) -> Column:
    """(pos, window, proof) of every ``size`` consecutive lines of which one at least isn't blank: two hashes; ``same``
    gives what is compared."""
    hashes = F.transform(_lines(text), lambda x: let(same(x), lambda y: F.when(F.trim(y) != "", F.struct(F.xxhash64(y).alias("a"), F.hash(y).alias("b")))))
    at = lambda h, i: [h[i + k] for k in range(size)]
    some = lambda h, i: F.coalesce(*at(h, i)).isNotNull()
    value = lambda h, i, c: [F.coalesce(x[c], F.lit(BLANK)) for x in at(h, i)]  # noqa: E731  Spark's hashes would skip a null and with it the blank's place
    window = lambda h, i: F.struct(i.alias("pos"), F.xxhash64(*value(h, i, "a")).alias("window"), F.hash(*value(h, i, "b")).alias("proof"))
    every = let(hashes, lambda h: F.when(F.size(h) >= size, F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - size), lambda i: some(h, i)), lambda i: window(h, i))))
    return F.coalesce(every, F.array().cast("array<struct<pos:int,window:bigint,proof:int>>"))


def remove_repeated_lines(df: DataFrame, id_col: str, text_col: str, size: int = WINDOW, same=lambda x: x) -> DataFrame:
    """``df`` with the repeated lines taken out of its text, and ``_n_lines`` and ``_n_removed`` added (in place of
    columns of these names).

    Null texts stay null, texts of fewer than ``size`` lines stay whole, and so do rows without an id. Blank lines count
    as equal; windows of blank lines only don't count. Rows that repeat an id and a text are one document and change
    alike. If all lines go, the text is empty. Other columns are passed on as they are, whatever their names. ``same``
    gives what is compared of a line.
    """
    own, gone_lines = fresh(df, "hash", "gone")
    key = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash")]
    sound = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()
    with passing() as keep:
        each = df.where(sound).select(*key, F.explode(_windows(F.col(f"`{text_col}`"), size, same)).alias("w"))
        each = saved(each.select("id", "hash", "w.*"))
        place = F.struct("id", "hash", "pos")
        first = each.groupBy("window", "proof").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("window", "proof", "first")
        first = saved(first)  # a table of its own, so that Spark can split a window that fills much of the other side
        later = each.join(first, ["window", "proof"]).where(place != F.col("first"))
        spread = later.select("id", "hash", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: k + F.col("pos"))).alias("line"))
        gone = keep(saved(spread.groupBy("id", "hash").agg(F.collect_set("line").alias(gone_lines)).withColumnsRenamed({"id": (there := fresh(df, "id")[0]), "hash": own})))
    text = F.col(f"`{text_col}`")
    lines = _lines(text)
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone_lines)), lambda i: x[i]), "\n"))
    out = df.join(gone.hint("merge"), (F.col(f"`{id_col}`") == F.col(there)) & (F.xxhash64(text) == F.col(own)), "left")
    return out.select(
        *(F.when(F.col(gone_lines).isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c not in ("_n_lines", "_n_removed")),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("_n_lines"),
        F.coalesce(F.size(gone_lines), F.lit(0)).alias("_n_removed"),
    )


def remove_repeated_passages(df: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """The same with lines of more than ``LONG`` characters cut after sentence ends, so that passages within a line count.

    What stays is joined as it was; pieces compare without the blanks around them. ``_n_lines`` and ``_n_removed`` count
    pieces. Texts that hold ``MARK`` aren't cut.
    """
    ends = lambda x: F.when(F.length(x) > LONG, F.regexp_replace(x, "(?<=[.!?\u2026\u3002]) ", f"\n{MARK}")).otherwise(x)
    given = F.col(f"`{text_col}`")
    whole = given.contains(MARK)
    cut = F.when(whole, given).otherwise(F.array_join(F.transform(_lines(given), ends), "\n"))
    flag = fresh(df, "whole")[0]
    out = remove_repeated_lines(df.withColumns({text_col: cut, flag: whole}), id_col, text_col, size, lambda x: F.trim(F.translate(x, MARK, "")))
    text = F.regexp_replace(F.regexp_replace(given, f"^{MARK}", ""), f"\n{MARK}", " ")
    return out.withColumn(text_col, F.when(F.col(flag), given).otherwise(text)).drop(flag)
