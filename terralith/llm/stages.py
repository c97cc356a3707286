"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir), documents in and out.

What holds for all of them: null and empty texts are kept (only line dedup drops a document, and only one that it has
emptied), rows that repeat an id and a text share their fate, rows of one id with other texts are told apart by a hash of
the text, an empty table gives an empty one, and further columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from terralith.llm.common import fresh, saved, table
from terralith.llm.registry import tokenizer_path


def _without(docs: DataFrame, gone: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """``docs`` without the rows whose id and text's hash are in ``gone``."""
    a, b = fresh(docs, "id", "hash")
    gone = gone.select(F.col(id_col).alias(a), F.col(hash_col).alias(b)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b)), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity rejects go, those without an id too. Null and empty texts score like texts without a telling
    term and stay."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~toxicity.held_out(F.col("doc_id")), with_hash=True)
    return _without(docs, scored.where("predicted = 1"), "doc_id", "text_hash")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and passages go, and with them documents of which nothing but blanks is left. Of equal passages the
    one of the smallest id stays. ``n_chars`` follows the text where it has changed; rows without an id stay as they are."""
    count = fresh(docs, "n_removed")[0]
    kept = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    held = {c: f"{count}{i}" for i, c in enumerate(("_n_lines", "_n_removed")) if c in docs.columns}  # what the operator would write over
    out = line_dedup.remove_repeated_passages(docs.withColumnsRenamed(held), "doc_id", "text")
    out = out.where((F.col("_n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    changed = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(changed.alias(c) if c == "n_chars" else F.col(f"`{held.get(c, c)}`").alias(c) for c in [*kept, *held])).select(*(f"`{c}`" for c in docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id (of one id's texts, the smallest hash). Texts
    without words are no copies of one another; a row without an id goes if a document with one stands for it."""
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text_hash"))).alias("key"), "text")
    found = jaccard_join.jaccard_components(keyed, "key", "text")
    gone = found.where("component_id is not null and component_id <> key").select("key.doc_id", "key.text_hash")
    return _without(docs, gone, "doc_id", "text_hash")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, those without an id too."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences. A null or empty text is one piece of the closing id; rows without an
    id and repeated rows are packed each."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
