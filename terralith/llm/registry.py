"""Queries of the training-data operators over the driver's tables, with an SQL text where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import collocations, decontaminate, embedding_dedup, fingerprints, jaccard_join, license_scan, line_dedup, oracle_texts, packing, secret_scan, sharding, toxicity, url_filter, vector_codes
from terralith.llm.common import table

TOKENIZER = "word_bpe_49k.json"

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~toxicity.held_out(F.col("doc_id")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner; a language's part of a source for a repository."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, "doc_id", "text", F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES, "page_id", "url")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs, "doc_id", "text").withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return leaks.groupBy("doc_id", "item_id").agg(F.max("equal").alias("equal"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path: source, language, id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"), F.col("text"), F.col("lang"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op10_sharding": op10_sharding,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op1_embedding_near_dedup": oracle_texts.OP1,
    "op3_ngram_jaccard_join": oracle_texts.OP3,
    "op4_secret_scan": oracle_texts.OP4,
    "op11_phrase_collocations": oracle_texts.OP11,
    "op13_vector_codes": oracle_texts.op13(vector_codes.ROUNDS),
    "op7_decontamination": oracle_texts.op7(decontaminate.MASKS, decontaminate.SPAN, decontaminate.STRETCH, decontaminate.EQUAL),
    "op9_license_scan": oracle_texts.op9(license_scan.TEMPLATES, license_scan.THRESHOLD, license_scan.NOTICES, license_scan.FILE_NAME),
    "op5_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES
            ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        fitting AS (
            SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE k = 1
    """,
    "op6_line_dedup": r"""
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM split WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        blank AS (SELECT doc_id, pos, CASE WHEN trim(line, ' ') = '' THEN chr(0) ELSE line END AS line FROM line),
        win AS (
            SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win FROM blank
            WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        placed AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM win
            WHERE win IS NOT NULL AND win <> chr(0) || chr(10) || chr(0) || chr(10) || chr(0)),
        gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM placed, (VALUES (0), (1), (2)) t(o) WHERE k > 1),
        kept AS (
            SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
            FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL WHEN k.doc_id IS NULL THEN s.text ELSE coalesce(k.text, '') END AS text,
               coalesce(k.n_lines, 0)::INT AS n_lines, coalesce(k.n_removed, 0)::INT AS n_removed
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
    """,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
