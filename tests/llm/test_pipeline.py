"""Every stage of the pipeline against brute force on a small table."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terralith.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from terralith.llm import registry

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return [rng.choice(["stone", "river", "cloud", "ember", "field", "grove"]) + rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n)]


def lines(tokens, n=8):
    return "\n".join(" ".join(tokens[i : i + n]) for i in range(0, len(tokens), n))


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        t = words(rng, 50)
        if i % 6 == 0:
            t[5], t[30] = "grumblefool", "wretchling"
        rows.append((i, lines(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = lines(words(rng, 32))
    item = words(rng, 30)
    base = words(rng, 60)
    rows += [(300 + k, lines(words(rng, 24)) + "\n" + passage + "\n" + lines(words(rng, 24))) for k in range(4)]
    rows += [(400 + k, " ".join(base[: 60 - k])) for k in range(4)]
    rows += [(500, lines(words(rng, 20)) + "\n" + " ".join(item) + "\n" + lines(words(rng, 20))), (600, rows[1][1]), (601, ""), (602, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    text = {n: {r["doc_id"]: r["text"] for r in rows_} for n, rows_ in seen.items() if n != "best_fit_packing"}
    assert all(seen[n][0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} for n in text)

    assert set(text["toxicity"]) == {i for i, _ in rows if not (i < 240 and i % 6 == 0)}

    first, want = set(), {}
    for i, t in sorted(text["toxicity"].items()):
        split = [] if t is None else t.split("\n")
        gone = set()
        for k in range(len(split) - 2):
            w = tuple(split[k : k + 3])
            if w in first and any(w):
                gone |= {k, k + 1, k + 2}
            first.add(w)
        left = "\n".join(x for k, x in enumerate(split) if k not in gone)
        if not gone or left.strip():
            want[i] = None if t is None else left
    assert text["line_dedup"] == want and 600 not in want

    sets = {i: shingles(t or "") for i, t in want.items()}
    parent = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] | sets[b])
        if both and 100 * len(sets[a] & sets[b]) >= 80 * both:
            parent[b] = min(parent[b], parent[a])
    assert set(text["ngram_jaccard_join"]) == {i for i in sets if parent[i] == i} and 400 in text["ngram_jaccard_join"] and 401 not in text["ngram_jaccard_join"]

    assert set(text["ngram_jaccard_join"]) - set(text["decontamination"]) == {500}

    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(registry.tokenizer_path())
    total = {i: len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in text["decontamination"].items()}
    packed = seen["best_fit_packing"]
    assert {r["doc_id"]: r["length"] for r in packed} == total
    assert len({r["sequence_id"] for r in packed}) == -(-sum(total.values()) // 4096)
    assert np.all(np.array([r["offset"] + r["length"] for r in packed]) <= 4096)


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    """A toxic row and a near duplicate don't take a clean row of the same id with them."""
    rng = random.Random(14)
    texts = {i: " ".join([*words(rng, 30), *(["grumblefool"] if i % 6 == 0 else [])]) for i in range(120)}
    clean, copy = " ".join(words(rng, 30)), " ".join(words(rng, 30))
    rows = [*texts.items(), (6, clean), (7, texts[1]), (8, copy)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120) if i != 6], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    left = {(r["doc_id"], r["text"]) for r in stage["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert left == {(i, t) for i, t in rows if "grumblefool" not in t}
    kept = {(r["doc_id"], r["text"]) for r in stage["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()}
    assert kept == set(rows) - {(7, texts[1])}


def test_stages_of_nothing_and_of_clashing_names(spark, tmp_path):
    """Empty tables, null ids and texts, very long texts, and further columns with the names that operators use."""
    rng = random.Random(15)
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = words(rng, 30)
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = lines(words(rng, 60_000))
    rows = [(i, " ".join([*words(rng, 30), *(["grumblefool"] if i % 6 == 0 else [])])) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "no id here at all"), (None, None), (72, long), (73, long), (74, long + "\n" + " ".join(item))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    extra = ["_id", "_hash", "hash", "id", "key", "node", "_n_lines", "_n_removed", "item_id", "predicted", "_leak_id", "window"]
    docs = docs.withColumns({c: F.lit("x") for c in extra})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in got} == {i for i, _ in rows} and sum(r["doc_id"] is None for r in got) == 2
            continue
        assert out.columns == docs.columns and all(r[c] == "x" for r in got for c in extra)
        kept = [r["doc_id"] for r in got]
        gone = {"toxicity": set(range(0, 60, 6)), "line_dedup": {73}, "ngram_jaccard_join": {73, 74}, "decontamination": {74}}[name]
        assert sorted(map(str, kept)) == sorted(str(i) for i, _ in rows if i not in gone), name


def test_line_stage_keeps_texts_with_blank_lines(spark):
    texts = {1: "\nalpha\nbeta\n", 2: "intro\n\nOnly once\n\n\nend", 3: "gamma\n\ndelta", 4: "x\ngamma\ndelta\n\ny"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    assert {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()} == texts
