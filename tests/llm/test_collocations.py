"""Collocations against counts in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terralith.llm")

from terralith.llm import collocations

DOCS = "doc_id bigint, text string, lang string"


def brute(rows, least, share, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, out = {}, []
    for _, text, lang in rows:
        held = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                held.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, held in counts.items():
        n = sum(v for p, v in held.items() if len(p) == 1)
        found = []
        for p, a in held.items():
            if len(p) == 1 or a < least:
                continue
            longer = [p[:0]] if len(p) == 3 else [q for q in held if len(q) == 3 and held[q] >= least and p in (q[:2], q[1:]) and 100 * held[q] >= share * a]
            if len(p) == 2 and longer:
                continue
            score, _, left, right = min((collocations.SCALE * a * a // (held[p[:k]] * held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "York", "city", "été", "naïve", "x", "state-of", " gap", "ΣΑΣ", "日本"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(240):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(words + ["New York city"] * 8 + ["of the state-of"] * 4) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"])
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", "und", None])))
    return rows + [(900, None, "en"), (901, "", None), (902, " .\n, ", "xx"), (None, "New York city", "en"), rows[5], rows[5]]


@pytest.mark.parametrize("bits", [26, 17])
def test_collocations_match_brute_force(spark, bits):
    """With few buckets most places are shared; the counts stay the same."""
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("w1", "n", "place", "salt", "rank", "a", "block")}).repartition(3)
    for least, share, top in ((10, 50, 2000), (3, 80, 7)):
        got = [tuple(r) for r in collocations.mine_collocations(df, F.col("text"), F.col("lang"), least, share, top, bits, 2000).collect()]
        want = brute(rows, least, share, top)
        assert sorted(got) == want and len(want) > 15


def test_scores_beyond_64_bits(spark):
    a, left, right = 2 * 10**12 + 7, 3 * 10**12 + 1, 9 * 10**12
    row = collocations._with_score(spark.createDataFrame([(a, left, right), (5, 5, 5)], "a long, l long, r long")).collect()
    assert [r["score"] for r in row] == [collocations.SCALE * a * a // (left * right), collocations.SCALE]


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    out = collocations.mine_collocations(df, F.col("text"), F.col("lang"))
    assert out.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")] and out.count() == 0


def test_long_text_in_chunks():
    """A text over many spans of bytes gives the words and phrases of the whole."""
    rng = np.random.RandomState(1)
    words = [f"v{i}" for i in rng.randint(0, 500, 400_000)]
    made = collocations._Words([" ".join(words).encode(), b"", b"a b"], ["en", "en", "fr"])
    at, n = made.counted(np.arange(len(made.hash) - 1), 2)
    text = made.strings(at).to_pylist()
    want = Counter(zip([*words, "a", "b"][:-1], [*words, "a", "b"][1:], strict=True))
    assert Counter(dict(zip(zip(text, made.strings(at + 1).to_pylist(), strict=True), n.tolist(), strict=True))) == want
    assert made.piece[-2] > made.piece[-3] and made.langs[made.lang[-1]] == "fr"


def test_rows_leave_a_task_in_small_batches():
    """A chunk with many different phrases isn't handed over whole, and nothing gets lost between batches."""
    import pyarrow as pa

    words = [f"v{i}" for i in range(100_000)]
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(words), "v7 v8"]), pa.array(["en", "en"])], names=["text", "lang"])
    found = [b for b in collocations._scan(1, 10, 3, 17, collocations.CHUNK, None, None)(iter([texts])) if b.column(7)[0].as_py() is None and b.column(5)[0].as_py()]
    assert max(b.num_rows for b in found) <= 1 << 15 and max(b.nbytes for b in found) < 4e6
    got = Counter()
    for b in found:
        got.update(dict(zip(b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True)))
    assert got == Counter([*words, "v7", "v8"])
