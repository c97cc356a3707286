"""Fingerprints against the same rule in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("terralith.llm")

from terralith.llm import fingerprints
from terralith.llm.fingerprints import ENTRIES, K, TOKEN, TUPLE

DOCS = "doc_id bigint, text string"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(*values):
    """xxhash64 of strings, 64-bit and 32-bit numbers one after the other."""
    h = 42
    for v, size in values:
        data = v.encode() if size is None else (v % 2 ** (8 * size)).to_bytes(size, "little")
        h = xxhash.xxh64(data, seed=h).intdigest()
    return signed(h)


def brute_signature(text):
    tokens = re.findall(rf"[^ \t\n\x0b\x0c\r]{{1,{TOKEN}}}", text)
    seen, elements = Counter(), []
    for pos in range(max(1, len(tokens) - K + 1) if tokens else 0):
        kmer = chained(*((t, None) for t in tokens[pos : pos + K]))
        elements.append((chained((kmer, 8), (seen[kmer], 4)), pos, kmer))
        seen[kmer] += 1
    elements.sort()
    out = []
    for i in range(ENTRIES):
        point = i * 2**64 // ENTRIES - 2**63
        first = sum(e[0] < point for e in elements)
        h = 0
        for _, kmer in sorted((elements[(first + j) % len(elements)][1:] for j in range(min(TUPLE, len(elements)))) if elements else []):
            h = chained((h, 8), (kmer, 8))
        out.append(f"{h >> 32 & 0xFFFFFFFF:08x}")
    return out


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, chained((r[1] or "", None)))
    rows = sorted(rows, key=key)
    texts = [r[1] or "" for r in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e, n = brute_signature(text), brute_signature(edited), brute_signature(after)
        like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / ENTRIES
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(s), "".join(e), like(s, e), like(s, n)))
    return sorted(out, key=str)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "δελτα", "日本語", "🙂"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(1, None), (2, ""), (3, "one"), (4, "one two"), (5, "a b c a b c a b c"), (6, "x" * 200), (7, " \n\t"), (8, "a " * 3000), (9, sentence(rng, 2000)), (None, "first of all"), (None, "and the second"), (12, "same text here"), (12, "same text here"), (12, "other text of one id"), (13, "same text here")]
    return out + [(100 + 3 * i, sentence(rng, rng.randrange(1, 80))) for i in range(120)]


@pytest.mark.parametrize("size", [500, 7, 1])
def test_fingerprints_match_brute_force(spark, rows, monkeypatch, size):
    """In one range, in ranges of a few documents, and with a range for almost every one."""
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", size)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("id", "h", "own", "copy", "range", "sig", "next_text")}).repartition(3)
    out = fingerprints.fingerprint_documents(df, "doc_id", "text")
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_lone_documents_and_none(spark):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(7, "a b c d")], DOCS), "doc_id", "text").collect()
    assert [tuple(r) for r in one] == brute([(7, "a b c d")]) and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "k l m"), (None, "o p q")], "name string, text string")
    assert {r["name"]: r["n_chars"] for r in fingerprints.fingerprint_documents(named, "name", "text").collect()} == {"a": 5, "b": 5, None: 5}


def test_order_counts():
    """The same k-mers in another order are less alike than in the same order; fewer edits are more alike."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    like = lambda a, b: sum(x == y for x, y in zip(brute_signature(" ".join(a)), brute_signature(" ".join(b)), strict=True)) / ENTRIES
    moved = [w for i in range(540, -1, -60) for w in words[i : i + 60]]
    few, many = list(words), list(words)
    for k, edited in ((6, few), (60, many)):
        for i in rng.sample(range(600), k):
            edited[i] = "new"
    assert like(words, words) == 1 and like(words, few) > 0.75 > like(words, many) > 0.1
    assert 0 < like(words, moved) < 0.3  # two places of different blocks have changed their order
