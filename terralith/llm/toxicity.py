"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with distance-weighted, calibrated votes.

1. A bounded sample of the labelled rows, ``MOST_EXAMPLES`` of each class in the order of a hash, is the classifier's
   memory; near copies in it count as one (candidates by equal least hashes of long words, verified by the shares of
   words that they have in common).  All beginnings of words (``SIZES`` letters) and all shorter and longer words as a
   whole that are significantly (chi-squared) and several times commoner in its toxic texts are the terms.  Beginnings,
   since languages compound and inflect.
2. One pass over all whole texts counts their terms; document frequencies come from all texts.
3. The examples' vectors go into an inverted index with block maxima: examples lie in blocks of like ones, each term has
   its largest weight per block, and a query opens blocks from the highest bound down until no bound reaches its k-th
   best cosine.  The neighbours are exact.
4. The votes weigh 1 / (distance + EASE) and make up for the classes' different shares in the sample; the votes of
   the examples themselves, each without its own, fit a monotone map from votes to shares of toxic texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import saved

MOST_EXAMPLES = 4096  # of each class
SIZES = range(4, 10)
LEAST_CHI2, LEAST_LIFT = 24.0, 3.0
LONG = 7  # letters of the words by which copies are looked for
COPY = 0.5  # of two texts' words in common: copies
NEIGHBOURS = 15
EASE = 0.1
PRIOR = 0.5  # weight of the base rate among the votes
BLOCK = 64
CUT = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def beginnings(text: str | None) -> set[str]:
    """The first letters of a text's words, lower-cased; words of other lengths than ``SIZES`` whole, with a blank after."""
    words = set(_WORD.findall((text or "").lower()))
    return {w[:n] for w in words for n in SIZES if n <= len(w)} | {w + " " for w in words if len(w) not in SIZES}


def copy_key(text: str | None) -> str | None:
    """Equal for most near copies, different for most other texts; null for a text without long words."""
    long = {w for w in _WORD.findall((text or "").lower()) if len(w) >= LONG}
    return "/".join(min(hashlib.blake2b(w.encode(), digest_size=8, salt=bytes([k])).hexdigest() for w in long) for k in (1, 2)) if long else None


def counter(terms: list[str]):
    """A function from a text to its (term, count) pairs."""
    import ahocorasick

    find = ahocorasick.Automaton()
    words = [t.rstrip(" ") for t in terms]
    for i, w in enumerate(words):
        find.add_word(w, i)
    if terms:
        find.make_automaton()

    def count(text: str | None) -> list[tuple[int, int]]:
        text = (text or "").lower()
        if not terms:
            return []
        starts = lambda end, i: (at := end - len(words[i])) < 0 or not text[at].isalpha()
        ends = lambda end, i: words[i] == terms[i] or end + 1 == len(text) or not text[end + 1].isalpha()
        return sorted(Counter(i for end, i in find.iter(text) if starts(end, i) and ends(end, i)).items())

    return count


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Rows:
    """Sparse rows of numbers: memory goes with the numbers over 0, not with the terms."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> None:
        self.start = np.cumsum([0, *(len(a) for a, _ in parts)])
        self.terms = np.concatenate([np.zeros(0, np.int32), *(a for a, _ in parts)]).astype(np.int32)
        self.values = np.concatenate([np.zeros(0), *(x for _, x in parts)])
        self.width = width

    def __len__(self) -> int:
        return len(self.start) - 1

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.start[i] : self.start[i + 1]], self.values[self.start[i] : self.start[i + 1]]

    def dense(self, i: int) -> np.ndarray:
        row = np.zeros(self.width)
        at, x = self.part(i)
        row[at] = x
        return row

    def times(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The products of the rows ``at`` with ``query``."""
        n = self.start[at + 1] - self.start[at]
        places = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(np.arange(len(at)), n), self.values[places] * query[self.terms[places]], len(at))

    def __matmul__(self, query: np.ndarray) -> np.ndarray:
        return self.times(np.arange(len(self)), query)


def sparse(vectors: np.ndarray) -> Rows:
    return Rows([(at := np.flatnonzero(v), v[at]) for v in vectors], vectors.shape[1])


class BlockMaxIndex:
    """Exact nearest examples by cosine. ``vectors``: unit rows (or rows of zeros), an array or ``Rows``."""

    def __init__(self, vectors: np.ndarray | Rows, labels: np.ndarray, names: np.ndarray, share: np.ndarray) -> None:
        self.neighbours = NEIGHBOURS
        given = vectors if isinstance(vectors, Rows) else sparse(vectors)
        parts = [given.part(i) for i in range(len(given))]
        heaviest = np.array([at[np.argmax(x)] if len(at) else 0 for at, x in parts])
        order = np.lexsort((names, heaviest, -np.diff(given.start)))
        self.labels, self.names, self.share = labels[order], names[order], share[order]
        self.vectors = Rows([parts[i] for i in order], given.width)
        # Each term's largest weight per block, as a list of blocks for every term.
        blocks = np.repeat(np.arange(len(order)) // BLOCK, np.diff(self.vectors.start))
        key, inverse = np.unique(self.vectors.terms.astype(np.int64) * (len(order) + 1) + blocks, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, inverse, self.vectors.values)
        term, block = np.divmod(key, len(order) + 1)
        edge = np.searchsorted(term, np.arange(given.width + 1))
        self.most = Rows([], -(-len(order) // BLOCK))
        self.most.start, self.most.terms, self.most.values = edge, block.astype(np.int32), most

    def nearest(self, query: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest with a cosine over 0, the row ``without`` left out. Among equal cosines
        those stay that come first in the order of their blocks' bounds; blocks are opened one, two, four, ... at a time."""
        terms = np.flatnonzero(query)
        bound = np.zeros(self.most.width)
        for t in terms.tolist():
            blocks, most = self.most.part(t)
            bound[blocks] += most * query[t]
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        rows, near, done, many = np.zeros(0, np.int64), np.zeros(0), 0, 1
        while done < len(order) and (len(near) < k or bound[order[done]] > near[-1] + 1e-12):
            at = (order[done : done + many, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < len(self.vectors)]
            score = self.vectors.times(at, query)
            good = (score > 0) & (at != without)
            rows, near = np.concatenate((rows, at[good])), np.concatenate((near, score[good]))
            best = np.argsort(-near, kind="stable")[:k]
            rows, near = rows[best], near[best]
            done, many = done + many, many * 2
        return rows, near

    def vote(self, query: np.ndarray, base: float, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        rows, near = self.nearest(query, self.neighbours, without)
        w = self.share[rows] / (1 - np.minimum(near, 1) + EASE)
        return round(float((w @ self.labels[rows] + PRIOR * base) / (w.sum() + PRIOR)), 9), rows, near  # equal votes stay equal


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing step function of x nearest to y (pool adjacent violators): right ends and levels."""
    ends, inverse = np.unique(x, return_inverse=True)
    weight, total = np.bincount(inverse, w), np.bincount(inverse, w * y)
    pools: list[list[float]] = []
    for e, a, t in zip(ends.tolist(), weight.tolist(), total.tolist(), strict=True):
        pools.append([e, a, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            e, a, t = pools.pop()
            pools[-1] = [e, pools[-1][1] + a, pools[-1][2] + t]
    return np.array([p[0] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([copy_key(t.as_py()) for t in batch.column(2)], pa.string())], names=[*batch.schema.names, "copy"])


def _without_copies(group: pa.Table) -> pa.Table:
    """The rows, in the order of their ids, that share less than COPY of their words with every row kept before."""
    group = group.sort_by("id")
    kept: list[tuple[int, set[str]]] = []
    for i, t in enumerate(group.column("text").to_pylist()):
        words = set(_WORD.findall((t or "").lower()))
        if not any(len(words & w) >= COPY * len(words | w) for _, w in kept):
            kept.append((i, words))
    return group.take([i for i, _ in kept])


def _beginning_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, toxic = Counter(), Counter()
        for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = beginnings(t.as_py())
            every.update(found)
            if y:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([toxic[t] for t in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["term", "a", "ab"])


def _telling_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    counts = sample.select("text", "toxic").mapInArrow(_beginning_counts, "term string, a bigint, ab bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("ab").alias("ab"))
    a, b = F.col("a").cast("double"), (F.col("ab") - F.col("a")).cast("double")
    c, d = F.lit(float(n_toxic)) - a, F.lit(float(n_clean)) - b
    n = float(n_toxic + n_clean)
    chi2 = n * (a * d - b * c) * (a * d - b * c) / (F.greatest(F.lit(1.0), (a + b) * (c + d)) * F.lit(float(n_toxic) * n_clean))
    telling = counts.withColumn("chi2", chi2).where((F.col("chi2") >= LEAST_CHI2) & (a * (n_clean + 1) >= LEAST_LIFT * n_toxic * (b + 0.5)))
    found = {r["term"]: (r["a"], r["ab"]) for r in telling.select("term", "a", "ab").collect()}  # no more than the sample's terms
    # Of nested beginnings in the same texts the shortest: it meets every word that the others meet.
    return sorted(t for t, n in found.items() if not any(found.get(t[:k]) == n for k in SIZES if k < len(t)))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, with_hash: bool = False) -> DataFrame:
    """One row per row of ``df``: id, ``score`` (0 to 1), ``predicted`` (1 if the score is ``CUT`` or more), and
    ``evidence`` (the nearest examples as id:cosine).

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1); only those for which ``train`` holds are learnt from; labels of
    one id that differ count as 1. Null and empty texts, and texts without a telling term, get the rate of toxic texts
    among such examples. Without any label of a class the score is 0. Repeated rows get equal scores, an empty table an
    empty result; other columns aren't read. Of several texts of a labelled id, the one with the least hash is the
    example. ``with_hash`` adds ``text_hash``, which tells rows of one id apart.
    """
    spark = df.sparkSession
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train)
    usable = saved(usable.groupBy(id_col).agg(F.max(F.col(label_col)).cast("long").alias("toxic")))
    share = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    of = lambda y: usable.where(F.col("toxic") == y).orderBy(F.xxhash64(id_col), id_col).limit(MOST_EXAMPLES)
    chosen = saved(of(1).unionByName(of(0)).select(F.col(id_col).alias("id"), "toxic"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = df.schema[id_col].dataType.simpleString()
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text_hash", "toxic", "text")).alias("s"))  # at most 2 * MOST_EXAMPLES rows
    sample = sample.select("id", "s.toxic", "s.text", "s.text_hash").mapInArrow(_keyed, f"id {kind}, toxic bigint, text string, text_hash bigint, copy string")
    keyed = sample.withColumn("copy", F.coalesce("copy", F.concat(F.lit("id "), F.col("id").cast("string"))))
    sample = saved(keyed.groupBy("toxic", "copy").applyInArrow(_without_copies, keyed.schema).drop("copy"))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    terms = _telling_terms(sample, n.get(1, 0), n.get(0, 0)) if n.get(1) and n.get(0) else []

    extra = ["text_hash"] if with_hash else []
    hashed = ", text_hash bigint" if with_hash else ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = counter(terms)
        for batch in batches:
            found = [terms_of(t.as_py()) for t in batch.column(1)]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[i for i, _ in f] for f in found], lists), pa.array([[n for _, n in f] for f in found], lists), batch.column(2)], names=["id", "terms", "tf", "text_hash"])

    counted = saved(rows.mapInArrow(count, f"id {kind}, terms array<int>, tf array<int>, text_hash bigint"))
    total = counted.count()
    frequency = np.zeros(len(terms))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row per term
        frequency[r["t"]] = r["n"]
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def weights(at: list[int], tf: list[int]) -> np.ndarray:
        v = (1 + np.log(np.array(tf, float))) * idf[np.array(at, np.int64)]
        return v / np.sqrt(v @ v) if at else np.zeros(0)

    def vector(at: list[int], tf: list[int]) -> np.ndarray:
        v = np.zeros(len(idf))
        v[np.array(at, np.int64)] = weights(at, tf)
        return v

    known = sample.select(F.col("id").alias("own"), F.col("text_hash").alias("own_hash"), "toxic")  # at most 2 * MOST_EXAMPLES rows without texts
    held = counted.join(F.broadcast(known), F.col("id").eqNullSafe(F.col("own")) & F.col("text_hash").eqNullSafe(F.col("own_hash"))).select("id", "toxic", "terms", "tf").dropDuplicates(["id"]).collect()  # copies of a row are equal
    held.sort(key=lambda r: r["id"])
    vectors = Rows([(np.array(r["terms"], np.int32), weights(r["terms"], r["tf"])) for r in held], len(idf))
    y = np.array([r["toxic"] for r in held], float)
    weight = np.array([share[r["toxic"]] / n[r["toxic"]] for r in held])
    index = BlockMaxIndex(vectors, y, np.array([r["id"] for r in held]), weight)
    base = float(index.share @ index.labels / index.share.sum()) if len(held) else 0.0
    silent = np.diff(index.vectors.start) == 0
    votes = np.array([base if silent[i] else index.vote(index.vectors.dense(i), base, i)[0] for i in range(len(held))])
    quiet = float(index.share[silent] @ index.labels[silent] / index.share[silent].sum()) if silent.any() else base
    ends, levels = monotone(votes[~silent], index.labels[~silent], index.share[~silent]) if (~silent).any() else (np.zeros(1), np.array([base]))
    model = spark.sparkContext.broadcast((index, ends, levels, base, quiet, idf))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ends, levels, base, quiet, _ = model.value
        for batch in batches:
            out, evidence, known = [], [], {}
            for at, tf in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not at:
                    out.append(quiet)
                    evidence.append("")
                    continue
                if (key := (*at, -1, *tf)) not in known:
                    raw, rows, near = index.vote(vector(at, tf), base)
                    level = float(levels[min(int(np.searchsorted(ends, raw)), len(levels) - 1)])
                    known[key] = level, ",".join(f"{index.names[i]}:{c:.6f}" for i, c in zip(rows[:3].tolist(), near[:3].tolist(), strict=True))
                out.append(known[key][0])
                evidence.append(known[key][1])
            score = np.clip(np.array(out, float), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(evidence, pa.string()), *batch.columns[3:]], names=["id", "score", "predicted", "evidence", *extra])

    given = counted if with_hash else counted.drop("text_hash")
    return given.mapInArrow(score, f"id {kind}, score double, predicted int, evidence string{hashed}").withColumnRenamed("id", id_col)
