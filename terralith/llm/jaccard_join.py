"""Exact Jaccard join of word-shingle sets by prefixes of token combinations.

Tokens are the hashes of a text's distinct shingles.  A first pass counts in how many texts each token stands (summed
within a task first; copies count once a task).  A byte table of fixed size keeps the band of each token that more than
``RARE`` texts hold, a band for every factor of 4 (tokens that fall on one place share the higher band; where more tokens
are frequent than the table has room for, its lowest bands are emptied).  It gives one order for all texts: rare tokens
first, then band by band.  Which order it is decides about the work only, never about the result.
A pair that reaches the threshold shares at least o of x's n tokens, so at most n - o of x's tokens are missing in y.
A prefix of x that holds r rare tokens and c_i tokens of each frequent class i therefore meets y's in a rare token or in
two tokens of one class, once r + sum(c_i - 1) > n - o.  Signatures carry their place in that sum, and o follows from
both sizes, so a pair only counts where both places are within what the pair's own sizes need.  So single rare
tokens and pairs of frequent tokens of one class are the signatures; the classes are hash classes whose number goes
with the size of the sets, so that pairs stay in proportion to the prefix.  Since what a text has for itself comes first,
texts that share a passage or are far edits of one text are told apart by their places.

Texts of equal sets are one node.  Within a signature's texts each is first tested against the first text of its size
class only; what links makes components.  A few more rounds test one text of each component left there against one of
the largest.  Then only pairs from different components that share a signature are tested (any other link joins what is
joined already), so that a large group of copies costs tests in proportion to its members.  Sketches rule out pairs that
only share a passage, where the pairs are made; the tests of the others compare whole sets.  A signature of very many
texts is dealt over tiles of at most about ``TILE`` texts a side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm import hashing
from terralith.llm.common import dropped, passing, saved
from terralith.llm.components import connected_components

PLACES = 24  # bits: places of the table of bands
RARE = 16  # texts; band b is for more than RARE * 4**(b - 1) of them
BANDS = 20
GROUP = 4_000_000  # tokens that are counted together, about
ROUNDS = 2  # of tests between components' members
TILE = 4096  # texts of a signature on one side of a tile
PARITIES = 2048  # bits of a set's sketch
SEEN = 1_000_000  # sets that a task remembers, to send the signatures of copies once
ROWS = 200_000  # signatures in one batch to Spark


def _sets(text: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The token sets of a few megabytes of texts at a time, behind the index of the first one."""
    data = [(t.as_py() or "").encode() for t in text]
    for a, b in hashing.batches_by_bytes(data):
        yield a, hashing.shingle_sets(data[a:b], words)


def set_key(tokens: np.ndarray) -> int:
    """A 63-bit name for a set of tokens (0 for the empty one)."""
    if not len(tokens):
        return 0
    s = np.array([len(tokens), int(tokens.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(tokens)), int(hashing.mixed(tokens).sum(dtype=np.uint64))], np.uint64)
    return int(hashing.windows(s, 4)[0] >> np.uint64(1)) or 1


def parities(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls in each of PARITIES cells. A cell that differs between two sets holds a
    token that only one of them has, so the sets differ in as many tokens at least as cells differ."""
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def described(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h, node, n, sketch) of every row; h tells apart the texts of one id."""
    kind = df.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h, text = batch.columns
            for at, sets in _sets(text, words):
                rows = [ids.slice(at, len(sets)), h.slice(at, len(sets)), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["id", "h", "node", "n", "sketch"])

    return saved(df.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(describe, f"id {kind}, h bigint, node bigint, n bigint, sketch binary"))


def _blobs(data: np.ndarray, start: np.ndarray) -> pa.Array:
    """One binary value for each range of ``data`` that begins at ``start``."""
    edge = (np.append(start, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def token_bands(df: DataFrame, text_col: str, words: int, total: int) -> np.ndarray:
    """The table of bands. ``total`` tokens are counted in groups of about GROUP, told apart by their first bits; tokens
    travel as 32 further bits (a chance collision makes a token look more frequent). The driver gets 2**PLACES bytes, which
    travel compressed: most are 0."""
    bits = min(PLACES - 4, max(8, (total // GROUP).bit_length()))
    shift = np.uint64(64 - bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), words):
                held = []
                for tokens in sets:
                    key = set_key(tokens)
                    if len(tokens) > 1 and key not in seen:
                        if len(seen) < SEEN:
                            seen.add(key)
                        held.append(tokens)
                if not held:
                    continue
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                for more in (False, True):  # tokens of one text here travel without a count
                    own, many = tokens[(n > 1) == more], n[(n > 1) == more]
                    bucket, start = np.unique(own >> shift, return_index=True)
                    low = (own >> (shift - np.uint64(32))).astype(np.uint32)
                    counts = _blobs(many.astype(np.uint32), start) if more else pa.nulls(len(start), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), _blobs(low, start), counts], names=["bucket", "tokens", "counts"])

    def count(group: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(b.as_py(), np.uint32) for b in group.column("tokens")]
        many = [np.ones(len(t), np.int64) if c.as_py() is None else np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for t, c in zip(tokens, group.column("counts"), strict=True)]
        tokens, many = np.concatenate(tokens), np.concatenate(many)
        order = np.argsort(tokens)
        tokens, many = tokens[order], many[order]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        many, tokens = np.add.reduceat(many, start), tokens[start]
        often = many > RARE
        band = np.minimum(BANDS, 1 + (np.log2((many[often] - 0.5) / RARE) / 2).astype(np.int64)).astype(np.uint8)
        table = np.zeros(1 << (PLACES - bits), np.uint8)
        np.maximum.at(table, tokens[often] >> np.uint32(32 - (PLACES - bits)), band)
        return pa.table({"bucket": group.column("bucket")[:1], "bands": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary()), "n": pa.array([np.bincount(band, minlength=BANDS + 1).tolist()], pa.list_(pa.int64()))})

    dealt = df.select(text_col).mapInArrow(deal, "bucket int, tokens binary, counts binary")
    found = dealt.groupBy("bucket").applyInArrow(count, "bucket int, bands binary, n array<bigint>").toArrow()
    table = np.zeros((1 << bits, 1 << (PLACES - bits)), np.uint8)
    n = np.zeros(BANDS + 1, np.int64)
    for bucket, bands, many in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
        table[bucket] = np.frombuffer(zlib.decompress(bands), np.uint8)
        n += many
    above = np.cumsum(n[::-1])[::-1]  # tokens of a band or a higher one
    least = int(np.argmax(above <= 1 << (PLACES - 2))) if above[-1] <= 1 << (PLACES - 2) else BANDS
    for row in table:
        row[row < least] = 0
    return table.ravel()


def _band(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return table[(tokens >> np.uint64(64 - PLACES)).astype(np.int64)]


def signatures(tokens: np.ndarray, bands: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set (sorted distinct tokens) and their places: how much of the prefix's sum lies before. A set
    of one token has no partner but its equals."""
    n = len(tokens)
    if n < 2:
        return tokens[:0], np.zeros(0, np.int32)
    least, most = -(-n * per_cent // 100), n * 100 // per_cent  # of a partner's size, and of what is shared
    need = n - least + 1
    band = _band(bands, tokens)
    rare = tokens[band == 0]
    if len(rare) >= need:
        return rare[:need], np.arange(need, dtype=np.int32)
    out, places, common = [rare], [np.arange(len(rare))], tokens[np.argsort(band, kind="stable")][len(rare) :]
    for level in range(least.bit_length() - 1, most.bit_length()):  # both of a pair use the level of the smaller bit length that they share
        cls = hashing.mixed(common) % np.uint64(max(1, (1 << level) >> 3))
        order = np.argsort(cls, kind="stable")
        gain = np.zeros(len(common), np.int64)  # 0 for the first token of each class, 1 for the others
        gain[order[1:]] = cls[order[1:]] == cls[order[:-1]]
        total = np.cumsum(gain)
        stop = int(np.searchsorted(total, need - len(rare))) + 1
        before = len(rare) + total - gain
        order = order[order < stop]
        own, own_cls, own_before = common[order], cls[order], before[order]
        for gap in range(1, len(own)):
            same = own_cls[gap:] == own_cls[:-gap]
            if not same.any():
                break
            a, b = own[:-gap][same], own[gap:][same]
            out.append(hashing.mixed(hashing.mixed(a * np.uint64(3) + np.uint64(level)) + b))
            places.append(own_before[gap:][same])  # a class keeps the tokens' order, so b is the later one
    return np.concatenate(out), np.concatenate(places).astype(np.int32)


def fits(n_a: np.ndarray, n_b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold and need their prefixes as far as these places."""
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    shared = -(-per_cent * (n_a + n_b) // (100 + per_cent))
    return (np.minimum(n_a, n_b) >= shared) & (place_a <= n_a - shared) & (place_b <= n_b - shared)


def _signed(df: DataFrame, text_col: str, words: int, per_cent: int, bands: np.ndarray) -> DataFrame:
    """(sig, node, n, place): the signatures of every set; a task sends those of copies once."""
    table = df.sparkSession.sparkContext.broadcast(zlib.compress(bands, 1))  # 2**PLACES bytes, most of them 0

    def emit(held: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        many = [len(s[0]) for *_, s in held]
        cols = [np.concatenate([s[0] for *_, s in held]).view(np.int64), np.repeat(np.array([h[0] for h in held], np.int64), many), np.repeat(np.array([h[1] for h in held], np.int32), many), np.concatenate([s[1] for *_, s in held])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sig", "node", "n", "place"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = np.frombuffer(zlib.decompress(table.value), np.uint8), set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), words):
                held, rows = [], 0
                for tokens in sets:
                    key = set_key(tokens)
                    if len(tokens) < 2 or key in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    held.append((key, len(tokens), signatures(tokens, often, per_cent)))
                    rows += len(held[-1][2][0])
                    if rows >= ROWS:
                        yield emit(held)
                        held, rows = [], 0
                if held:
                    yield emit(held)

    return df.select(text_col).mapInArrow(sign, "sig bigint, node bigint, n int, place int")


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(batches[0].num_columns)]


def _runs(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Columns of about ``rows`` rows at a time of a table that is sorted by its first column, cut between its values
    where that is possible; whether the first value goes on from before, and whether the last one goes on."""
    held, on = [], False
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        cols = _columns(held)
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols], on, False
            held, on = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in cols], names=batch.schema.names)], False
        else:  # one value fills it all
            yield cols, on, True
            held, on = [], True
    if held:
        yield _columns(held), on, False


def _shared(per_cent: int):
    """Keeps the signatures that two nodes have; ``pivot``: the first node of the same signature and size class, or the
    node itself if the two can't be partners here. Rows come sorted by signature; a task holds about ROWS of them."""
    ratio = 100 / per_cent

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[int, tuple[int, int, int]] = {}  # the first node of each size class, where a signature goes on
        going = None
        for cols, on, goes_on in _runs(batches):
            order = np.lexsort((cols[1], cols[2], cols[0]))
            sig, node, n, place = (c[order] for c in cols)
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node, n, place = (c[new] for c in (sig, node, n, place))
            run = np.cumsum(np.concatenate(([True], sig[1:] != sig[:-1]))) - 1
            many = np.bincount(run)[run] > 1
            many |= (run == 0) & (on or goes_on)
            sig, node, n, place = sig[many], node[many], n[many], place[many]
            if not len(sig):
                before = {}
                continue
            cls = np.floor(np.log(n) / np.log(ratio)).astype(np.int64)
            first = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])))
            lead = np.flatnonzero(first)
            pivots = [node[lead], n[lead].astype(np.int64), place[lead].astype(np.int64)]
            if not on or going != sig[0]:
                before = {}
            going = sig[0]
            for i in range(len(lead) if before or goes_on else 0):
                if sig[lead[i]] != sig[0]:
                    break
                got = before.setdefault(int(cls[lead[i]]), tuple(int(p[i]) for p in pivots))
                for p, v in zip(pivots, got, strict=True):
                    p[i] = v
            if not goes_on:
                before = {}
            to = np.cumsum(first) - 1
            pivot = np.where(fits(n, pivots[1][to], place, pivots[2][to], per_cent), pivots[0][to], node)
            for i in range(0, len(sig), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) for c in (sig, node, n, place, pivot)], names=["sig", "node", "n", "place", "pivot"])

    return keep


def _fits(a: str, b: str, per_cent: int) -> Column:
    """``fits`` of two structs of n and place."""
    n_a, n_b = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    shared = F.ceil((n_a + n_b) * per_cent / (100 + per_cent) - 1e-6)
    return (F.least(n_a, n_b) >= shared) & (F.col(f"{a}.place") <= n_a - shared) & (F.col(f"{b}.place") <= n_b - shared)


def _ordered(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _unsettled(placed: DataFrame) -> DataFrame:
    """The rows (sig, node, n, place, component) of signatures that have more than one component."""
    mixed = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    return saved(placed.join(mixed, "sig", "left_semi"))


def _one_each(placed: DataFrame, step: int, per_cent: int) -> DataFrame:
    """For each signature one node of each component, with one of the component that has most nodes there; which nodes
    they are changes with ``step``, and is the same for all signatures as far as it can be."""
    r = F.struct(F.xxhash64(F.lit(step), "node").alias("h"), "node", "n", "place")
    each = placed.groupBy("sig", "component").agg(F.count("*").alias("many"), F.min(r).alias("r"))
    lead = each.groupBy("sig").agg(F.max(F.struct("many", "component", "r")).alias("lead"))
    met = each.join(lead, "sig").select("component", "r", F.col("lead.component").alias("other"), F.col("lead.r").alias("q"))
    return met.where((F.col("component") != F.col("other")) & _fits("r", "q", per_cent)).select(*_ordered("r.node", "q.node")).distinct()


def _tiled(placed: DataFrame) -> DataFrame:
    """Each row with the tiles (low, high) of its signature that it takes part in, and its side of them."""
    hot = placed.groupBy("sig").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks")).where("chunks > 1")
    dealt = placed.join(hot, "sig", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    return dealt.select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side, "node", "n", "place", "component", "sketch")


def _across(per_cent: int):
    """Pairs of nodes of one signature in different components, of sizes, places and sketches that can reach the
    threshold. A task takes one tile after the other; rows come sorted by tile."""

    def pairs_of(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, low, high, side, node, n, place, comp = _columns([g.select(g.schema.names[:-1]) for g in group])
        sketch = np.frombuffer(b"".join(b for g in group for b in g.column("sketch").to_pylist()), np.uint64).reshape(len(sig), -1)
        order = np.lexsort((node, n, high, low, sig))
        sig, low, high, side, node, n, place, comp = (c[order] for c in (sig, low, high, side, node, n.astype(np.int64), place, comp))
        run = np.cumsum(np.concatenate(([True], (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        at, gap, held, rows = np.arange(len(sig)), 1, [], 0
        while True:
            at = at[at + gap < len(sig)]
            at = at[(run[at] == run[at + gap]) & (n[at] * 100 >= n[at + gap] * per_cent)]
            met = at[(comp[at] != comp[at + gap]) & ((low[at] == high[at]) | (side[at] != side[at + gap])) & fits(n[at], n[at + gap], place[at], place[at + gap], per_cent)]
            for i in range(0, len(met), 50_000):
                found = met[i : i + 50_000]
                apart = np.bitwise_count(sketch[order[found]] ^ sketch[order[found + gap]]).sum(axis=1, dtype=np.int64)
                found = found[apart * (100 + per_cent) <= (n[found] + n[found + gap]) * (100 - per_cent)]
                a, b = node[found], node[found + gap]
                held.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
                rows += len(found)
            if rows and (not len(at) or rows >= 500_000):
                both = np.unique(np.concatenate(held), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
                held, rows = [], 0
            if not len(at):
                return
            gap += 1

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            tiles = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            if last is not None and sum(b.num_rows for b in held) >= TILE:  # whole tiles only
                go = next((i for i, t in enumerate(tiles) if t != last), len(tiles))
                held.append(batch.slice(0, go))
                batch, tiles = batch.slice(go), tiles[go:]
                if tiles:
                    yield from pairs_of(held)
                    held = []
            if tiles:
                held.append(batch)
                last = tiles[-1]
        if held:
            yield from pairs_of(held)

    return pair


def _tested(pairs: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *_ = (batch.column(i).to_numpy() for i in range(2))
            texts = {}
            for keys, col in ((a, batch.column(2)), (b, batch.column(3))):
                for i, k in enumerate(keys.tolist()):
                    if k not in texts:
                        texts[k] = col[i].as_py().encode()
            sets, names = {}, list(texts)
            for i, j in hashing.batches_by_bytes([texts[k] for k in names]):
                sets.update(zip(names[i:j], hashing.shingle_sets([texts[k] for k in names[i:j]], words), strict=True))
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                s, t = sets[x], sets[y]
                both = len(s) + len(t)
                shared = both - len(np.unique(np.concatenate((s, t))))
                good[i] = 100 * shared >= per_cent * (both - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["u", "v"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(test, "u bigint, v bigint")


def _possible(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """The pairs that their sketches leave possible; none that reaches the threshold is lost. It keeps texts that only
    share a passage from travelling to the test."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, PARITIES // 64) for i in (2, 3)]
            apart = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(apart * (100 + per_cent) <= sizes * (100 - per_cent)))

    side = lambda p: nodes.select(F.col("node").alias(p), F.col("sketch").alias(f"sketch_{p}"), F.col("n").alias(f"n_{p}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")
    return saved(rows.mapInArrow(keep, "a bigint, b bigint"))


MOST_BROADCAST = 1_000_000  # rows of two numbers


def _texts(df: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, text) for each of the ``wanted`` nodes: the text of one row with that set."""
    wanted = saved(nodes.join(wanted, "node", "left_semi").select("node", "row.id", "row.h"))
    small = wanted.count() <= MOST_BROADCAST
    rows = df.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_h"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(wanted) if small else wanted, (F.col("own_h") == F.col("h")) & F.col("own").eqNullSafe(F.col("id"))).select("node", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # hashes may be equal by chance
        for batch in batches:
            node = batch.column(0).to_numpy()
            good = [set_key(s) == node[at + i] for at, sets in _sets(batch.column(1), words) for i, s in enumerate(sets)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return saved(rows.mapInArrow(same, "node bigint, text string").dropDuplicates(["node"]))


def jaccard_components(df: DataFrame, id_col: str, text_col: str, words: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links between
    texts whose shingle sets have at least ``per_cent`` of their union in common.

    Null texts, and texts without words, have an empty set and link with nothing: their component is their own id.
    Rows that repeat a text are linked. Null ids are kept; they never name a component that holds another id. An empty
    table gives an empty result; other columns aren't read.
    """
    with passing() as keep:
        return keep(_components(df, id_col, text_col, words, per_cent))


def _components(df: DataFrame, id_col: str, text_col: str, words: int, per_cent: int) -> DataFrame:
    """``jaccard_components`` with all its tables left there; the first round's signatures go once they aren't read any more."""
    slim = described(df, id_col, text_col, words)
    nodes = saved(slim.where("n > 1").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.min(F.struct("id", "h")).alias("row")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    signed = _signed(df, text_col, words, per_cent, token_bands(df, text_col, words, total))
    shared = saved(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_shared(per_cent), "sig bigint, node bigint, n int, place int, pivot bigint"))

    def tested(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = _texts(df, nodes, wanted, id_col, text_col, words)
        out = saved(_tested(pairs, texts, words, per_cent))
        dropped(texts, pairs)
        return out

    done = saved(shared.where("node <> pivot").select(*_ordered("node", "pivot")).distinct())
    links = tested(_possible(done, nodes, per_cent))
    names, open_, settled = connected_components(links), shared.select("sig", "node", "n", "place"), shared
    for step in range(ROUNDS + 1):  # the last round takes all pairs that are left
        placed = open_.join(names.withColumnRenamed("id", "node"), "node", "left")
        placed = _unsettled(placed.select("sig", "node", "n", "place", F.coalesce("component", "node").alias("component")))
        if step < ROUNDS:
            pairs = saved(_one_each(placed, step, per_cent).join(done, ["a", "b"], "left_anti"))
            done = done.unionByName(pairs)
            pairs = _possible(pairs, nodes, per_cent)
        else:
            dealt = _tiled(placed.join(nodes.select("node", "sketch"), "node")).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
            pairs = saved(dealt.mapInArrow(_across(per_cent), "a bigint, b bigint").distinct())
        more = tested(pairs)
        if more.limit(1).count() > 0:
            links = links.unionByName(more)
            names = connected_components(links)
        dropped(settled)
        settled, open_ = placed, placed.select("sig", "node", "n", "place")
    rows = slim.join(names.withColumnRenamed("id", "node"), "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = saved(rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least")))  # so that Spark can split a large class
    out = rows.join(least, "class", "left")
    return saved(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")))
