"""Secret scan: candidates by pattern, judged by how widely each value is owned over the whole corpus.

A value that many repositories of many owners hold is an example that was copied around; a value in the hands of one
owner looks like a live credential.  The values travel as hashes: each row's candidates are found in one pass over
the whole text, their (hash, owner, repository) triples are made distinct before they are counted (so a value that
fills a third of the corpus shrinks to its owners first), and the verdicts are joined back, row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import saved

KINDS = ("assign", "access", "hex", "live", "example")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is shorter than 24 fails, so runs are asked for at that length
ASSIGN_LEAST, ACCESS_LEAST = 6, 20


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points; leftmost and not overlapping within a kind."""
    text = text or ""
    out = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, ids, owner, repo, text = batch.columns
        rows, counts, base, digest = [], {k: [] for k in KINDS[:3]}, [], []
        for t in text:
            found = candidates(t.as_py())
            rows.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, a, b, v in found])
            for k in counts:
                counts[k].append(sum(f[0] == k for f in found))
            base.append(joined([f[:3] for f in found]))
            digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
        arrays = [row, ids, owner, repo, *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digest, pa.string()), pa.array(rows, _FOUND)]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan_secrets(df: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column, most_owners: int = 1) -> DataFrame:
    """One row per row of ``df``: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (base spans and
    a ``live`` or ``example`` span over each of them), ``n_live`` and ``n_example``.

    A value is live-looking if at most ``most_owners`` owners hold it, in at most as many repositories (an owner who has
    it in several places has copied it, as one does with an example); otherwise it is an example. Null owners or
    repositories count as one owner or repository of their own. Null texts are empty. Each row is judged for itself,
    also where ids repeat; an empty table gives an empty result; other columns aren't read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).alias("text"))
    found = "array<struct<kind:string,start:bigint,end:bigint,hash:string>>"
    scanned = saved(names.mapInArrow(_scan, f"row bigint, id {kind}, owner string, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found {found}"))
    each = scanned.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    held = each.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"))
    by_repo = held.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    verdict = by_owner.join(by_repo, "hash").select("hash", F.when((F.col("owners") <= most_owners) & (F.col("repos") <= most_owners), "live").otherwise("example").alias("verdict"))
    verdict = saved(verdict)  # a table of its own, so that Spark can split a value that fills much of the other side
    order = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    both = F.array(F.struct("kind", "start", "end"), F.struct(F.col("verdict").alias("kind"), "start", "end"))
    judged = each.join(verdict, "hash").select("row", F.explode(both).alias("s")).select("row", "s.*")
    text_of = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    spans = F.array_sort(F.collect_set(F.struct("start", order.alias("o"), "end", "kind")))  # of one row
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    per_row = judged.groupBy("row").agg(spans.alias("spans")).select("row", F.array_join(F.transform("spans", text_of), ",").alias("spans"), number("live").alias("n_live"), number("example").alias("n_example"))
    out = scanned.join(per_row, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
