"""URL filter: allow and block entries in a trie over reversed host labels and path segments.

The entries are configuration (a list in the job, not a table); ``MAX_RULES`` is checked before the trie is
broadcast to the executors.  Each url walks the trie once: label by label from the right of its host, then segment
by segment of its path.  Every node that it passes may hold entries; the longest entry that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``host`` fits itself and its subdomains; ``path`` fits every path that starts with it."""

    action: str  # allow or block
    host: str
    path: str


class _Node:
    """One host label. ``paths``: segment -> node of the same kind below; ``ends``: (last part of the path, rule)."""

    __slots__ = ("ends", "labels", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.ends: list[tuple[str, Rule]] = []


def build_trie(rules: list[Rule]) -> _Node:
    """Of entries with the same host and path, block stands over allow."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    root = _Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = node.labels.setdefault(label, _Node())
        *whole, part = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, _Node())
        node.ends.append((part, rule))
    return root


def _better(a: Rule | None, b: Rule) -> Rule:
    """The longer of two entries that both fit: by host and path together, then by host; then block."""
    rank = lambda r: (len(r.host) + len(r.path), len(r.host), r.action == "block")
    return b if a is None or rank(b) > rank(a) else a


def longest_match(root: _Node, host: str, path: str) -> Rule | None:
    best, segments = None, path.split("/")
    labels = [None, *reversed(host.split("."))] if host else [None]
    node: _Node | None = root
    for label in labels:
        if label is not None:
            node = node.labels.get(label)
            if node is None:
                break
        below: _Node | None = node
        for segment in segments:
            for part, rule in below.ends:
                if segment.startswith(part):
                    best = _better(best, rule)
            below = below.segments.get(segment)
            if below is None:
                break
    return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: list[Rule], id_col: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``df``: id, host, path, the deciding entry as ``rule`` (host and path; null if none fits)
    and ``verdict`` (its action, else ``default``).

    Null urls and urls without ``://`` have an empty host and path. Other columns of ``df`` are not read, so their
    names can't clash. Repeated rows are judged each; an empty table gives an empty result.
    """
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            ids, host, path = batch.columns
            found = [longest_match(root, h, p) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
            rule = pa.array([r and r.host + r.path for r in found], pa.string())
            verdict = pa.array([r.action if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([ids, host, path, rule, verdict], names=[id_col, "host", "path", "rule", "verdict"])

    slim = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
