"""Each failure of the provenance contract, and joins that keep their rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terralith.operators.errors import GeoError
from terralith.sources import provenance


def table(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "source_row bigint")
    return df.select("source_row", *(F.concat(F.lit(c), "source_row").alias(c) for c in provenance.COLUMNS[1:]))


def test_contract(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    assert provenance.load(spark, at("none"), declared=False) is None
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk/part.parquet").write_bytes(b"no parquet")
    table(spark, [1, 2, 3]).write.parquet(at("good"))
    table(spark, [1, 2]).drop("vx_km_s", "line_id").write.parquet(at("narrow"))
    table(spark, [1, 2, 2, None]).write.parquet(at("double"))
    assert provenance.load(spark, at("good")).count() == 3
    for name, code in (("none", "PROVENANCE_ARTIFACT_MISSING"), ("junk", "PROVENANCE_ARTIFACT_INVALID"), ("narrow", "PROVENANCE_SCHEMA_MISMATCH"), ("double", "PROVENANCE_DUPLICATE_SOURCE_ROW")):
        with pytest.raises(GeoError, match=code):
            provenance.load(spark, at(name))


def test_keys_are_counted(spark):
    rows = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 9, 10)], "source_row bigint")
    n = provenance.key_counts(table(spark, [1, 2, 2, 3, None, None, 7]), rows).first()
    assert n.asDict() == {"null_keys": 2, "repeated_keys": 1, "matched": 3, "unmatched": 2, "unused": 1, "repeated_rows": 1}
    with pytest.raises(GeoError) as e:
        provenance.ensure_coverage(table(spark, [1, 2, 3]), rows)
    assert e.value.code == "PROVENANCE_SOURCE_ROW_UNMATCHED" and e.value.details == {"rows": 2, "first": [9, 10]}
    provenance.ensure_coverage(table(spark, [1, 2, 3, 9, 10, 11]), rows)
    for bad in (table(spark, [1, 1]), table(spark, [None, 1])):
        with pytest.raises(GeoError, match="PROVENANCE_NOT_ONE_TO_ONE"):
            provenance.attributed(rows.distinct(), bad, ["line_id"])
    out = provenance.attributed(rows.distinct(), table(spark, [1, 2, 7]), ["line_id"])
    assert {(r["source_row"], r["line_id"]) for r in out.collect()} == {(1, "line_id1"), (2, "line_id2"), (3, None), (9, None), (10, None)}
    assert provenance.key_counts(table(spark, []), rows.limit(0)).first().asDict() == dict.fromkeys(("null_keys", "repeated_keys", "matched", "unmatched", "unused", "repeated_rows"), 0)
