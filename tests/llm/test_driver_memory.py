"""What the near-duplicate step sends through the driver."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

from terralith.llm import components, jaccard_join


def test_components_broadcast_nothing(spark, monkeypatch):
    """A broadcast takes a megabyte or more of the driver for a few rows; the rounds have none, and find what they found."""
    plans = []

    def noted(df, save=components.saved):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df)

    monkeypatch.setattr(components, "saved", noted)
    links = [(i, i + 1) for i in range(20, 40)] + [(100, i) for i in range(101, 140)] + [(7, 5), (5, 7), (3, 3)]
    out = components.connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    want = {i: 20 for i in range(20, 41)} | {i: 100 for i in range(100, 140)} | {5: 5, 7: 5}
    assert {r["id"]: r["component"] for r in out} == want and len(out) == len(want)
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_band_table_travels_compressed(spark, monkeypatch):
    """The table has 2**PLACES bytes; what is sent to the tasks is far less, and the signatures are those of the table."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or send(self, value))
    df = spark.createDataFrame([(f"one common passage of seven words {i} and then {i * i} ends it {i % 5}",) for i in range(60)], "text string")
    bands = jaccard_join.token_bands(df, "text", 5, 60 * 9)
    got = jaccard_join._signed(df, "text", 5, 80, bands).select("sig", "node", "place").collect()
    want = set()
    for _, sets in jaccard_join._sets(pa.array([r["text"] for r in df.collect()]), 5):
        for s in sets:
            sig, place = jaccard_join.signatures(s, bands, 80)
            want |= {(x, jaccard_join.set_key(s), p) for x, p in zip(sig.view(np.int64).tolist(), place.tolist(), strict=True)}
    assert bands.any() and {tuple(r) for r in got} == want
    assert len(sent) == 1 and sent[0] < 1 << (jaccard_join.PLACES - 4)
