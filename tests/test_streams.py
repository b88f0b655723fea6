"""Streams with states of runs against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import rolling
from lumenfold.streaming import ingest


class Kept:
    """A map state that counts how often it is asked or changed."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.held[key]


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, key, value):  # noqa: N802
        return self.states.setdefault(name, Kept())


def test_release_in_order_asks_the_state_by_chunk_and_not_by_batch():
    n = 3 * ingest.CHUNK + 5
    rows = [(run, place) for run in (1, 2) for place in range(n) if (run, place) != (2, 1500)]
    random.Random(4).shuffle(rows)
    operator, handle, found = ingest.InOrder("k"), Handle(), {1: [], 2: []}
    operator.init(handle)
    for at in range(0, len(rows), 1000):
        again = rows[max(0, at - 300) : at + 1000]  # some come twice
        part = pd.DataFrame({"run": [r for r, _ in again], "place": [p for _, p in again], "id": [10 * p for _, p in again], "given": [p != 7 for _, p in again]})
        for out in operator.handleInputRows((0,), iter([part]), None):
            for run, place, i in zip(out["k"], out["place"], out["id"]):
                assert pd.isna(i) if place == 7 else i == 10 * place
                found[run].append(place)
    assert found == {1: list(range(n)), 2: list(range(1500))}
    assert {k[0] for k in handle.states["early"].held} == {2}
    assert sum(s.calls for s in handle.states.values()) < len(rows) / 20


def test_release_in_order_over_a_stream(spark, tmp_path):
    rows = [(None, 0, 1), (None, 2, 3), (5, 1, 2**60 + 1), (5, None, 9), (None, 1, None), (5, 0, 7), (6, 1, 1), (5, 0, 7)]
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    with ingest.keyed_state(spark):
        for at in (0, 3, 6):
            spark.createDataFrame(rows[at : at + 3], "k bigint, place bigint, id bigint").coalesce(1).write.mode("append").parquet(folder)
            stream = ingest.release_in_order(ingest.read_stream(spark, folder, "k bigint, place bigint, id bigint"), "k")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = {tuple(r) for r in spark.read.schema("k bigint, place bigint, id bigint").parquet(out).collect()}
    assert found == {(None, 0, 1), (None, 1, None), (None, 2, 3), (5, 0, 7), (5, 1, 2**60 + 1)}


def test_averages_after_micro_batches(spark, tmp_path):
    """Keys that come in some micro-batches only, and values that are passed over; no row goes through Python."""
    rnd = random.Random(8)
    rows = [(i, i // 3, rnd.choice((1, 2, 3)) if i < 400 else 2, rnd.choice((-1.0, float("nan"), None, rnd.uniform(0, 9)))) for i in range(700)]
    rows = [(i, t, k, v if k != 3 else -2.0) for i, t, k, v in rows] + [(1000, 0, None, 4.0)]
    folder, sink, done = (f"file://{tmp_path}/{n}" for n in ("in", "sink", "done"))
    schema = "event_id bigint, t bigint, k bigint, value double"
    for part in (rows[:200], rows[200:450], rows[450:]):
        spark.createDataFrame(part[::-1], schema).select("event_id", F.timestamp_seconds("t").alias("ts"), "k", "value").write.mode("append").parquet(folder)
        ingest.ewma_results(ingest.read_stream(spark, folder, "event_id bigint, ts timestamp, k bigint, value double"), "k", sink, done)
    after = ingest.ewma_merged(spark, sink, "k")
    assert "Pandas" not in after._jdf.queryExecution().toString()
    wanted = {k: (None, 0.0, 0) for k in (1, 2, 3, None)}
    for _, _, k, v in rows:
        if v is not None and v >= 0:
            mean, variance, n = wanted[k]
            wanted[k] = (*rolling.ewma_step(mean, variance, v), n + 1)
    found = {r["k"]: (r["mean"], r["variance"], r["n"]) for r in after.collect()}
    assert found.keys() == wanted.keys()
    for k, (mean, variance, n) in wanted.items():
        assert found[k] == ((pytest.approx(mean) if n else None), pytest.approx(variance), n)
