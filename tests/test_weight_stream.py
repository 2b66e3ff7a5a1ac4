"""Weights from a stream that stops in the middle, against the batch."""

import random
from datetime import datetime, timedelta

import pytest

from sentrygrid.operators import feedback
from sentrygrid.streaming import weights as stream

T0 = datetime(2026, 3, 1)


def test_stopped_stream_equals_the_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"F{i}", rng.choice(["hot"] * 4 + ["a", "b"]), rng.choice(["EG-01", "NS-03"]), rng.choice(["dismiss", "dismiss", "confirm", "note"]), "x", None, str(T0 + timedelta(minutes=5 * i))) for i in range(120)]
    last = (10_000, "F", "end", "EG-01", "note", "x", None, str(T0 + timedelta(days=30)))  # closes every span before it
    inbox, target, checkpoint = (f"{tmp_path}/{n}" for n in ("inbox", "out", "state"))
    for k in range(3):  # decisions of a span come in any order and in several files
        part = rows[40 * k : 40 * k + 40]
        rng.shuffle(part)
        feedback.append(spark, inbox, spark.createDataFrame(part, feedback.LEDGER).coalesce(1))

    def decisions():
        return spark.readStream.schema(feedback.LEDGER).option("maxFilesPerTrigger", 1).parquet(inbox)

    put, seen = stream._put, []

    def stops_once(batch, folder):
        put(batch, folder)
        seen.append(folder)
        if len(seen) == 2:
            raise RuntimeError("stopped after its rows were written")

    monkeypatch.setattr(stream, "_put", stops_once)
    with pytest.raises(Exception, match="stopped"):
        stream.run(decisions(), target, checkpoint).awaitTermination()
    stream.run(decisions(), target, checkpoint).awaitTermination()
    assert seen[2] == seen[1]  # tried again
    feedback.append(spark, inbox, spark.createDataFrame([last], feedback.LEDGER))
    stream.run(decisions(), target, checkpoint).awaitTermination()
    key = lambda r: (r["entity_id"], r["detector_id"])
    want = {key(r): r.asDict() for r in feedback.weights(spark.createDataFrame(rows, feedback.LEDGER)).collect()}
    assert {key(r): r.asDict() for r in stream.weights(spark, target).collect() if r["entity_id"] != "end"} == want


def test_no_decisions(spark, tmp_path):
    assert stream.weights(spark, f"{tmp_path}/none").count() == 0
