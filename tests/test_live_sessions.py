"""Exact sessions of a stream in ten parts, stopped and started again, against the batch form on the same events."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import sessions
from millrace.streaming.sessions import exact_sessions, settled

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("span", [0, 60_000])
def test_ten_parts_and_a_restart(spark, tmp_path, span):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("edge"))
    rows = events.withColumn("user_id", F.col("user_id") % 20).withColumn("edge", F.when(F.col("edge").cast("int") % 3 == 0, F.lit("x"))).withColumn("k", F.unix_micros("ts") / 1e6)
    limits = {"boundary": "edge", "gap_s": 40_000, "max_len": 8, "max_span_s": span}
    want = {tuple(r) for r in sessions.sessions(rows, ["user_id"], "event_id", "k", "event_type", **limits).collect()}
    last = rows.agg(F.max("event_id")).first()[0]
    for n in range(10):
        part = rows.where((F.col("event_id") > last * n // 10 - (n == 0)) & (F.col("event_id") <= last * (n + 1) // 10)).coalesce(1)
        part.write.parquet(str(tmp_path / f"part{n}"))
    # a row of a lane of its own, far behind, so that every timer goes off
    end = rows.orderBy(F.desc("event_id")).limit(1).select((F.col("event_id") + 1).alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "event_type", (F.col("ts") + F.expr("interval 30 days")).alias("ts"), "edge", (F.col("k") + 30 * 86_400).alias("k"))
    end.write.parquet(str(tmp_path / "part10"))
    (tmp_path / "in").mkdir()

    def feed(parts):
        for n in parts:
            for f in sorted((tmp_path / f"part{n}").glob("*.parquet")):
                f.rename(tmp_path / "in" / f"{n:02}.parquet")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        own = exact_sessions(stream, ["user_id"], "event_id", "k", "event_type", "ts", late="0 seconds", **limits)
        done = own.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        done.awaitTermination(300)
        assert done.exception() is None

    feed(range(4))
    feed(range(4, 11))
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert closed.where("cause = 'timer'").count() > 0
    got = [tuple(r) for r in settled(closed, ["user_id"]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r[-1] for r in got} >= {"gap", "key", "eof"} | ({"max_span"} if span else set())
