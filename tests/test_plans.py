import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import judges
from millrace.operators import sessions, stitch
from millrace.plans import estimate
from millrace.sinks import emit
from millrace.streaming import sessions as live


def test_next_fit():
    assert estimate.next_fit([3, 4, 9, 2], 5) == [(3, 1), (4, 1), (5, 1), (4, 1), (2, 1)]
    assert estimate.next_fit([], 5) == []


def test_estimate_totals():
    got = estimate.estimate(14, estimate.Run(generate=True, classify=True, verify=True))
    assert got["generate_calls"] == 7 and got["records"] == 42 and got["quality_calls"] == 4 * 21
    assert got["total_calls"] == sum(v for k, v in got.items() if k.endswith("_calls") and k != "total_calls")


def test_packed_windows(spark):
    df = spark.createDataFrame([([5, 5, 5, 5, 5],), ([100, 1],), ([1],), ([],)], "c array<int>")
    got = [[tuple(w) for w in r[0]] for r in df.select(sessions.packed_windows(F.col("c"), 12, 20)).collect()]
    assert got == [[(0, 2), (1, 3), (2, 4), (3, 5)], [(0, 2)], [(0, 1)], []]


def test_window_spans(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (6,), (9,)], "n int")
    got = [[tuple(w) for w in r[0]] for r in df.select(sessions.window_spans(F.col("n"), 5)).collect()]
    assert got == [[(0, 1)], [(0, 2)], [(0, 5)], [(0, 5), (4, 6)], [(0, 5), (4, 9)]]


def test_session_gap_at_the_limit_and_repeats(spark):
    rows = [("u", 1, 0.0, "a"), ("u", 2, 300.0, "b"), ("u", 3, 601.0, "a"), ("u", 4, 700.0, "b"), ("v", 5, 0.0, "a")]
    df = spark.createDataFrame(rows, "lane string, seq long, k double, r string")
    got = sessions.sessions(df, ["lane"], "seq", "k", "r").orderBy("first_seq").collect()
    assert [(r["len"], r["cause"], r["repeat"]) for r in got] == [(2, "gap", 0), (2, "eof", 1), (1, "eof", 0)]


def test_stitch_walk_needs_a_prior():
    base = {"tail_page": None, "head_page": None, "tail_entities": [], "head_entities": []}
    rows = [
        base | {"episode_id": "e1", "head_pos": 0, "tail_pos": 2, "apps": ["mail"], "verdict": "new", "thread_ref": None},
        base | {"episode_id": "e2", "head_pos": 3, "tail_pos": 4, "apps": ["shop"], "verdict": "resume", "thread_ref": 1},
        base | {"episode_id": "e3", "head_pos": 5, "tail_pos": 6, "apps": ["mail"], "verdict": "resume", "thread_ref": 2},
        base | {"episode_id": "e4", "head_pos": 7, "tail_pos": 8, "apps": ["mail"], "verdict": "resume", "thread_ref": 9},
    ]
    assert stitch.walk(pd.DataFrame(rows)) == ["e1", "e2", "e1", "e4"]


def test_main_row_and_delivery(spark, tmp_path):
    df = spark.createDataFrame([('{"a":1}', "x"), ("{}", None)], "o string, id string")
    got = [r[0] for r in df.select(emit.main_row(F.col("o"), F.struct("id"))).collect()]
    assert got == ['{"a":1,"_meta":{"id":"x"}}', '{"_meta":{"id":null}}']
    emit.deliver(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_redaction(spark):
    df = spark.createDataFrame([({"record_id": "1", "prompt": "long text"},)], "p map<string,string>")
    got = {t: df.select(emit.redacted(F.col("p"), t, 4)).first()[0] for t in emit.TIERS}
    assert got == {"none": {}, "refs": {"record_id": "1"}, "excerpt": {"record_id": "1", "prompt": "long"}, "full": {"record_id": "1", "prompt": "long text"}}


def test_judges_fail_by_row(spark):
    class Loud:
        def answer(self, prompts):
            if "boom" in prompts:
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "hi")], "k long, prompt string")
    assert judges.ask(df, Loud, ["k"]).first()["answer"] == "HI"
    assert "down" in judges.ask(df.withColumn("prompt", F.lit("boom")), Loud, ["k"]).first()["problem"]
    assert judges.first_object('```json\n{"a": "}"}\n```') == '{"a": "}"}' and judges.first_object("none") is None
    assert judges.violations(None) == [] and judges.violations([1]) == ["1"]
    with pytest.raises(TypeError):
        judges.violations("x")


def test_live_sessions(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("u", t0 + datetime.timedelta(seconds=s)) for s in (0, 100, 1000, 90000)]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.live_sessions(stream, "k", "ts").writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["len"] for r in spark.table("live").collect()) == [1, 1, 2]
