"""Blocks of delivered rows, traces, caps of screens, policies, second passes, embeddings, streams out of order."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import fit
from millrace.functions import text as text_fn
from millrace.judges import embedded
from millrace.operators import stitch, votes
from millrace.plans import config, rubrics
from millrace.provider import HttpJudge, Profile, body, usage_of
from millrace.sinks import blocks, trace
from millrace.sources import jsonl, ui
from millrace.streaming.sessions import live_order


def test_meta_has_every_key(spark):
    rows = spark.createDataFrame([("r\"1", 'a.jsonl', 3, '{"lang": "en", "x": null, "y": [1]}'), ("r2", "b", None, None)], "id string, file string, line_no long, raw string")
    scored = spark.createDataFrame([("r\"1", "depth", None, 0.5, 2, "code"), ("r\"1", "clarity", 0.25, 0.5, 2, "code")], "id string, criterion string, score double, aggregate double, batch_no long, label string")
    out = rows.join(blocks.scores(scored, ["id"], "pointwise", "label"), "id", "left")
    place = blocks.source(F.col("file"), F.col("line_no"), F.lit(None).cast("long"), fields=text_fn.passed_through(F.coalesce("raw", F.lit("{}")), ["lang", "x", "none"]))
    got = {r["id"]: json.loads(r["m"]) for r in out.select("id", blocks.meta(F.col("id"), F.lit('{"tool":"t"}'), place, scores=F.col("scores"), dedup=F.lit('{"kind":"unique"}')).alias("m")).collect()}
    one, two = got['r"1'], got["r2"]
    assert list(one) == ["id", "run", "source", "stream", "scores", "dedup", "classification", "annotation", "verification"] and one["id"] == 'r"1'
    assert one["source"] == {"file": "a.jsonl", "line_no": 3, "generated_from": [], "fields": {"lang": "en", "x": None}}
    assert one["scores"] == {"clarity": 0.25, "depth": None, "__aggregate__": 0.5, "mode": "pointwise", "batch_no": 2, "pool": "code"}
    assert two["scores"] is None and two["source"]["pair_index"] is None and "line_no" not in two["source"]
    with pytest.raises(ValueError):
        blocks.meta(F.col("id"), F.lit("{}"), place, other=F.lit("{}"))


def test_rejects_and_payloads(spark):
    row = spark.createDataFrame([("a", "quality", "schema_violation", ["e1"], None, '{"text":"x"}')], "id string, stage string, reason string, errors array<string>, label string, raw string")
    place = blocks.source(F.lit("f"), F.lit(1), F.lit(None).cast("long"))
    refs = json.loads(row.select(blocks.reject(F.col("id"), place, F.col("stage"), F.col("reason"), F.col("errors")).alias("r")).first()["r"])
    assert list(refs) == ["_meta"] and list(refs["_meta"]) == ["id", "source", "stage", "reason", "errors"]
    full = json.loads(row.select(blocks.reject(F.col("id"), place, F.col("stage"), F.col("reason"), F.col("errors"), F.col("label"), F.col("raw"), F.lit('{"a')).alias("r")).first()["r"])
    assert full["_meta"]["label"] is None and full["record"] == {"text": "x"} and full["raw_last_output"] == '{"a'
    ids = F.array(F.lit("m1"))
    kinds = [json.loads(row.select(blocks.raw_payload(F.lit(k), F.col("raw"), F.lit("Button"), F.lit("i.png"), ids, ids).alias("p")).first()["p"]) for k in ("text", "ui", "sequence")]
    assert kinds == [{"text": "x"}, {"ui_tree": "Button", "image_path": "i.png"}, {"kind": "sequence", "member_ids": ["m1"], "member_sources": ["m1"]}]
    stream = row.select(F.to_json(blocks.stream(F.lit("e"), F.lit("s"), F.array(F.struct(F.lit("m1").alias("id"), F.lit("f:1").alias("source"))), F.array(F.lit(1.0), F.lit(2.0))), {"ignoreNullFields": "false"}).alias("s")).first()["s"]
    assert json.loads(stream) == {"episode_id": "e", "session_id": "s", "order_span": [1.0, 2.0], "member_count": 1, "member_ids": ["m1"], "member_sources": ["f:1"], "session_split": False, "repaired": False, "degraded": None, "steps": None}


def test_traces_are_thinned(spark):
    items = spark.createDataFrame([("a", 1, "unique", None, None, "code", 0.7, "active", "{}", None), ("b", 1, "exact", "k", "a", None, None, "dropped_dup", None, None), ("c", 1, "unique", None, None, None, None, "failed", None, "bad")], "id string, batch_no long, kind string, cluster_key string, kept_id string, label string, aggregate double, status string, output string, reason string")
    every = trace.of_items(items)
    assert sorted(r["ev"] for r in every.collect()) == ["annotate.done", "classify.decision", "dedup.duplicate", "error", "quality.gate"]
    some = {r["ev"]: r for r in trace.traced(every, ["dedup"], "refs").collect()}
    assert some.keys() == {"dedup.duplicate", "error"} and some["dedup.duplicate"]["record_ids"] == ["b", "a"]
    assert set(some["dedup.duplicate"]["payload"]) == {"kind", "cluster_id"} and len(trace.EVENTS) == 27
    with pytest.raises(ValueError):
        trace.events(items, "dedup.other", ["id"])
    assert trace.summary({"emitted": 3})[1].endswith("emitted=3") and "dropped_dup=0" in trace.progress(2, {})


def test_caps_of_screens():
    lines = "\n".join(f"Button {k}" for k in range(50))
    cut = fit.capped_tree(lines, 100)
    assert len(cut) <= 100 and cut.endswith(f"…(truncated {50 - cut.count(chr(10))} nodes)")
    again = fit.capped_tree(cut, 60)
    assert again.endswith(f"…(truncated {50 - again.count(chr(10))} nodes)") and fit.capped_tree(lines, 1000) == lines
    assert fit.capped_tree(lines, 3) == "…(truncated 50 nodes)"
    assert fit.estimate(fit.capped_tree(lines, 40, fit.estimate)) <= 40


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": 1}\n\n  \n{"x": 2}\n')
    assert jsonl.scan_counts(spark, str(tmp_path)) == 2
    assert [tuple(r) for r in jsonl.seed_pool(spark, ["x", "y"]).collect()] == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in jsonl.seed_pool(spark, [], 2).collect()] == [(1, None), (2, None)] and jsonl.seed_pool(spark, []).count() == 0
    pairs = spark.createDataFrame([(1, "t", "i", "pair"), (2, "t", None, "missing_image"), (3, "t", "i", "conflict")], "idx long, tree string, image string, state string")
    assert [r["idx"] for r in ui.required_pairs(pairs, "skip", "skip").collect()] == [1]
    for policies in (("fail", "skip"), ("skip", "fail")):
        with pytest.raises(jsonl.InputError):
            ui.required_pairs(pairs, *policies)


def test_rubrics_environment_examples():
    assert all(len(own) == 6 for own in rubrics.levels("ui").values()) and rubrics.level_faults({"a": ["x"] * 5, "b": ["x"] * 6}) == ["a: six levels expected, not 5"]
    given = config.from_environment({"MILLRACE_RUN__BATCH_SIZE": "7", "MILLRACE_RUN__OUTPUT": "/o ut", "OTHER": "1", "MILLRACE_X": "2"})
    loaded = config.load('[run]\ninput = "i"\noutput = "o"\nmodality = "text"\n', given)
    assert loaded["run"]["batch_size"] == 7 and loaded["run"]["output"] == "/o ut"
    shape = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}
    assert config.example_faults([{"output": {"a": "x"}}, {"output": {}}], shape) == ["examples 2: /a: missing"]
    assert config.example_faults([{"output": {"a": "x"}}], shape, lambda o: 3) == ["examples 1: TypeError: a check must return a list, not int"]
    assert config.example_faults([], shape | {"oneOff": []}) == ["output.schema: oneOff isn't known"]
    assert config.prompt_faults({"quality": 5000, "verify": 10}, 8192, 4096) == ["quality: 5000 tokens before any record, 3276 allowed"] and config.prompt_faults({"a": 9}, 0, 1) == []


def test_first_verdicts_and_class_gates(spark):
    items = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5), (3, "b", None), (4, None, 0.9)], "id long, label string, aggregate double")
    told = spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "id long, ord int, winner string")
    assert {r["id"]: r["winner"] for r in votes.first_verdicts(items, told, ["id"], "ord", "winner", "tie").collect()} == {1: "A", 2: "tie", 3: "tie", 4: "tie"}
    views = spark.createDataFrame([("b", 0.4, "drop")], "label string, threshold double, on_unscored string")
    gated = {r["id"]: r["status"] for r in votes.class_gate(items, views, "label", "aggregate", 0.6).collect()}
    assert gated == {1: "dropped_lowq", 2: "active", 3: "dropped_lowq", 4: "active"}


def episode(name, at, apps, verdict="new", ref=None, again="new", ref2=None):
    return {"episode_id": name, "head_pos": at, "tail_pos": at + 1, "apps": [apps], "head_entities": [], "tail_entities": [], "head_page": None, "tail_page": None, "verdict": verdict, "thread_ref": ref, "verdict2": again, "thread_ref2": ref2}


def test_second_pass():
    rows = [episode("a", 0, "mail"), episode("b", 2, "maps"), episode("c", 4, "mail", again="resume", ref2=1), episode("d", 6, "maps", "resume", 2)]
    frame = pd.DataFrame(rows)
    assert stitch.walk(frame) == ["a", "b", "c", "b"]
    assert stitch.walk(frame, repass=True) == ["a", "b", "c", "b"]  # the latest other thread is b, which shares no ground
    frame.loc[2, "thread_ref2"] = 2
    assert stitch.walk(frame, repass=True) == ["a", "b", "a", "b"]
    asked = []

    def judge(cards, e, again):
        asked.append((e.episode_id, again, [t.name for t in cards]))
        return "new", None

    stitch.walk(frame, max_open=1, judge=judge, repass=True)
    assert asked[:4] == [("a", False, []), ("b", False, ["a"]), ("c", False, ["b"]), ("d", False, ["c"])]
    assert asked[4:] == [("a", True, ["b"]), ("b", True, ["a"]), ("c", True, ["b"]), ("d", True, ["c"])]  # the nearest, earlier ones first
    assert stitch.Thread("x", {"mail"}, {"to"}, head_pos=1, tail_pos=4).card(1) == "1: mail; frames 1 to 4; 1 parts; last seen: to"


def test_embeddings_probe_usage():
    profile = Profile("p", "http://x", "m", ("k",), retries=0)
    replies = {"/embeddings": {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, "/chat/completions": {"choices": [{"message": {"content": "H"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}}
    judge = HttpJudge(profile, send=lambda url, h, d, t: (200, {}, json.dumps(replies[url.removeprefix("http://x")]).encode()))
    assert judge.embed(["a", "b"]) == [[1], [2]] and judge.probe()[0]
    assert usage_of(replies["/chat/completions"]) == (3, 1) and usage_of({}) == (0, 0)
    assert not HttpJudge(profile, send=lambda *a: (400, {}, b"no")).probe()[0]
    png = b"\x89PNG...."
    assert body(profile, "", "q", images=(png, b"\xff\xd8\xff"))["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/jpeg;base64,")
    assert [p["type"] for p in body(Profile("p", "u", "m", (), "messages"), "", "q", images=(png,))["messages"][0]["content"]] == ["image", "text"]


def test_embedded_rows(spark):
    class Model:
        def embed(self, texts):
            if "bad" in texts:
                raise ValueError("no")
            return [[len(t), 1] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "abcdef"), (4, "bad")], "id long, text string").repartition(1)
    got = {r["id"]: (r["embedding"], r["problem"]) for r in embedded(rows, Model, ["id"], "text", head_chars=4, together=1).collect()}
    assert got == {1: ([3.0, 1.0], None), 2: ([0.0, 1.0], None), 3: ([4.0, 1.0], None), 4: (None, "ValueError: no")}


def test_late_rows_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate([[("a", 5.0), ("b", 1.0), ("a", 4.0)], [("a", 4.5), ("a", 6.0), ("b", 2.0)]]):
        pd.DataFrame(rows, columns=["k", "o"]).to_json(source / f"{k}.json", orient="records", lines=True)
    events = spark.readStream.schema("k string, o double").option("maxFilesPerTrigger", 1).json(str(source))
    stream = live_order(events, "k", "o").writeStream.format("memory").queryName("late_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = {(r["k"], r["o"]): r["late"] for r in spark.table("late_rows").collect()}
    assert got == {("a", 5.0): False, ("b", 1.0): False, ("a", 4.0): True, ("a", 4.5): True, ("a", 6.0): False, ("b", 2.0): False}
