"""A stream of text frames, from lines to episodes, with and without a judge."""

import json
import re

from millrace.plans import config, stream
from millrace.plans.run import Verdicts, process


def write(tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    return f'[run]\ninput = "{tmp_path}/in"\noutput = "{tmp_path}/out"\nmodality = "text"\nbatch_size = 5\n[stream]\norder_by = "meta:ts"\nkey = ["device"]\ngap_s = 100\nsession_max_len = 6\n[segment]\nenabled = true\nwindow = 4\n'


ROWS = [{"text": t, "ts": ts, "device": d} for t, ts, d in [
    ("open shop", 0, "x"), ("AD", 10, "x"), ("find shoes", 20, "x"), ("NEW maps", 30, "x"), ("route", 40, "x"), ("late", 5, "x"),
    ("open shop", 500, "x"), ("find shoes", 520, "x"), ("hello", 0, "y"), *[(f"step {k}", 1000 + k, "y") for k in range(8)], ("no time", "soon", "y"),
]]


def test_by_rules(spark, tmp_path):
    records, frames, bad = stream.read(spark, config.load(write(tmp_path, ROWS)))
    got = {r["text"].replace(stream.BETWEEN, "|"): (r["batch_no"], r["split"], len(r["members"])) for r in records.collect()}
    assert got == {"open shop|AD|find shoes|NEW maps|route": (1, False, 5), "open shop|find shoes": (2, False, 2), "hello": (2, False, 1), "step 0|step 1|step 2|step 3|step 4": (3, True, 5), "step 5": (4, True, 1), "step 6|step 7": (5, False, 2)}
    counts = {(r["status"], r["reason"]): r["count"] for r in frames.groupBy("status", "reason").count().collect()}
    assert counts == {("absorbed", None): 16, ("dropped_noise", "disorder"): 2} and bad.count() == 0


def test_with_a_judge(spark, tmp_path):
    class Rule:
        """AD is an interruption, NEW a switch; windows of steps get no answer in shape."""

        def answer(self, prompts):
            out = []
            for p in prompts:
                lines = re.findall(r"^(\d+): (.*)$", p, re.M)
                entries = [{"index": int(k), "relation": "interruption" if t == "AD" else "context_switch" if t.startswith("NEW") else "continues"} for k, t in lines]
                out.append("?" if "step" in p else json.dumps({"frames": entries}))
            return out

    c = config.load(write(tmp_path, ROWS))
    records, frames, _ = stream.read(spark, c, Rule)
    got = {r["text"].replace(stream.BETWEEN, "|"): r["degraded"] for r in records.collect()}
    assert got == {"open shop|find shoes": False, "NEW maps|route": False, "hello": False, "step 0|step 1|step 2|step 3|step 4": True, "step 5": True, "step 6|step 7": True}
    assert records.count() == 7  # the same words twice are two episodes until dedup
    counts = {(r["status"], r["reason"]): r["count"] for r in frames.groupBy("status", "reason").count().collect()}
    assert counts == {("absorbed", None): 15, ("dropped_noise", "noise"): 1, ("dropped_noise", "disorder"): 2}
    kinds = {r["kind"]: r["count"] for r in process(records, c, Verdicts()).groupBy("kind").count().collect()}
    assert kinds == {"unique": 6, "exact": 1}


def test_sessions_beyond_a_batch_are_cut_hard(spark, tmp_path):
    """Sessions of 10 and 9 frames in batches of 8: slices of 8, 2, 8 and 1, each a batch, all marked; short ones never are."""
    rows = [{"text": f"a {k}", "ts": k, "device": "x"} for k in range(10)] + [{"text": f"b {k}", "ts": 1000 + k, "device": "x"} for k in range(9)]
    rows += [{"text": f"c {k}", "ts": 5000 + k, "device": "x"} for k in range(3)] + [{"text": f"d {k}", "ts": 9000 + k, "device": "x"} for k in range(5)]
    text = write(tmp_path, rows).replace("batch_size = 5", "batch_size = 8").replace("session_max_len = 6", "session_max_len = 200")
    records, _, _ = stream.read(spark, config.load(text))
    got = sorted((r["batch_no"], r["split"], len(r["members"]), r["text"][0]) for r in records.collect())
    assert got == [(1, True, 8, "a"), (2, True, 2, "a"), (3, True, 8, "b"), (4, True, 1, "b"), (5, False, 3, "c"), (5, False, 5, "d")]
