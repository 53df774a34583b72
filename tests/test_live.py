"""A whole run with a judge that answers by rule."""

import json
import re

from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.operators import ranks
from millrace.plans import config
from millrace.plans.live import run_live


def read(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_a_live_run(spark, tmp_path):
    class Rule:
        """Longer texts are better, texts about bread are of class food, answers to trips fail their review."""

        def answer(self, prompts):
            return [self.one(p) for p in prompts]

        def one(self, prompt):
            if prompt.startswith("Name the class"):
                return '{"class": "food"}' if "bread" in prompt else '{"class": "sport"}' if "again" not in prompt else '{"class": "rest"}'
            if prompt.startswith("Compare"):
                a, b = (re.search(rf"{s}:\n(.*)", prompt)[1] for s in "AB")
                names = re.search("each of: (.*)\\.", prompt)[1].split(", ")
                side = "A" if len(a) > len(b) else "B"
                return json.dumps({"judgments": [{"criterion": n, "winner": side} for n in names]})
            if prompt.startswith("Say what is wrong"):
                return json.dumps({"critiques": [{"aspect": "trip", "opinion": "no"}], "verdict": "fail" if "trip" in prompt else "pass"})
            return "```json\n" + json.dumps({"topic": "t"}) + "\n```"

    texts = ["how do I bake bread at home without an oven", "how do I bake bread at home without an oven", "bread", "plan a trip of three days to the mountains", "tell me a story about a lighthouse keeper and the sea", "a"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in texts))
    project = f'''[run]\ninput = "{tmp_path}/in"\noutput = "{tmp_path}/out"\nmodality = "text"
[classify]\nenabled = true\nclasses = ["food", "rest"]\nfallback_class = "rest"
[quality]\nthreshold = 0.4\n[verify]\nenabled = true\n'''
    told = run_live(spark, config.load(project), Rule, shapes.strict(topic=shapes.TEXT))
    rows = read(tmp_path / "out" / "main")
    counts = told["counts"]
    assert counts["balanced"] and (counts["dropped_dup"], counts["dropped_lowq"], counts["dropped_verify"], counts["active"]) == (1, 2, 1, 2)
    assert sorted(r["_meta"]["classification"]["label"] for r in rows) == ["food", "rest"] and all(r["topic"] == "t" and r["_meta"]["scores"]["__aggregate__"] >= 0.4 for r in rows)
    assert {(r["_meta"]["stage"], r["_meta"]["reason"]) for r in read(tmp_path / "out" / "rejects")} == {("dedup", "exact"), ("quality", "below_threshold"), ("verify", "verify_fail")}


def test_ranks_of_large_and_small_pools(spark):
    rows = [(p, k % 7 if k % 5 else None, k) for p, n in (("a", 900), ("b", 1), (None, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "p string, v int, k int")
    got = {(r["p"], r["k"]): r["rank"] for r in ranks.ranks(df, ["p"], [F.col("v").desc_nulls_last(), F.col("k")]).collect()}
    pct = {(r["p"], r["k"]): r["pct"] for r in ranks.percentiles(df, ["p"], "v").collect()}
    for p in ("a", "b", None):
        own = [r for r in rows if r[0] == p]
        order = sorted(own, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[p, r[2]] for r in order] == list(range(1, len(own) + 1))
        for r in own:
            value = -1 if r[1] is None else r[1]
            less, same = (sum(f(-1 if x[1] is None else x[1]) for x in own) for f in (lambda v: v < value, lambda v: v == value))
            assert abs(pct[p, r[2]] - (0.5 if len(own) == 1 else (less + (same - 1) / 2) / (len(own) - 1))) < 1e-12
