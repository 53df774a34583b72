"""Judge calls from plan to resolution, greedy cuts, shapes of answers."""

import json
import random

import numpy as np
import pytest
from compare import agree
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.operators import chains, dedup
from millrace.plans import calls, registry_calls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry_calls.ORACLES))
def test_oracle(spark, name):
    agree(spark, SF, registry_calls.QUERIES[name], registry_calls.ORACLES[name])


def test_images_against_brute_force(spark):
    rng = random.Random(3)
    codes: list[int] = []
    for _ in range(300):
        base = rng.choice(codes) if codes and rng.random() < 0.6 else rng.getrandbits(64)
        codes.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(10))))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "seq long, code long")
    got = {r["later"]: (r["earlier"], r["similarity"]) for r in dedup.near_image(df, "seq", "code").collect()}
    kept, want = [], {}
    for k, c in enumerate(codes):
        near = min(((c ^ codes[e]).bit_count(), e) for e in kept) if kept else (99, 0)
        if near[0] <= dedup.IMAGE_BITS:
            want[k] = (near[1], float(near[0]))
        else:
            kept.append(k)
    assert got == want and 30 < len(want) < 270


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_greedy_whatever_counts_as_few(spark, few):
    rng = random.Random(few)
    points = [rng.randrange(60) for _ in range(80)]
    rows = [(k, b) for k, p in enumerate(points) for b in (p // 4, (p + 2) // 4 + 100)]
    near = lambda a, b: abs(points[a] - points[b]) <= 1 and bool({points[a] // 4, (points[a] + 2) // 4 + 100} & {points[b] // 4, (points[b] + 2) // 4 + 100})
    values = spark.createDataFrame(list(enumerate(points)), "seq long, feature long")

    class Close:
        def column(self, a, b):
            return F.when(F.abs(a - b) <= 1, (-F.abs(a - b)).cast("double"))

        def __call__(self, a, b):
            apart = np.abs(a[:, None] - b[None, :]).astype(float)
            return np.where(apart <= 1, -apart, np.nan)

    buckets = spark.createDataFrame([(k, b, 0) for k, b in rows], "seq long, bucket long, tag int")
    got = {(r["later"], r["earlier"]) for r in dedup.greedy(buckets, values, Close(), few=few, tile=4)[0].collect()}
    kept, want = [], set()
    for k in range(len(points)):
        hits = {(k, e) for e in kept if near(k, e)}
        want |= hits
        if not hits:
            kept.append(k)
    assert got == want


def test_shapes():
    shape = shapes.window(2)
    good = {"frames": [{"index": 0, "relation": "continues"}, {"index": 1, "relation": "advances"}]}
    assert shapes.faults(good, shape) == []
    bad = {"frames": [{"index": 2, "relation": "x", "more": 1}], "a/b": 1}
    assert shapes.faults(bad, shape) == ["/a~1b: not expected", "/frames: 2 at least, not 1", "/frames/0/index: 1 at most, not 2", '/frames/0/more: not expected', '/frames/0/relation: one of ["continues", "advances", "returns_to_entry", "context_switch", "interruption"] expected']
    assert shapes.faults(True, {"type": "integer"}) and not shapes.faults(None, shapes.TEXT_OR_NULL) and shapes.faults([], shape) == ["/: object expected"]
    assert shapes.unknown_words({"type": "array", "items": {"oneOff": []}, "uniqueItems": True}) == ["oneOff isn't known"]
    assert shapes.shaped('```json\n{"class": "a"}\n```', shapes.classes(["a"]))[:2] == ('{"class":"a"}', [])
    assert shapes.shaped('{"class": "a"', shapes.classes(["a"])) == ('{"class":"a"}', [], True)
    assert shapes.shaped("nothing", shapes.classes(["a"]))[:2] == (None, ["/: no object"]) and shapes.shaped(None, shape)[1] == ["/: no answer"]
    assert shapes.shaped('{"class": "a"}', shapes.classes(["a"]), lambda o: ["no a please"])[1] == ["no a please"]
    assert shapes.canonical({"b": 1, "a": {"d": "é", "c": None}}) == '{"a":{"c":null,"d":"é"},"b":1}'


def test_answers_are_asked_for_again(spark):
    class Stubborn:
        """Answers in shape only once it is told what was wrong."""

        def answer(self, prompts):
            return ['{"class": "a"}' if "one of" in p or "easy" in p else ValueError("down") if "dead" in p else '{"class": "z"}' for p in prompts]

    plan = spark.createDataFrame([(1, "easy"), (2, "hard"), (3, "dead")], "id long, prompt string")
    got = {r["id"]: (r["output"], r["rounds"], r["settled"]) for r in calls.answered(plan, Stubborn, ["id"], shapes.classes(["a"]), repairs=1).collect()}
    assert got == {1: ('{"class":"a"}', 0, "at_once"), 2: ('{"class":"a"}', 1, "asked_again"), 3: (None, 1, None)}


def test_chain_and_next_fit(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 40, 500).tolist()
    got = {r["k"]: r["first"] for r in chains.next_fit(spark.createDataFrame(list(enumerate(sizes)), "k long, n long"), "k", "n", 30).collect()}
    first = filled = 0
    for k, n in enumerate(sizes):
        if k == 0 or filled + n > 30:
            first, filled = k, 0
        filled += n
        assert got[k] == first
    nexts = [("a", 1, 3), ("a", 2, 3), ("a", 3, 9), ("b", 1, None), ("b", 2, None)]
    places = {tuple(r) for r in chains.chain(spark.createDataFrame(nexts, "p string, at long, then long"), ["p"], "at", "then").collect()}
    assert places == {("a", 1), ("a", 3), ("b", 1)}


def test_screened_samples(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "worse")], "k long, text string")

    def check(text):
        if text == "worse":
            raise KeyError("no")
        return ["too bad"] if text == "bad" else None

    got = {r["k"]: r["refused"] for r in calls.screened(rows, "text", check).collect()}
    assert got[1] == [] and got[2] == ["too bad"] and got[3][0].startswith("KeyError")


def test_prompts_hold_what_they_ask_about(spark):
    frames = spark.createDataFrame([("s", k, f"screen {k}") for k in range(39)], "s string, pos long, d string")
    plan = {(r["start"], r["end"]): r["prompt"] for r in calls.window_calls(frames, "s", "pos", "d", 20).collect()}
    assert sorted(plan) == [(0, 20), (19, 39)] and "0: screen 19" in plan[19, 39] and "19: screen 38" in plan[19, 39]
    one = calls.annotation_calls(spark.createDataFrame([(1, "hello")], "id long, text string"), ["id"], "text", "Say what it is.", shapes.classes(["a"]), [("x", '{"class":"a"}')]).first()["prompt"]
    assert "hello" in one and json.dumps(shapes.classes(["a"]), separators=(",", ":")) in one and "Text: x" in one
