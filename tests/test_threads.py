"""Threads with a live judge, round by round, against the walk of each session with the same rule; every question is asked once."""

import json
import random
import re

import pandas as pd
import pytest

from millrace.operators import stitch
from millrace.plans import threads


def parts(seed, session, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append((session, f"{session}-{k}", 10 * k, 10 * k + 5, sorted(rng.sample(["mail", "maps", "shop", "chat"], 2)), rng.sample(["a", "b", "c"], 1), rng.sample(["a", "b", "c"], 2), rng.choice(["p", "q", None]), rng.choice(["p", "q", None])))
    return out


ROWS = [r for s, n in (("s1", 9), ("s2", 1), ("s3", 6)) for r in parts(n, s, n)]
FIELDS = "session string, episode_id string, head_pos int, tail_pos int, apps array<string>, head_entities array<string>, tail_entities array<string>, head_page string, tail_page string"


def ruled(shown, own):
    """Resume the first thread that shares the part's first app."""
    for number, apps in shown:
        if own in apps:
            return "resume", number
    return "new", None


def maker(log):
    """Made here, so that tasks needn't import this module."""
    import re

    def rule(prompt):
        shown = [(int(n), apps.split(", ")) for n, apps in re.findall(r"^(\d+): ([^;]*);", prompt.split("Part:")[0], re.M)]
        own = prompt.split("Part:\n")[1].split(",")[0].split(";")[0]
        hit = next((n for n, apps in shown if own in apps), None)
        return {"verdict": "resume" if hit else "new", "thread_ref": hit, "task_name": "t", "reason": "r", "confidence": "high"}

    class Judge:
        def answer(self, prompts):
            import uuid

            (log / uuid.uuid4().hex).write_text("\n\0".join(prompts))
            out = [json.dumps(rule(p)) for p in prompts]
            return out

    return Judge


@pytest.mark.parametrize(("samples", "repass"), [(1, False), (1, True), (3, True)])
def test_rounds_are_the_walk(spark, tmp_path, samples, repass):
    df = spark.createDataFrame(ROWS, FIELDS).repartition(3)
    options = {"max_open": 2, "stale": 40, "repass": repass}
    got = threads.stitch_live(df, "session", maker(tmp_path), samples=samples, **options)
    asked, want = [], {}

    def judge(cards, e, again):
        asked.append(threads.question(cards, e, again))
        return ruled([(k, sorted(t.apps)) for k, t in enumerate(cards, 1)], sorted(e.apps)[0])

    for s in ("s1", "s2", "s3"):
        own = pd.DataFrame([r[1:] for r in ROWS if r[0] == s], columns=["episode_id", "head_pos", "tail_pos", "apps", "head_entities", "tail_entities", "head_page", "tail_page"])
        want |= dict(zip(own["episode_id"], stitch.walk(own, judge=judge, **options), strict=True))
    assert {r["episode_id"]: r["thread_id"] for r in got.collect()} == want and got.count() == len(ROWS)
    prompts = [p for f in tmp_path.iterdir() for p in f.read_text().split("\n\0")]
    assert sorted(prompts) == sorted(asked * samples)  # whatever reads the result later, nothing is asked again
    assert len(set(want.values())) < len(want)


def test_no_answer_is_new_and_no_episodes(spark, tmp_path):
    class Silent:
        def answer(self, prompts):
            return ["?" for _ in prompts]

    df = spark.createDataFrame(ROWS[:3], FIELDS)
    got = threads.stitch_live(df, "session", Silent, repairs=0, max_open=2)
    assert all(r["thread_id"] == r["episode_id"] for r in got.collect())
    assert threads.stitch_live(df.where("false"), "session", Silent).collect() == []
    assert re.search("Threads:\nnone", threads.question([], next(pd.DataFrame([ROWS[0][1:]], columns=["episode_id", "head_pos", "tail_pos", "apps", "head_entities", "tail_entities", "head_page", "tail_page"]).itertuples()), False))
