"""Threads with a live judge: sessions are walked side by side, one question a session and round.

What a session asks next follows from the answers that it has had, so a session's state is the table of its answers:
each round replays the walk up to its next question, all questions are asked at once, several times where samples vote,
and the answers are written before the next round reads them. A lost task replays answers, it doesn't ask again. Rounds
are as many as the questions of the longest session, whose length is capped.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.judges import Judge
from millrace.operators import stitch, votes
from millrace.plans import calls
from millrace.runtime import Written

_READ = ("episode_id", "head_pos", "tail_pos", "apps", "head_entities", "tail_entities", "head_page", "tail_page")


def question(cards: list[stitch.Thread], episode, again: bool) -> str:
    """The prompt of one question."""
    shown = "\n".join(t.card(k) for k, t in enumerate(cards, 1)) or "none"
    own = f"{', '.join(sorted(episode.apps))}; frames {episode.head_pos} to {episode.tail_pos}; begins with: {', '.join(sorted(episode.head_entities))}"
    head = "Look once more: does the part go on with one of the other threads?" if again else "Does the part go on with one of the open threads?"
    return "\n".join([head, "Threads:", shown, "Part:", own, calls.told(shapes.JOIN)])


def _replayed(options: dict, session: str, kind: str):
    """(session, step, prompt, episode_id, thread_id): the next question of a session, or, where there is none, its threads."""

    def one(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["head_pos", "episode_id"])
        columns = [session, "step", "prompt", "episode_id", "thread_id"]
        if not len(own):
            return pd.DataFrame([], columns=columns, dtype=object)
        name, answers = own[session].iloc[0], told.sort_values("step")
        dialogue, asked = stitch.walking(own[list(_READ)], **options), None
        try:
            asked = dialogue.send(None)
            for verdict, ref in zip(answers["verdict"].tolist(), answers["thread_ref"].tolist(), strict=True):
                asked = dialogue.send((verdict, None if pd.isna(ref) else ref))
        except StopIteration as end:
            return pd.DataFrame([(name, None, None, e, t) for e, t in zip(own["episode_id"].tolist(), end.value, strict=True)], columns=columns, dtype=object)
        return pd.DataFrame([(name, len(answers), question(*asked), None, None)], columns=columns, dtype=object)

    return one, f"`{session}` {kind}, step long, prompt string, episode_id string, thread_id string"


def stitch_live(episodes: DataFrame, session: str, make: Callable[[], Judge], samples: int = 1, repairs: int = 2, **options) -> DataFrame:
    """(session, episode_id, thread_id) of every episode, as `stitch.walk` gives them with the judge's verdicts.

    Each question is asked `samples` times; a verdict and thread that more than half of the answers name holds, else the
    part is new, as it is where no answer has the shape. Options are those of `stitch.walking`. Sessions are not null.
    """
    kind = dict(episodes.dtypes)[session]
    own = Written(episodes.select(session, *_READ), "episodes")
    one, schema = _replayed(options, session, kind)
    spark = episodes.sparkSession
    answers = spark.createDataFrame([], f"`{session}` {kind}, step long, verdict string, thread_ref long")
    open_, done, spent = own.df, [], []
    while True:
        step = Written(open_.groupBy(session).cogroup(answers.groupBy(session)).applyInPandas(one, schema), "questions")
        ended = step.df.where("prompt is null")
        done.append(ended.select(session, "episode_id", "thread_id"))
        asked = step.df.where("prompt is not null")
        if asked.isEmpty():
            break
        plan = asked.select(session, "step", "prompt", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
        got = calls.answered(plan, make, [session, "step", "sample"], shapes.JOIN, repairs)
        told = got.select(session, "step", F.get_json_object("output", "$.verdict").alias("verdict"), F.get_json_object("output", "$.thread_ref").cast("long").alias("thread_ref"))
        told = told.withColumn("verdict", F.coalesce("verdict", F.lit("new"))).withColumn("thread_ref", F.when(F.col("verdict") == "resume", F.col("thread_ref")))
        held = votes.strict_majority(told, [session, "step"], ["verdict", "thread_ref"])
        settled = asked.select(session, "step").join(held, [session, "step"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("new")))
        grown = Written(answers.unionByName(settled.select(session, "step", "verdict", "thread_ref")), "stitch-answers")
        for table in spent:
            table.drop()
        spent, answers = [grown], grown.df
        open_ = own.df.join(asked.select(session), session, "left_semi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    result = Written(out, "threads")
    for table in (*spent, own):
        table.drop()
    return result.df
