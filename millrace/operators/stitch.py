"""Episodes to threads: a bounded pool of open threads, walked in session order."""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_OPEN = 4


def prior_legs(apps_a: Column, apps_b: Column, tail_entities: Column, head_entities: Column, tail_pages: Column, head_page: Column) -> Column:
    """Which of the mechanical priors hold: app_overlap, entity_overlap, same_page."""
    legs = [("app_overlap", F.arrays_overlap(apps_a, apps_b)), ("entity_overlap", F.arrays_overlap(tail_entities, head_entities)), ("same_page", F.array_contains(tail_pages, head_page))]
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in legs]))


@dataclass
class Thread:
    name: str
    apps: set = field(default_factory=set)
    tail: set = field(default_factory=set)
    pages: set = field(default_factory=set)
    head_pos: int = 0
    tail_pos: int = 0
    active: int = 0
    parts: int = 1
    alive: bool = True

    def card(self, number: int) -> str:
        """The thread as a line of a prompt."""
        return f"{number}: {', '.join(sorted(self.apps))}; frames {self.head_pos} to {self.tail_pos}; {self.parts} parts; last seen: {', '.join(sorted(self.tail))}"


def by_columns(cards: list[Thread], episode, again: bool) -> tuple[str, float | None]:
    """The verdict that the episode's own columns hold; those of the second pass end with 2, and without them it says new."""
    mark = "2" if again else ""
    return getattr(episode, f"verdict{mark}", "new"), getattr(episode, f"thread_ref{mark}", None)


def apart(a: Thread, b: Thread) -> int:
    """Frames from one thread's span to the other's; 0 where they overlap."""
    return max(0, a.head_pos - b.tail_pos, b.head_pos - a.tail_pos)


def walking(episodes: pd.DataFrame, max_open: int = MAX_OPEN, stale: int = 0, conservative: bool = True, repass: bool = False) -> Generator[tuple[list[Thread], Any, bool], tuple[str, float | None], list[str]]:
    """A session's walk as a dialogue: yields each question (open threads, latest first; the episode; whether it is the
    second pass), takes its verdict (resume or new, and the 1-based place of the thread), and returns what `walk` does.
    """
    pool: list[Thread] = []
    threads: list[Thread] = []
    rows = list(episodes.itertuples(index=False))
    own: list[Thread] = []
    clock = 0

    def joined(cards: list[Thread], e, told: tuple[str, float | None]) -> Thread | None:
        verdict, ref = told
        if verdict != "resume" or ref is None or ref != ref or not 1 <= int(ref) <= len(cards):
            return None
        thread = cards[int(ref) - 1]
        legs = bool(thread.apps & set(e.apps)) + bool(thread.tail & set(e.head_entities)) + (e.head_page is not None and e.head_page in thread.pages)
        needed = 2 if stale and e.head_pos - thread.tail_pos > stale else 1
        return thread if not conservative or legs >= needed else None

    def take_in(target: Thread, e) -> None:
        target.apps |= set(e.apps)
        if e.tail_pos >= target.tail_pos:
            target.tail = set(e.tail_entities)
        target.head_pos, target.tail_pos, target.active = min(target.head_pos, int(e.head_pos)), max(target.tail_pos, int(e.tail_pos)), clock
        if e.tail_page is not None:
            target.pages.add(e.tail_page)

    for e in rows:
        cards = sorted(pool, key=lambda t: -t.active)
        target = joined(cards, e, (yield cards, e, False))
        if target is None:
            if len(pool) >= max_open:
                idle = [t for t in pool if stale and e.head_pos - t.tail_pos > stale] or pool
                pool.remove(min(idle, key=lambda t: t.active))
            target = Thread(e.episode_id, head_pos=int(e.head_pos), tail_pos=int(e.tail_pos))
            pool.append(target)
            threads.append(target)
        else:
            target.parts += 1
        take_in(target, e)
        own.append(target)
        clock += 1
    for single in sorted((t for t in threads if repass and t.parts == 1), key=lambda t: t.head_pos):
        others = [t for t in threads if t.alive and t is not single]
        if single.parts > 1 or not others:
            continue
        near = sorted(others, key=lambda t: (apart(single, t), t.head_pos))[:max_open] if len(others) > max_open else others
        e = rows[own.index(single)]
        cards = sorted(near, key=lambda t: -t.active)
        target = joined(cards, e, (yield cards, e, True))
        if target is not None:
            single.alive = False
            target.parts += 1
            take_in(target, e)
            own = [target if t is single else t for t in own]
        clock += 1
    return [t.name for t in own]


def walk(episodes: pd.DataFrame, max_open: int = MAX_OPEN, stale: int = 0, conservative: bool = True, judge=by_columns, repass: bool = False) -> list[str]:
    """Thread of each episode of a session, by position; a thread is named by its first episode.

    judge: takes the open threads, latest first, the episode and whether it is the second pass; gives resume or new
    and the 1-based place of the thread. The verdict joins an episode to a thread only if a prior holds too, two of
    them where the thread has been idle for more than `stale` steps. A full pool closes its idlest thread, stale ones
    first. repass: threads of one episode are then judged once more, in order, against the others, the `max_open`
    nearest ones where there are more; one that joins another takes that one's name.
    """
    dialogue = walking(episodes, max_open, stale, conservative, repass)
    told = None
    while True:
        try:
            question = dialogue.send(told)
        except StopIteration as end:
            return end.value
        told = judge(*question)


def fragments(stitched: DataFrame, session: str) -> DataFrame:
    """(session, thread_id, first_pos, last_pos, len, cause) of each run of a thread's episodes: origin, then resumed.

    stitched: (session, thread_id, episode_id, head_pos, tail_pos, len).
    """
    place = F.row_number().over(Window.partitionBy(session, "thread_id").orderBy("head_pos", "episode_id"))
    return stitched.select(session, "thread_id", F.col("head_pos").alias("first_pos"), F.col("tail_pos").alias("last_pos"), "len", F.when(place == 1, "origin").otherwise("resumed").alias("cause"))


def merged_members(members: DataFrame, threads: DataFrame, session: str) -> DataFrame:
    """(session, thread_id, pos, frame) of all frames of each thread: the members of its episodes, each once, by place."""
    return members.join(threads.select(session, "episode_id", "thread_id"), [session, "episode_id"]).select(session, "thread_id", "pos", "frame").distinct()


def stitch(episodes: DataFrame, session: str, **options) -> DataFrame:
    """(session, episode_id, thread_id) of every episode; a session is one bounded group (its length is capped).

    Columns read: episode_id, head_pos, tail_pos, apps, head_entities, tail_entities, head_page, tail_page and, for the
    judge by columns, verdict, thread_ref, verdict2, thread_ref2. Options are those of `walk`; a `judge` option that
    calls a model is called inside the walk, as its cards depend on what came before.
    """
    kind = dict(episodes.dtypes)[session]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["head_pos", "episode_id"])
        return pd.DataFrame({session: pdf[session], "episode_id": pdf["episode_id"], "thread_id": walk(pdf, **options)})

    return episodes.groupBy(session).applyInPandas(one, f"{session} {kind}, episode_id string, thread_id string")
