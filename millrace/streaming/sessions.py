"""Structured Streaming forms of sessions and counts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import lanes
from millrace.operators.ranks import ranks


def live_sessions(events: DataFrame, key: str, ts: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, len) of event-time sessions; rows later than the watermark are dropped; `live_order` tells and counts rows out of order."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("len")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "len")


def live_counts(events: DataFrame, kind: str, ts: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of each kind in tumbling or sliding windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def live_order(events: DataFrame, key: str, order: str) -> DataFrame:
    """`events` with `late`: whether a row's order lies below one that its key had before, in this batch or an earlier one.

    The state of a key is one number, the largest order so far; rows of a batch are taken in the order they come.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)

    def mark(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else float("-inf")
        for part in parts:
            before = part[order].cummax().shift(fill_value=float("-inf")).clip(lower=top)
            top = max(top, part[order].max())
            yield part.assign(late=part[order] < before)
        state.update((float(top),))

    return events.groupBy(key).applyInPandasWithState(mark, f"{fields}, late boolean", "top double", "append", GroupStateTimeout.NoTimeout)


def exact_sessions(events: DataFrame, lane: list[str], seq: str, order: str, record: str, ts: str, boundary: str | None = None, gap_s: float = 300, max_len: int = 200, max_span_s: float = 0, late: str = "10 minutes") -> DataFrame:
    """(lane, first_seq, last_seq, len, cause, sha, first_edge, last_edge) of each closed session, by all the rules of `operators.sessions.sessions`.

    A lane's open session is its state: where it began, its last row and at most `max_len` records. It closes when a row
    comes that can't go on with it, at `max_len`, or by a timer once the watermark of `ts` is `gap_s` behind its last
    order key, as then no row can. Rows of a lane come in order of `seq`, from part to part; those that `live_order`
    calls late should be gone. `order` is in seconds, of the same clock as `ts`. See `settled` for the causes of
    sessions that timers close.
    """
    kinds = dict(events.dtypes)
    fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in lane], "first_seq long, last_seq long, len long, cause string, sha string, first_edge string, last_edge string"])

    def closed(key: tuple, held: dict, cause: str) -> tuple:
        sha = hashlib.sha256("\n".join(held["records"]).encode()).hexdigest()
        return (*key, held["first"], held["last"], len(held["records"]), cause, sha, held["first_edge"], held["edge"])

    def walk(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = (json.loads(state.get[0]) if state.exists else None), []
        if state.hasTimedOut:
            out.append(closed(key, held, "timer"))
            held = None
        else:
            rows = pd.concat(list(parts)).sort_values(seq)
            edges = rows[boundary] if boundary else [None] * len(rows)
            for at, when, what, edge in zip(rows[seq], rows[order], rows[record], edges, strict=True):
                edge = None if edge is None or pd.isna(edge) else str(edge)
                if held is not None:
                    moved = held["edge"] is not None and held["edge"] != edge
                    why = "key" if moved else "gap" if when - held["order"] > gap_s else "max_span" if max_span_s and when - held["start"] > max_span_s else None
                    if why:
                        out.append(closed(key, held, why))
                        held = None
                if held is None:
                    held = {"first": int(at), "start": float(when), "records": [], "first_edge": edge}
                held |= {"last": int(at), "order": float(when), "edge": edge}
                held["records"].append(str(what))
                if len(held["records"]) == max_len:
                    out.append(closed(key, held, "max_len"))
                    held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(int((held["order"] + gap_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[*lane, "first_seq", "last_seq", "len", "cause", "sha", "first_edge", "last_edge"])

    own = events.withWatermark(ts, late).groupBy(*lane)
    return own.applyInPandasWithState(walk, fields, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def settled(closed: DataFrame, lane: list[str]) -> DataFrame:
    """What `exact_sessions` has delivered so far, as `operators.sessions.sessions` tells it: lane, session_id, repeat, first_seq, last_seq, len, cause.

    A session that a timer closed ended by what came next in its lane: another key, else the gap, else the input's end.
    """
    looked = lanes.scan(lanes.parted(closed, lane, ["first_seq"]).df, ["first_seq"], after={"_next": F.col("first_seq"), "_edge": F.col("first_edge")})
    moved = F.col("last_edge").isNotNull() & ~F.col("last_edge").eqNullSafe(F.col("_edge"))
    cause = F.when(F.col("cause") != "timer", F.col("cause")).when(F.col("_next").isNull(), "eof").when(moved, "key").otherwise("gap")
    out = ranks(looked.withColumn("cause", cause), ["sha"], [F.col("first_seq"), *[F.col(c) for c in lane]], "repeat")
    return out.select(*lane, F.substring("sha", 1, 16).alias("session_id"), (F.col("repeat") - 1).alias("repeat"), "first_seq", "last_seq", "len", "cause")
