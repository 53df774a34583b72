"""Ordered streams: disorder, sessions, windows, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import lanes
from millrace.operators.chains import chain
from millrace.operators.ranks import ranks
from millrace.runtime import Written


def in_order(frames: DataFrame, key: list[str], seq: str, order: str) -> DataFrame:
    """`frames` with `late`: whether the order key lies below one seen before in its partition.

    A rejected row never raises the running maximum, so that this equals a cursor moved by accepted rows only.
    """
    looked = lanes.scan(lanes.parted(frames, key, [seq]).df, [seq], peaks={"_peak": F.col(order)})
    return looked.select(*frames.columns, F.coalesce(F.col(order) < F.col("_peak"), F.lit(False)).alias("late"))


def sessions(frames: DataFrame, lane: list[str], seq: str, order: str, record: str, boundary: str | None = None, gap_s: float = 300, max_len: int = 200, step: str | None = None, gap_steps: int = 0, file: str | None = None, max_span_s: float = 0, limited: bool = False) -> DataFrame:
    """One row a session: lane, session_id, first and last seq, len, cause.

    `lane` parts the input so that no session crosses it and each lane is walked on its own; inside a lane a
    new session begins at a change of `boundary`, at a gap above gap_s, at a step above gap_steps (in one file only,
    where `file` is given), beyond max_span_s from its first frame, and after max_len frames. 0 switches a rule off.
    `limited`: the input was cut off by a limit, which then is why the last session of a lane ends.
    """
    read = dict.fromkeys([*lane, seq, order, record, *[c for c in (boundary, step, file) if c]])
    parts = lanes.parted(frames.select(*read), lane, [seq]).df
    looked = {"_order": F.col(order)} | ({"_boundary": F.col(boundary)} if boundary else {}) | ({"_step": F.col(step)} if step else {}) | ({"_file": F.col(file)} if file else {})
    marked = lanes.scan(parts, [seq], before=looked)
    moved = F.col("_boundary").isNotNull() & ~F.col(boundary).eqNullSafe(F.col("_boundary")) if boundary else F.lit(False)
    why = F.when(moved, "key").when(F.col(order) - F.col("_order") > gap_s, "gap")
    if step and gap_steps:
        same = F.col(file).eqNullSafe(F.col("_file")) if file else F.lit(True)
        why = why.when(same & (F.col(step) - F.col("_step") > gap_steps), "gap")
    marked = lanes.runs(marked.withColumn("_why", why), [seq], F.col("_why").isNotNull(), "_run", "_at")
    if max_span_s:
        marked = _span_parts(marked, [*lane, "_run"], seq, order, max_len, max_span_s)
    else:
        marked = marked.withColumn("_part", F.floor(F.col("_at") / max_len) if max_len else F.lit(0))
    closed = marked.groupBy(*lane, "_run", "_part").agg(
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.count("*").alias("len"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, record))), lambda x: x[record].cast("string")), "\n"), 256).alias("_sha"),
        F.min_by("_why", seq).alias("_began"),
    )  # a session holds max_len records at most
    if max_span_s:
        closed = closed.withColumn("_began", F.coalesce("_began", F.lit("max_span")))
    closed = lanes.scan(lanes.parted(closed, lane, ["first_seq"]).df, ["first_seq"], after={"_next": F.col("_began"), "_follows": F.col("first_seq")})
    cause = F.when(F.col("len") == max_len, "max_len").when(F.col("_follows").isNull(), "limit" if limited else "eof").otherwise(F.col("_next"))
    out = ranks(closed.withColumn("cause", cause), ["_sha"], [F.col("first_seq"), *[F.col(c) for c in lane]], "repeat")  # the commonest short session may be a large part of all
    out = out.withColumn("repeat", F.col("repeat") - 1)
    return out.select(*lane, F.substring("_sha", 1, 16).alias("session_id"), "repeat", "first_seq", "last_seq", "len", "cause")


def _span_parts(marked: DataFrame, run: list[str], seq: str, order: str, max_len: int, max_span_s: float) -> DataFrame:
    """`marked` with `_part`: cuts of each run by span and length. Order keys don't fall inside a run; null ones span nothing.

    How far a session from a row may reach is the last row of its run up to `max_span_s` behind it: rows and the ends of
    their spans go in one order, and each end takes the largest place before it.
    """
    rows = Written(marked.drop(lanes.PART, lanes.LANE), "runs").df
    micros = F.round(F.col(order) * 1_000_000).cast("long")
    timed = rows.where(F.col(order).isNotNull()).select(*run, F.col("_at").alias("_of"), micros.alias("_when"))
    both = timed.select(*run, "_of", "_when", F.lit(0).alias("_end")).union(timed.select(*run, "_of", F.col("_when") + round(max_span_s * 1_000_000), F.lit(1)))
    by = ["_when", "_end", "_of"]
    reached = lanes.scan(lanes.parted(both, run, by).df, by, peaks={"_reach": F.when(F.col("_end") == 0, F.col("_of"))}).where("_end = 1")
    same = [rows[c].eqNullSafe(F.col(f"_in{k}")) for k, c in enumerate(run)]
    reach = reached.select(*[F.col(c).alias(f"_in{k}") for k, c in enumerate(run)], "_of", "_reach")
    far = rows.join(reach, [*same, rows["_at"] == F.col("_of")], "left")
    following = F.greatest(F.col("_reach"), F.col("_at")) + 1
    nexts = far.select(F.struct(*run).alias("_lane_run"), "_at", (F.least(following, F.col("_at") + max_len) if max_len else following).alias("_next"))
    heads = chain(nexts, ["_lane_run"], "_at", "_next").withColumn("_head", F.lit(1))
    headed = rows.withColumn("_lane_run", F.struct(*run)).join(heads, ["_lane_run", "_at"], "left").drop("_lane_run")
    counted = lanes.scan(lanes.parted(headed, run, ["_at"]).df, ["_at"], sums={"_part": F.coalesce("_head", F.lit(0))})
    return counted.drop("_head", lanes.PART, lanes.LANE)


def window_spans(length: Column, width: int) -> Column:
    """array<struct(start, end)>: windows of `width` frames that share one frame with the next."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(length - 2, F.lit(0)), F.lit(width - 1)), lambda s: (s == 0) | (s < length - 1))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + width, length).alias("end")))


def packed_windows(costs: Column, budget: int, cap: int) -> Column:
    """array<struct(start, end)>: greedy windows of at most `cap` frames and `budget` cost, two at least, one shared."""
    item = "array<struct<start:int,end:int>>"
    size = F.size(costs)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("double").alias("sum"), F.lit(0).alias("k"), F.array().cast(item).alias("out"))

    def step(acc: Column, cost: Column) -> Column:
        n = acc["k"] - acc["at"]
        full = (n >= 2) & ((acc["sum"] + cost > budget) | (n >= cap))
        last = F.get(costs, acc["k"] - 1).cast("double")
        closed = F.array_append(acc["out"], F.struct(acc["at"].alias("start"), acc["k"].alias("end")))
        return F.struct(
            F.when(full, acc["k"] - 1).otherwise(acc["at"]).alias("at"),
            F.when(full, last + cost).otherwise(acc["sum"] + cost).alias("sum"),
            (acc["k"] + 1).alias("k"),
            F.when(full, closed).otherwise(acc["out"]).cast(item).alias("out"),
        )

    walked = F.aggregate(costs, start, step, lambda acc: F.array_append(acc["out"], F.struct(acc["at"].alias("start"), acc["k"].alias("end"))))
    return F.when(size > 0, walked).otherwise(F.array().cast(item))


def budget_windows(frames: DataFrame, lane: list[str], pos: str, cost: str, budget: float, cap: int) -> DataFrame:
    """(lane, start, end): windows as `packed_windows` makes them, of lanes of any length. pos counts from 0 in each lane.

    A window takes frames while they fit the budget and the cap, two at least; the next begins with its last frame.
    """
    rows = frames.select(*lane, F.col(pos).cast("long").alias("_at"), F.col(cost).cast("double").alias("_c"))
    rows = lanes.scan(lanes.parted(rows, lane, ["_at"]).df, ["_at"], sums={"_sum": F.col("_c")}, wholes={"_last_at": (F.max, F.col("_at"))}).drop(lanes.PART, lanes.LANE)
    rows = rows.withColumn("_n", F.col("_last_at") + 1).withColumn("_from", F.col("_sum") - F.col("_c")).drop("_last_at")
    rows = Written(rows, "costs").df
    near = rows.select(*lane, F.col("_at").alias("start"), "_n", "_from", F.explode(F.sequence("_at", F.least(F.col("_at") + cap - 1, F.col("_n") - 1))).alias("_at"))  # `cap` frames at most
    fits = near.join(rows.select(*lane, "_at", "_sum"), [*lane, "_at"]).where(F.col("_sum") - F.col("_from") <= budget)
    last = fits.groupBy(*lane, "start").agg(F.max("_at").alias("_last"))
    ends = rows.select(*lane, F.col("_at").alias("start"), "_n").join(last, [*lane, "start"], "left")
    end = F.least(F.greatest(F.coalesce(F.col("_last") + 1, F.lit(0)), F.col("start") + 2), F.col("_n"))
    ends = Written(ends.select(*lane, "start", end.alias("end"), F.when(end < F.col("_n"), end - 1).alias("_next")), "ends").df
    return ends.join(chain(ends, lane, "start", "_next"), [*lane, "start"]).select(*lane, "start", "end")


def stitched_relations(judged: DataFrame, session: str, pos: str, start: str, relation: str) -> DataFrame:
    """One relation for each frame: that of the latest window that saw it."""
    return judged.groupBy(session, pos).agg(F.max_by(relation, start).alias(relation))


#: Frame relations that begin a segment, and the one that is noise.
BOUNDARIES, NOISE = ("returns_to_entry", "context_switch"), "interruption"


def segments(frames: DataFrame, session: str, pos: str, relation: str, min_len: int = 2, noise_filter: bool = True) -> DataFrame:
    """`frames` with segment (from 0 in each session), seg_len and status: active, or dropped_noise with reason."""
    noise = (F.col(relation) == NOISE) if noise_filter else F.lit(False)
    live = lanes.parted(frames.withColumn("_noise", F.coalesce(noise, F.lit(False))), [session], [pos]).df
    bound = F.coalesce(~F.col("_noise") & F.col(relation).isin(*BOUNDARIES), F.lit(False)).cast("int")
    # the first frame that stays begins segment 0, whether or not it is a boundary
    first = F.when(~F.col("_noise"), F.struct(F.col(pos).alias("at"), bound.alias("bound")))
    live = lanes.scan(live, [pos], sums={"_cuts": bound}, wholes={"_first": (F.min, first), "_all": (F.sum, bound)})
    lead = F.col("_first.bound")
    live = live.withColumn("segment", F.when(~F.col("_noise"), F.col("_cuts") - lead)).withColumn("_parts", F.col("_all") - lead)
    live = lanes.totals(live, ["segment"], "_size").withColumn("seg_len", F.when(~F.col("_noise"), F.col("_size")))
    short = ~F.col("_noise") & (F.col("_parts") > 0) & (F.col("seg_len") < min_len)
    reason = F.when(F.col("_noise"), "noise").when(short, "below_min_len")
    return live.select(*frames.columns, "segment", "seg_len", reason.alias("reason")).withColumn("status", F.when(F.col("reason").isNull(), "active").otherwise("dropped_noise"))


def adjacent_pairs(members: DataFrame, episode: str, pos: str, record: str) -> DataFrame:
    """(episode, idx, prev, curr) of each two neighbours of an episode, idx from 0."""
    parts = lanes.parted(members.select(episode, pos, F.col(record).alias("prev")), [episode], [pos]).df
    pairs = lanes.scan(parts, [pos], sums={"_n": F.lit(1)}, after={"curr": F.col("prev")})
    return pairs.where(F.col("curr").isNotNull()).select(episode, (F.col("_n") - 1).alias("idx"), "prev", "curr")


def seams(members: DataFrame, session: str, thread: str, pos: str) -> DataFrame:
    """(session, thread, left_pos, right_pos, foreign): gaps between neighbours that hold frames of other threads.

    Frames of a session are compared by running counts, not pair by pair: in a gap, the frames with an owner
    other than the thread are all owned frames there, as a thread has none of its own between neighbours.
    """
    ranked = lanes.numbered(members.select(session, thread, pos), [session], [pos], "_n")
    own = lanes.parted(ranked, [session, thread], [pos]).df
    pairs = lanes.scan(own, [pos], after={"right_pos": F.col(pos), "_m": F.col("_n")})
    pairs = pairs.select(session, thread, F.col(pos).alias("left_pos"), "right_pos", (F.col("_m") - F.col("_n") - 1).alias("foreign"))
    return pairs.where(F.col("foreign") > 0)


def margins(episodes: DataFrame, frames: DataFrame, session: str, pos: str, k: int = 2) -> DataFrame:
    """Frames up to k positions before and behind each episode (episode_id, head, tail), by equi-join on positions."""
    near = episodes.select(session, "episode_id", F.explode(F.concat(F.sequence(F.col("head") - k, F.col("head") - 1), F.sequence(F.col("tail") + 1, F.col("tail") + k))).alias(pos))
    return near.join(frames, [session, pos])


def rescue_runs(dropped: DataFrame, session: str, pos: str) -> DataFrame:
    """(session, run_start, run_end, len): contiguous runs of dropped frames."""
    placed = lanes.numbered(dropped, [session], [pos], "_n")
    return placed.withColumn("_g", F.col(pos) - F.col("_n")).groupBy(session, "_g").agg(F.min(pos).alias("run_start"), F.max(pos).alias("run_end"), F.count("*").alias("len")).drop("_g")
