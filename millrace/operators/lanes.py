"""Scans along lanes of any length: rows are parted by range of lane and order, each part gives a small summary, and
each part starts from what the summaries before it add up to. No window spans more than one part of a lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import Written

#: Columns of a parted table besides those of its rows.
PART, LANE = "_p", "_lane"


def parted(frames: DataFrame, lane: list[str], order: list[str]) -> Written:
    """`frames` with LANE and PART, written once, so that rows and summaries are of one reading. Rows that compare equal share a part."""
    of = F.struct(*[F.col(c) for c in lane]) if lane else F.struct(F.lit(0).alias("_all"))
    return Written(frames.withColumn(LANE, of).repartitionByRange(F.col(LANE), *[F.col(c) for c in order]).withColumn(PART, F.spark_partition_id()), "lanes")


def scan(parts: DataFrame, order: list[str], sums: dict[str, Column] | None = None, peaks: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, wholes: dict[str, tuple] | None = None) -> DataFrame:
    """`parts` with, along each lane: `sums`, the running sum with the row's own; `peaks`, the largest value of the rows
    before; `before` and `after`, the value of the row before or behind; `wholes`, (function, value) over all of the lane.

    Absent rows and nulls give null, in sums nothing. Orders that tie come in any order, so they should end with an id.
    """
    sums, peaks, before, after, wholes = sums or {}, peaks or {}, before or {}, after or {}, wholes or {}
    inside = Window.partitionBy(PART, LANE).orderBy(*order)
    place = F.struct(*[F.col(c) for c in order])
    behind = F.struct(*[c.alias(n) for n, c in before.items()])
    ahead = F.struct(*[c.alias(n) for n, c in after.items()])
    rows = parts.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()],
        *[F.max(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_own_{n}") for n, c in peaks.items()],
        *([F.lag(behind).over(inside).alias("_own_before")] if before else []),
        *([F.lead(ahead).over(inside).alias("_own_after")] if after else []),
    )
    per = [F.sum(c).alias(f"_of_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_of_{n}") for n, c in peaks.items()] + [f(c).alias(f"_of_{n}") for n, (f, c) in wholes.items()]
    per += [F.max_by(behind, place).alias("_last")] if before else []
    per += [F.min_by(ahead, place).alias("_first")] if after else []
    summary = parts.groupBy(PART, LANE).agg(*per)
    lane = Window.partitionBy(LANE)  # a row for each part of a lane
    earlier = lane.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        PART, LANE,
        *[F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_by_{n}") for n in sums],
        *[F.max(f"_of_{n}").over(earlier).alias(f"_by_{n}") for n in peaks],
        *[f(f"_of_{n}").over(lane).alias(n) for n, (f, _) in wholes.items()],
        *([F.lag("_last").over(lane.orderBy(PART)).alias("_by_before")] if before else []),
        *([F.lead("_first").over(lane.orderBy(PART)).alias("_by_after")] if after else []),
    )
    out = rows.join(carried, [PART, LANE])
    kept = [F.col(c) for c in parts.columns]
    kept += [(F.col(n) + F.col(f"_by_{n}")).alias(n) for n in sums] + [F.greatest(f"_own_{n}", f"_by_{n}").alias(n) for n in peaks] + [F.col(n) for n in wholes]
    kept += [F.coalesce("_own_before", "_by_before")[n].alias(n) for n in before] + [F.coalesce("_own_after", "_by_after")[n].alias(n) for n in after]
    return out.select(*kept)


def runs(parts: DataFrame, order: list[str], starts: Column, run: str, place: str) -> DataFrame:
    """`parts` with `run`, from 0 in each lane, where rows for which `starts` holds begin a new one, and `place` from 0 in the run.

    A lane's first row begins run 0 whether or not `starts` holds, and doesn't count twice.
    """
    inside = Window.partitionBy(PART, LANE).orderBy(*order)
    flag = F.coalesce(starts, F.lit(False)).cast("int")
    rows = parts.withColumn("_flag", flag).withColumn("_n", F.row_number().over(inside))
    rows = rows.withColumn("_begun", F.sum("_flag").over(inside)).withColumn("_at", F.max(F.when(F.col("_flag") == 1, F.col("_n"))).over(inside))
    summary = rows.groupBy(PART, LANE).agg(F.count("*").alias("_many"), F.sum("_flag").alias("_flags"), F.max(F.when(F.col("_flag") == 1, F.col("_n"))).alias("_late"), F.min_by("_flag", "_n").alias("_head"))
    lane = Window.partitionBy(LANE).orderBy(PART)
    earlier = lane.rowsBetween(Window.unboundedPreceding, -1)
    counted = summary.select(PART, LANE, "_late", F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_flags").over(earlier), F.lit(0)).alias("_runs"), F.first("_head").over(lane.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_lead"))
    carried = counted.select(PART, LANE, "_rows", "_runs", "_lead", F.max(F.col("_rows") + F.col("_late")).over(earlier).alias("_since"))
    out = rows.join(carried, [PART, LANE])
    begin = F.coalesce(F.col("_rows") + F.col("_at"), F.col("_since"), F.lit(1))
    return out.select(*parts.columns, (F.col("_begun") + F.col("_runs") - F.col("_lead")).alias(run), (F.col("_rows") + F.col("_n") - begin).alias(place))


def totals(parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """`parts` with `out`: rows of the lane that have the same keys, null ones included."""
    keyed = parts.withColumn("_key", F.struct(*[F.col(k) for k in keys]))
    per = keyed.groupBy(PART, LANE, "_key").agg(F.count("*").alias("_n"))
    per = per.select(PART, LANE, "_key", F.sum("_n").over(Window.partitionBy(LANE, "_key")).alias(out))
    return keyed.join(per, [PART, LANE, "_key"]).select(*parts.columns, out)


def numbered(frames: DataFrame, lane: list[str], order: list[str], out: str) -> DataFrame:
    """`frames` with `out`: place from 1 in the lane."""
    return scan(parted(frames, lane, order).df, order, sums={out: F.lit(1)}).drop(PART, LANE)
