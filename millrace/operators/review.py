"""Review of results: rounds of verdicts and repairs, defects of episodes and where they lead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import Written


def review(items: DataFrame, judge: Callable[[DataFrame, int], DataFrame], repair: Callable[[DataFrame], DataFrame], key: str, policy: str = "drop", rounds: int = 1) -> DataFrame:
    """(key, output, verdict, rounds, critiques) of every item.

    judge: takes (key, output) and the round, gives (key, verdict, critique). A failed output is repaired and
    judged again, up to `rounds` times under the policy `repair`. A missing verdict is a fail.
    """
    open_, done = Written(items.select(key, "output").withColumn("critiques", F.array().cast("array<string>")), "review"), None
    last = rounds if policy == "repair" else 0
    for k in range(last + 1):
        told = judge(open_.df.select(key, "output"), k).select(key, "verdict", "critique")
        seen = Written(open_.df.join(told, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("fail"))), "verdicts").df
        noted = F.when((F.col("verdict") == "fail") & F.col("critique").isNotNull(), F.array_append("critiques", F.col("critique"))).otherwise(F.col("critiques"))
        seen = seen.withColumn("critiques", noted)
        settled = seen if k == last else seen.where("verdict = 'pass'")
        out = settled.select(key, "output", "verdict", F.lit(k).alias("rounds"), "critiques")
        done = out if done is None else done.union(out)
        if k < last:
            failed = seen.where("verdict = 'fail'").select(key, "output", "critiques")
            fixed = repair(failed).select(key, F.col("output").alias("_new"))
            open_ = Written(failed.join(fixed, key, "left").select(key, F.coalesce("_new", "output").alias("output"), "critiques"), "review")
    return done


def defect_route(kind: Column, hard_split: Column, clone: Column) -> Column:
    """What follows from a defect: reannotate, shrink, reclaim, or mark only."""
    act = F.when(kind == "label_mismatch", "reannotate").when(kind == "off_task_members", "shrink").when(kind.startswith("missing_"), "reclaim").otherwise("mark")
    return F.when((hard_split | clone) & (kind != "label_mismatch"), "mark").otherwise(act)


def shrunk(members: Column, off: Column) -> Column:
    """Members without the off-task ones; an episode never becomes empty."""
    left = F.array_except(members, off)
    return F.when(F.size(left) == 0, members).otherwise(left)


def reclaimed(pool_relation: Column) -> Column:
    """What becomes of a noise frame that an episode misses: its verdict, judged anew, decides."""
    return F.when(pool_relation.isin("continues", "advances"), "reclaim").when(pool_relation.isNull(), "capture_gap").otherwise("neighbor")
