"""Greedy cuts of ordered rows without a walk: where each row would end its piece, then the pieces by doubling pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import Written


def chain(nexts: DataFrame, part: list[str], pos: str, following: str) -> DataFrame:
    """(part, pos) of the rows that are reached from each part's first one, going from a row to its `following` one.

    nexts: (part, pos, following); a null or absent one ends the chain. Each round doubles the pointers, so that a chain
    of n rows takes about log2(n) rounds, each two joins; no part's rows are gathered. Both sides are shuffled: tables
    of counts pack so well that they look small enough to be sent whole through the driver in every round.
    """
    there = nexts.select(*part, F.col(pos).alias(following), F.lit(True).alias("_there"))
    jump = Written(nexts.join(there.hint("merge"), [*part, following], "left").select(*part, pos, F.when(F.col("_there"), F.col(following)).alias(following)), "jumps")
    here = Written(nexts.groupBy(*part).agg(F.min(pos).alias(pos)), "places")
    many = here.df.count()
    while True:
        ahead = here.df.join(jump.df.where(F.col(following).isNotNull()).hint("merge"), [*part, pos]).select(*part, F.col(following).alias(pos))
        grown = Written(here.df.union(ahead).distinct(), "places")
        here.drop()
        here, before, many = grown, many, grown.df.count()
        if many == before:
            jump.drop()
            return here.df
        far = jump.df.select(*part, F.col(pos).alias(following), F.col(following).alias("_far"))
        twice = Written(jump.df.join(far.hint("merge"), [*part, following], "left").select(*part, pos, F.col("_far").alias(following)), "jumps")
        jump.drop()
        jump = twice


def prefix_sums(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """`rows` with the running sum of `value` in order, added up over range partitions, so that no task sees all rows."""
    parted = Written(rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()), "parted").df
    own = parted.withColumn("_own", F.sum(value).over(Window.partitionBy("_p").orderBy(order)))
    sums = parted.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    return own.join(F.broadcast(before), "_p").withColumn(out, F.col("_own") + F.col("_b")).drop("_p", "_own", "_b")


def next_fit(pieces: DataFrame, order: str, size_col: str, size: int) -> DataFrame:
    """`pieces` with `first`: the order of the piece that its batch begins with.

    Whole pieces go into a batch in order while they fit `size`; a longer piece is a batch of its own, to be cut into
    slices. Sizes are 1 or more; orders are unique. Candidates share a stretch of `size` of the running sum.
    """
    rows = prefix_sums(pieces.select(F.col(order).alias("_o"), F.col(size_col).cast("long").alias("_n")), "_o", "_n", "_sum")
    rows = Written(rows.withColumn("_b", F.floor(F.col("_sum") / size)), "sums").df
    limit = F.col("_sum") - F.col("_n") + size
    starts = rows.select(F.col("_o").alias("_start"), (limit).alias("_limit"), F.explode(F.sequence(F.floor((F.col("_sum") - F.col("_n")) / size), F.floor(limit / size))).alias("_b"))
    last = starts.join(rows.hint("merge"), "_b").where((F.col("_o") >= F.col("_start")) & (F.col("_sum") <= F.col("_limit"))).groupBy("_start").agg(F.max("_o").alias("_last"))
    rank = Written(prefix_sums(rows.select("_o", F.lit(1).alias("_one")), "_o", "_one", "_rank").select("_o", "_rank"), "ranks").df
    ends = rows.select(F.col("_o").alias("_start")).join(last.hint("merge"), "_start", "left").select("_start", F.coalesce("_last", "_start").alias("_last"))
    ends = ends.join(rank.select(F.col("_o").alias("_last"), F.col("_rank").alias("_end")).hint("merge"), "_last").join(rank.select(F.col("_o").alias("_start"), F.col("_rank").alias("_r")).hint("merge"), "_start")
    heads = chain(ends.select(F.lit(0).alias("_in"), F.col("_r").cast("long").alias("_r"), (F.col("_end") + 1).cast("long").alias("_next")), ["_in"], "_r", "_next")
    spans = Written(ends.join(heads.select("_r").hint("merge"), "_r", "left_semi").select(F.col("_start").alias("first"), "_r", "_end"), "spans").df
    own = rank.join(spans.select("first", F.explode(F.sequence("_r", "_end")).alias("_rank")).hint("merge"), "_rank")  # a batch holds `size` pieces at most
    return pieces.join(own.select(F.col("_o").alias(order), "first").hint("merge"), order)
