"""Connected components of a link table, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hot_join, hot_keys
from millrace.runtime import Written


def _toward_least(links: DataFrame, rows: int, upward: bool) -> tuple[DataFrame, Written]:
    """One star step. Each node's neighbours (larger ones, or else smaller ones and itself) go to its least one.

    The least neighbour comes from a grouped minimum (combined before the shuffle) and a join that deals the
    links of a node with very many of them to several tasks; no node's links are gathered. Also returns the
    table that the step reads besides `links`.
    """
    if upward:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = Written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("_m"), F.count("*").alias("_n")), "least")
    moved = hot_join(both, least.df.select("a", "_m"), "a", hot_keys(least.df, "a", "_n", rows * 2))
    if upward:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.df.select("a", F.col("_m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct(), least


def components(links: DataFrame, spent: tuple[Written, ...] = ()) -> DataFrame:
    """(node, component) of every node in `links` (a, b: long): the least node it reaches.

    Alternates large-star and small-star steps, each written to the shared folder, until the links no
    longer change; then every link points at its component's least node. Links with a null end and links
    of a node to itself count as none; repeated links count once; no links give no rows. `spent` are tables
    that only `links` reads: they are deleted once it is written. The last table of links stays, as the result
    reads it.
    """
    start = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = Written(start, "links"), None
    for table in spent:
        table.drop()
    while True:
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        for upward in (True, False):
            out, least = _toward_least(now.df, mark[0], upward)
            step = Written(out, "links")
            now.drop()
            least.drop()
            now = step
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
