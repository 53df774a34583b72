"""Connected components of links between rows, by hooking labels and jumping them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import Written


def components(links: DataFrame, a: str, b: str) -> Written:
    """(node, component): the least node that each node of `links` reaches.

    Each round a node takes the least label among its own and its neighbours', combined before the shuffle, and then
    its label's label, so that paths halve; rounds end when no label moves. Null ends link nothing.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("_other")).where("node is not null and _other is not null and node <> _other")
    both = Written(both.union(both.select(F.col("_other").alias("node"), F.col("node").alias("_other"))).distinct(), "ends")
    now = Written(both.df.groupBy("node").agg(F.least("node", F.min("_other")).alias("component")), "labels")
    while True:
        near = both.df.join(now.df.select(F.col("node").alias("_other"), F.col("component").alias("_c")), "_other").groupBy("node").agg(F.min("_c").alias("_c"))
        hooked = Written(now.df.join(near, "node").select("node", F.least("component", "_c").alias("component"), (F.col("_c") < F.col("component")).alias("_moved")), "labels")
        up = hooked.df.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        jumped = Written(hooked.df.join(up, "component").select("node", F.least("component", "_up").alias("component"), (F.col("_moved") | (F.col("_up") < F.col("component"))).alias("_moved")), "labels")
        hooked.drop()
        now.drop()
        now = jumped
        if now.df.where("_moved").isEmpty():
            both.drop()
            return now
