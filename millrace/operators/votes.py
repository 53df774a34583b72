"""Votes of several samples or judges: labels, fields, threads, verdicts, defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of defects, in their order.
DEFECTS = ("label_mismatch", "off_task_members", "missing_head", "missing_tail", "missing_members", "wrong_stitch")


def normalized_labels(labels: Column, classes: list[str], fallback: str, most: int | None = None) -> Column:
    """Known labels in the classes' order, each once; the fallback goes where another label stands."""
    known = F.array_intersect(F.array(*[F.lit(c) for c in classes]), labels)
    concrete = F.filter(known, lambda x: x != fallback)
    out = F.when(F.size(concrete) > 0, concrete).otherwise(known)
    return F.slice(out, 1, most) if most else out


def label_votes(samples: DataFrame, key: list[str], labels: str, n: int, classes: list[str], fallback: str) -> DataFrame:
    """(key, labels, agreement): labels in more than half of n samples, else the fallback. Null samples abstain."""
    rows = samples.select(*key, F.explode_outer(labels).alias("_l"))
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_l"))
    counted = rows.groupBy(*key, "_l").agg(F.count("*").alias("_n")).withColumn("_o", order)
    win = F.col("_l").isNotNull() & (F.col("_n") * 2 > n)
    out = counted.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(win, F.struct("_o", "_l", "_n")))).alias("_w"),
        F.coalesce(F.max(F.when(F.col("_l") == fallback, F.col("_n"))), F.lit(0)).alias("_f"),
    )  # as many as there are classes at most
    voted = F.size("_w") > 0
    names = F.when(voted, F.transform("_w", lambda x: x["_l"])).otherwise(F.array(F.lit(fallback)))
    share = F.when(voted, F.array_min(F.transform("_w", lambda x: x["_n"]))).otherwise(F.col("_f")) / n
    return out.select(*key, names.alias("labels"), share.alias("agreement"))


def fan_out(items: DataFrame, labels: str) -> DataFrame:
    """One row for each label, with its place; the first is the row itself, the others its copies."""
    return items.select("*", F.posexplode(labels).alias("fan_pos", "label"))


def field_vote(samples: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """(key, chosen order, matches, disagreed) of the samples of each key.

    Each field's strict mode makes the modal combination; the first sample with it is chosen. Without a strict
    mode in every field, or a sample with all of them, the first sample is chosen and disagreed is true. A
    missing field is a value of its own.
    """
    rows = samples
    for k, f in enumerate(fields):
        each = rows.groupBy(*key, F.col(f).alias("_v")).agg(F.count("*").alias("_c"))
        own = Window.partitionBy(*key)
        top = each.withColumn("_top", F.max("_c").over(own)).where("_c = _top")
        mode = top.groupBy(*key).agg(F.count("*").alias(f"_t{k}"), F.struct(F.first("_v").alias("v")).alias(f"_m{k}"))
        rows = rows.join(mode, key)
    modal = F.lit(True)
    for k, f in enumerate(fields):
        modal = modal & (F.col(f"_t{k}") == 1) & F.col(f).eqNullSafe(F.col(f"_m{k}.v"))
    rows = rows.withColumn("_hit", modal)
    pick = rows.groupBy(*key).agg(F.min(F.when(F.col("_hit"), F.col(order))).alias("_first_hit"), F.min(order).alias("_first"))
    pick = pick.withColumn("chosen", F.coalesce("_first_hit", "_first")).withColumn("disagreed", F.col("_first_hit").isNull())
    combo = F.struct(*fields)
    best = samples.join(pick, key).where(F.col(order) == F.col("chosen")).select(*key, combo.alias("_combo"), "chosen", "disagreed")
    same = samples.join(best, key).where(combo.eqNullSafe(F.col("_combo")))
    return same.groupBy(*key, "chosen", "disagreed").agg(F.count("*").alias("matches"))


def strict_majority(samples: DataFrame, key: list[str], parts: list[str]) -> DataFrame:
    """(key, parts) of the combination in more than half of the samples; keys without one are left out."""
    counted = samples.groupBy(*key, *parts).agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(*key))
    return counted.withColumn("_n", total).where("_c * 2 > _n").select(*key, *parts)


def verdict_majority(verdicts: DataFrame, key: list[str], verdict: str) -> DataFrame:
    """fail where more than half of the verdicts are, else pass; a tie passes."""
    fails = F.count_if(F.col(verdict) == "fail")
    return verdicts.groupBy(*key).agg(F.when(fails * 2 > F.count("*"), "fail").otherwise("pass").alias("verdict"))


def defect_union(defects: DataFrame, key: list[str], judge: str, kind: str, position: str, members: str) -> DataFrame:
    """Defects of all failing judges, each (kind, position, members) once, from the first judge; in the kinds' order."""
    own = Window.partitionBy(*key, kind, position, members).orderBy(judge)
    first = defects.withColumn("_k", F.row_number().over(own)).where("_k = 1")
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col(kind))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(rank, position, members))
    return first.withColumn("ord", place).select(*key, "ord", kind, position, members, judge)


def zero_based(rows: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """Count of each declared value, those that don't occur with 0."""
    spark = rows.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in declared])).alias(column))
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def first_verdicts(items: DataFrame, verdicts: DataFrame, key: list[str], order: str, verdict: str, default: str) -> DataFrame:
    """`items` with the first verdict of each key by `order`; `default` where there is none."""
    first = verdicts.groupBy(*key).agg(F.min_by(verdict, order).alias("_v"))
    return items.join(first, key, "left").withColumn(verdict, F.coalesce("_v", F.lit(default))).drop("_v")


def class_gate(items: DataFrame, views: DataFrame, label: str, aggregate: str, threshold: float, on_unscored: str = "keep") -> DataFrame:
    """`items` with status by their class's own threshold and rule, else the general ones. views: (label, threshold, on_unscored), a row a class."""
    own = views.select(label, F.col("threshold").alias("_t"), F.col("on_unscored").alias("_u"))
    rows = items.join(F.broadcast(own), label, "left")  # the project's classes
    unscored = F.when(F.coalesce("_u", F.lit(on_unscored)) == "keep", "active").otherwise("dropped_lowq")
    gate = F.when(F.col(aggregate).isNull(), unscored).when(F.col(aggregate) >= F.coalesce("_t", F.lit(threshold)), "active").otherwise("dropped_lowq")
    return rows.withColumn("status", gate).drop("_t", "_u")
