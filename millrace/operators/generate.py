"""Growth from good seeds: seeds, call plans, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranks import ranks


def seeds(scored: DataFrame, pool: str, score: str, status: str, explicit: float | None = None, class_thresholds: DataFrame | None = None) -> DataFrame:
    """Active scored rows at or above their pool's threshold, with `seed_threshold`.

    The threshold is the explicit one, else the class's own (pool, threshold), else the pool's exact median.
    """
    rows = scored.where((F.col(status) == "active") & F.col(score).isNotNull())
    if explicit is not None:
        return rows.withColumn("seed_threshold", F.lit(explicit)).where(F.col(score) >= explicit)
    middle = rows.groupBy(pool).agg(F.median(score).alias("_median"))
    own = rows.join(middle, pool)
    if class_thresholds is not None:
        own = own.join(class_thresholds.select(pool, F.col("threshold").alias("_t")), pool, "left")
    else:
        own = own.withColumn("_t", F.lit(None).cast("double"))
    own = own.withColumn("seed_threshold", F.coalesce("_t", "_median")).drop("_t", "_median")
    return own.where(F.col(score) >= F.col("seed_threshold"))


def call_plan(seed_rows: DataFrame, pool: str, item: str, models: list[str], styles: list[str], per_record: int = 2, per_call: int = 4, seeds_per_call: int = 3, seed: int = 0) -> DataFrame:
    """(call_index, pool, model, style, seed_ids): ceil(seeds * per_record / per_call) calls for each pool.

    Calls are numbered through the pools in their order; models go round robin by number, styles and seeds are
    drawn by keyed digests, seeds without repeats inside a call.
    """
    sizes = seed_rows.groupBy(pool).agg(F.count("*").alias("_seeds")).withColumn("_calls", F.ceil(F.col("_seeds") * per_record / per_call))
    before = F.sum("_calls").over(Window.orderBy(pool).rowsBetween(Window.unboundedPreceding, -1))  # one row a class
    calls = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).select(pool, "_seeds", "_before", F.explode(F.sequence(F.lit(0), F.col("_calls") - 1)).alias("_c"))
    calls = calls.withColumn("call_index", (F.col("_before") + F.col("_c")).cast("long"))
    model = F.get(F.array(*[F.lit(m) for m in models]), (F.col("call_index") % len(models)).cast("int"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("style"), "call_index"), 256), 1, 8), 16, 10).cast("long") % max(1, len(styles))
    style = F.get(F.array(*[F.lit(s) for s in styles]), drawn.cast("int")) if styles else F.lit(None).cast("string")
    # a call takes a run of the pool's seeds in shuffled order, going round
    keyed = seed_rows.select(pool, F.col(item).alias("_item"), F.sha2(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")), 256).alias("_k"))
    ranked = ranks(keyed, [pool], [F.col("_k"), F.col("_item")], "_r").select(pool, "_item", (F.col("_r") - 1).alias("_r"))
    slots = calls.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(seeds_per_call), F.col("_seeds")) - 1)))
    slots = slots.withColumn("_r", (F.col("_c") * seeds_per_call + F.col("_slot")) % F.col("_seeds"))
    got = slots.join(ranked, [pool, "_r"]).groupBy("call_index", pool).agg(F.transform(F.array_sort(F.collect_list(F.struct("_slot", "_item"))), lambda x: x["_item"]).alias("seed_ids"))
    return got.select("call_index", pool, model.alias("model"), style.alias("style"), "seed_ids")


def bucket_stats(samples: DataFrame, keys: list[str], survived: str) -> DataFrame:
    """Samples produced, surviving and rejected in each bucket."""
    return samples.groupBy(*keys).agg(F.count("*").alias("produced"), F.count_if(F.col(survived)).alias("survived"), F.count_if(~F.col(survived)).alias("rejected"))
