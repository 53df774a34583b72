"""Ranks inside pools of any size: rows are parted by range, ranked in their part, and the parts' counts added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import Written


def _parted(rows: DataFrame, pool: list[str], order: list[Column], tag: str) -> DataFrame:
    """Written once, so that ranks and counts are of one reading."""
    return Written(rows.repartitionByRange(*[F.col(c) for c in pool], *order).withColumn("_p", F.spark_partition_id()), tag).df


def ranks(rows: DataFrame, pool: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """`rows` with `out`: place from 1 in the pool. Rows that compare equal come in any order, so `order` should end with an id."""
    parted = _parted(rows, pool, order, "ranked")
    own = parted.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *pool).orderBy(*order)))
    counts = parted.groupBy("_p", *pool).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*pool).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part of a pool
    counts = counts.select("_p", *[F.col(c).alias(f"_in_{c}") for c in pool], F.coalesce(before, F.lit(0)).alias("_b"))
    joined = own.join(counts.withColumnRenamed("_p", "_q"), (F.col("_p") == F.col("_q")) & _all([F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in pool]))
    return joined.withColumn(out, F.col("_r") + F.col("_b")).select(*rows.columns, out)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def percentiles(rows: DataFrame, pool: list[str], value: str, out: str = "pct") -> DataFrame:
    """`rows` with `out`: (average rank - 1) / (n - 1) in the pool, 0.5 in a pool of one; equal values share their ranks' mean.

    Values are counted first, so that what is ranked are distinct values; null values come first, as one value.
    """
    counts = rows.groupBy(*pool, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parted = _parted(counts, pool, [F.col("_v").asc_nulls_first()], "values")
    inside = Window.partitionBy("_p", *pool).orderBy(F.col("_v").asc_nulls_first())
    own = parted.withColumn("_r", F.sum("_n").over(inside) - F.col("_n"))
    sums = parted.groupBy("_p", *pool).agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*pool).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_s").over(Window.partitionBy(*pool))
    sums = sums.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_in_{c}") for c in pool], F.coalesce(before, F.lit(0)).alias("_b"), total.alias("_t"))
    placed = own.join(sums, (F.col("_p") == F.col("_q")) & _all([F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in pool]))
    score = F.when(F.col("_t") == 1, F.lit(0.5)).otherwise((F.col("_r") + F.col("_b") + (F.col("_n") - 1) / 2) / (F.col("_t") - 1))
    table = placed.select(*[F.col(c).alias(f"_of_{c}") for c in pool], F.col("_v").alias("_of"), score.alias(out))
    same = _all([F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in pool]) & F.col(value).eqNullSafe(F.col("_of"))
    return rows.join(table, same).select(*rows.columns, out)
