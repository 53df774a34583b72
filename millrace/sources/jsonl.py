"""JSON-lines text records: every line is kept, with its place and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.runtime import Written


class InputError(ValueError):
    """The input holds nothing to work on, or a bad row where the policy is to fail."""


def field(raw: Column, dotted: str) -> Column:
    """Text of a dotted path: strings as they are, other values as JSON; null where it is missing or null."""
    value = F.try_parse_json(raw)
    path = "$" + "".join(f".{p}" for p in dotted.split("."))
    plain = F.try_variant_get(value, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(nested, F.to_json(F.try_variant_get(value, path, "variant"))).otherwise(plain)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line, sound) of a file, or of a folder's *.jsonl files, not deeper.

    Files are split into blocks that are read at once; a line's number comes from its place in its block and the
    lines of the blocks before it. `sound` is false for a line that is no UTF-8; its bad bytes are replaced.
    """
    names = spark._jvm.org.apache.hadoop.fs.Path
    single = names(path).getFileSystem(spark._jsc.hadoopConfiguration()).isFile(names(path))
    reader = spark.read.option("lineSep", "\n")
    lines = (reader if single else reader.option("pathGlobFilter", "*.jsonl")).text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("_v"))
    stored = Written(raw, "lines").df  # numbers are counted and taken from the same reading
    blocks = stored.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    placed = stored.join(blocks.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before")), ["_file", "_block"])
    text = F.col("_v").cast("string")
    return placed.select(
        F.element_at(F.split(F.col("_file"), "/"), -1).alias("source_file"), (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"),
        F.make_valid_utf8(text).alias("line"), F.is_valid_utf8(text).alias("sound"),
    )


def classify_lines(lines: DataFrame, text_field: str = "text", line: str = "line") -> DataFrame:
    """`lines` with text and bad: null, not_utf8, not_json, not_object or no_text. Blank lines go."""
    rows = lines.where(~F.col(line).rlike("^\\s*$"))
    parsed = F.try_parse_json(line)
    kind = F.schema_of_variant(parsed)
    sound = F.col("sound") if "sound" in lines.columns else F.lit(True)
    bad = F.when(~sound, "not_utf8").when(parsed.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_object").when(F.col("text").isNull(), "no_text")
    return rows.withColumn("text", field(F.col(line), text_field)).withColumn("bad", bad).drop("sound")


def records(lines: DataFrame, on_bad: str = "skip", limit: int | None = None, order: tuple[str, ...] = ("source_file", "line_no")) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows). With `limit` the first so many valid rows in input order."""
    good, bad = lines.where("bad is null"), lines.where("bad is not null")
    if on_bad == "fail" and not bad.isEmpty():
        raise InputError(f"bad input line: {bad.first()}")
    return (first_valid(good, list(order), limit) if limit is not None else good), bad


def first_valid(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows by `order`; the plan keeps at most `limit` rows of each task."""
    return rows.orderBy(*order).limit(limit)


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """`rows` with seq (from 1, in order) and batch_no: slices of `size` rows.

    Ranks are added up over range partitions, so that no task sees all rows. The parted rows are written once, so
    that ranks and bounds are of one reading.
    """
    ranged = Written(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()), "ranged").df
    own = Window.partitionBy("_p").orderBy(*order)
    ranked = ranged.withColumn("_r", F.row_number().over(own))
    bounds = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = bounds.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    out = ranked.join(F.broadcast(before), "_p").withColumn("seq", F.col("_r") + F.col("_b"))
    return out.withColumn("batch_no", F.floor((F.col("seq") - 1) / size) + 1).drop("_p", "_r", "_b")


def require_some(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise InputError("no valid record in the input")
    return rows


def scan_counts(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, without reading anything into them: how many records an input has at most."""
    names = spark._jvm.org.apache.hadoop.fs.Path
    single = names(path).getFileSystem(spark._jsc.hadoopConfiguration()).isFile(names(path))
    reader = spark.read.option("lineSep", "\n")
    return (reader if single else reader.option("pathGlobFilter", "*.jsonl")).text(path).where(~F.col("value").rlike("^\\s*$")).count()


def seed_pool(spark: SparkSession, texts: list[str], count: int | None = None) -> DataFrame:
    """(seq, text) of a project's own seeds, in order; without seeds, `count` rows with null text, for calls that show none."""
    if texts:
        return spark.createDataFrame(list(enumerate(texts, 1)), "seq long, text string")
    return spark.range(1, (count or 0) + 1).select(F.col("id").alias("seq"), F.lit(None).cast("string").alias("text"))
