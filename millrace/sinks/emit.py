"""Routing by status, main and reject rows, accounts, atomic delivery."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed vocabulary of status, and where each goes.
STATUSES = ("active", "dropped_dup", "dropped_lowq", "dropped_verify", "failed", "absorbed", "dropped_noise", "stitched")
CHANNELS = {"active": "main", "absorbed": "counted", "stitched": "counted"}
TIERS = ("none", "refs", "excerpt", "full")


def channel(status: Column) -> Column:
    return F.when(status == "active", "main").when(status.isin("absorbed", "stitched"), "counted").otherwise("rejects")


def reject_reason(status: Column, kind: Column, selection: str | Column, noise_stage: Column, noise_reason: Column, error_stage: Column, error_kind: Column) -> Column:
    """struct(stage, reason) of a rejected row; null for rows that aren't rejected. selection: how rows were gated, or a row's own gate."""
    chosen = F.lit(selection) if isinstance(selection, str) else selection
    gate = F.when(chosen == "top_ratio", "top_ratio").otherwise("below_threshold")
    pair = lambda a, b: F.struct(F.lit(a).alias("stage") if isinstance(a, str) else a.alias("stage"), F.lit(b).alias("reason") if isinstance(b, str) else b.alias("reason"))
    return (
        F.when(status == "dropped_dup", pair("dedup", kind))
        .when(status == "dropped_lowq", pair("quality", gate))
        .when(status == "dropped_verify", pair("verify", "verify_fail"))
        .when(status == "dropped_noise", pair(noise_stage, noise_reason))
        .when(status == "failed", pair(error_stage, error_kind))
    )


def accounts(items: DataFrame, status: str, bad_input: int, scanned: int, generated: int = 0, fanout: int = 0, episodes: int = 0) -> DataFrame:
    """One row: how many rows have each status, and whether every row that came in is accounted for."""
    counts = items.agg(*[F.count_if(F.col(status) == s).alias(s) for s in STATUSES], F.count_if(~F.col(status).isin(*STATUSES) | F.col(status).isNull()).alias("unknown"))
    out = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    return counts.withColumn("bad_input", F.lit(bad_input)).withColumn("balanced", (out + bad_input == scanned + generated + fanout + episodes) & (F.col("unknown") == 0))


def main_row(output: Column, meta: Column, mode: str = "inline", spelt: bool = False) -> Column:
    """JSON of a delivered row: the user's object, with `_meta` inside when inline; null fields are written.

    spelt: `meta` is JSON already, not a struct.

    Blanks around the object go. A `_meta` of the user's own gives way; such a row's keys come in their order.
    """
    if mode != "inline":
        return output
    given = F.try_parse_json(output)
    own = F.try_variant_get(given, "$", "map<string,variant>")
    clean = F.when(F.try_variant_get(given, "$._meta", "variant").isNull(), output).otherwise(F.to_json(F.map_filter(own, lambda k, _: k != "_meta")))
    body = F.regexp_replace(F.regexp_replace(clean, "^\\s*\\{\\s*", ""), "\\s*\\}\\s*$", "")
    return F.concat(F.lit("{"), F.when(body != "", F.concat(body, F.lit(","))).otherwise(""), F.lit('"_meta":'), meta if spelt else F.to_json(meta, {"ignoreNullFields": "false"}), F.lit("}"))


def redacted(payload: Column, tier: str, excerpt: int = 200) -> Column:
    """A map payload by tier: none keeps nothing, refs ids only, excerpt the head of texts, full all."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    refs = F.map_filter(payload, lambda k, _: k.rlike("(^|_)(id|ids|seq|stage|kind|count)$"))
    return {
        "none": F.map_filter(payload, lambda k, _: F.lit(False)),
        "refs": refs,
        "excerpt": F.transform_values(payload, lambda _, v: F.substring(v, 1, F.lit(excerpt))),
        "full": payload,
    }[tier]


def deliver(df: DataFrame, path: str, text: bool = False) -> None:
    """Write JSON lines (or, with `text`, the only column as it is) beside `path` and rename, so that a reader sees all of it or nothing.

    What was there before is set aside under another name until the new output is in its place; after a crash
    between the two renames it is still there whole.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    part, aside = (f"{path.rstrip('/')}.{kind}-{mark}" for kind in ("part", "old"))
    out = df.write.mode("errorifexists")
    out.text(part) if text else out.json(part)
    names = spark._jvm.org.apache.hadoop.fs.Path
    store = names(path).getFileSystem(spark._jsc.hadoopConfiguration())
    before = store.exists(names(path))
    if before and not store.rename(names(path), names(aside)):
        raise OSError(f"{path} can't be set aside")
    if not store.rename(names(part), names(path)):
        if before:
            store.rename(names(aside), names(path))
        raise OSError(f"{part} can't be renamed to {path}")
    if before:
        store.delete(names(aside), True)
