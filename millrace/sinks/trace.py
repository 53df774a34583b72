"""Traces: what happened to which record, as rows that can be filtered, thinned by tier and delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sinks import emit

#: Names of events; the part before the dot is the event's channel.
EVENTS = (
    "run.start", "run.end", "batch.start", "batch.end", "ingest.bad_line", "ingest.missing_pair", "ingest.index_conflict", "ingest.disorder",
    "segment.session", "segment.boundary", "stitch.judge", "stitch.thread", "dedup.duplicate", "classify.decision", "extract.step",
    "quality.judgment", "quality.pointwise", "quality.bt_fit", "quality.gate", "annotate.done", "verify.verdict", "schema.repair",
    "llm.call", "llm.key_cooldown", "llm.key_disabled", "llm.pool_parked", "error",
)
COLUMNS = "ev string, stage string, batch_no long, record_ids array<string>, payload map<string,string>"


def events(rows: DataFrame, name: str, ids: list[str], batch_no: Column | None = None, **payload: Column) -> DataFrame:
    """One event of `name` for each row, with the rows' ids and payload fields as texts."""
    if name not in EVENTS:
        raise ValueError(f"no event {name}")
    pairs = [x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]
    fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    number = batch_no if batch_no is not None else F.lit(None)
    return rows.select(F.lit(name).alias("ev"), F.lit(name.split(".")[0]).alias("stage"), number.cast("long").alias("batch_no"), F.array(*[F.col(c).cast("string") for c in ids]).cast("array<string>").alias("record_ids"), fields.alias("payload"))


def of_items(items: DataFrame) -> DataFrame:
    """Events of the rows that `plans.run.process` gives: copies, classes, gates, outputs, verdicts, errors."""
    seq = F.col("batch_no")
    parts = [
        events(items.where("kind <> 'unique'"), "dedup.duplicate", ["id", "kept_id"], seq, kind=F.col("kind"), cluster_id=F.col("cluster_key")),
        events(items.where("label is not null"), "classify.decision", ["id"], seq, label=F.col("label")),
        events(items.where("aggregate is not null"), "quality.gate", ["id"], seq, aggregate=F.col("aggregate"), status=F.when(F.col("status") == "dropped_lowq", "dropped_lowq").otherwise("active")),
        events(items.where("output is not null and status <> 'dropped_dup'"), "annotate.done", ["id"], seq, output=F.col("output")),
        events(items.where("status = 'dropped_verify'"), "verify.verdict", ["id"], seq, verdict=F.lit("fail")),
        events(items.where("status = 'failed'"), "error", ["id"], seq, kind=F.col("reason")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traced(events_: DataFrame, channels: list[str], tier: str = "refs", excerpt: int = 200) -> DataFrame:
    """The events of some channels, payloads thinned by tier; errors belong to every channel."""
    return events_.where(F.split("ev", "\\.")[0].isin(*channels, "error")).withColumn("payload", emit.redacted(F.col("payload"), tier, excerpt))


def deliver(events_: DataFrame, path: str, channels: list[str], tier: str = "refs") -> None:
    emit.deliver(traced(events_, channels, tier), path)


def summary(counts: dict[str, int]) -> list[str]:
    """A run's end in two lines, from the counts of its report."""
    first, second = ("scanned", "ingested", "bad_input", "generated"), ("dropped_dup", "dropped_lowq", "dropped_verify", "failed", "emitted")
    return ["  ".join(f"{k}={counts.get(k, 0)}" for k in keys) for keys in (first, second)]


def progress(batch_no: int, counts: dict[str, int]) -> str:
    """A run's state in one line."""
    return f"batch {batch_no}  " + "  ".join(f"{k}={counts.get(k, 0)}" for k in ("emitted", "dropped_dup", "dropped_lowq", "dropped_verify", "failed"))
