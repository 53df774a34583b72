"""A run over a stream of text frames: order, sessions, judged windows, segments; episodes then go on as records.

Frames don't go: they are absorbed by their episode, dropped as noise or as out of order, or bad lines. An episode is a
record whose text is its frames' texts with U+001E between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.functions import text as text_fn
from millrace.judges import Judge
from millrace.operators import chains, lanes, sessions
from millrace.operators.ranks import ranks
from millrace.plans import calls
from millrace.plans.config import Config
from millrace.plans.run import ingest
from millrace.runtime import Written

BETWEEN = "\u001e"


def ordered(frames: DataFrame, config: Config) -> DataFrame:
    """`frames` with lane, order_key and late. Lanes are the values of the stream's keys, and the file where order is by input.

    order_by is `input_order` or `meta:<field>`; a frame without a readable key there is late too, as it has no place.
    """
    s = config["stream"]
    by = s["order_by"].partition(":")[2]
    key = text_fn.order_key(F.regexp_replace(text_fn.lookup(F.col("raw"), by)["value"], '^"|"$', "")) if by else F.col("line_no").cast("double")
    parts = [F.coalesce(text_fn.lookup(F.col("raw"), k)["value"], F.lit("null")) for k in s["key"]] + ([] if by else [F.col("source_file")])
    rows = frames.withColumn("lane", F.concat_ws("\n", *parts) if parts else F.lit("")).withColumn("order_key", key)
    marked = sessions.in_order(rows, ["lane"], "seq", "order_key")
    return marked.withColumn("late", F.col("late") | F.col("order_key").isNull())


def in_sessions(rows: DataFrame, config: Config) -> DataFrame:
    """Rows that aren't late, with session_id (id and repeat), session, pos from 0, split, frames and slice.

    A session of more frames than a batch holds is cut hard into slices of that many (`split`): each is judged and
    batched as a session of its own, with its own name in `session`. Others are one slice.
    """
    s = config["stream"]
    by_time = s["order_by"] != "input_order"
    own = rows.where("not late")
    cut = sessions.sessions(
        own, ["lane"], "seq", "order_key", "id", gap_s=s["gap_s"] if by_time else float("inf"), max_len=s["session_max_len"], step="line_no", gap_steps=s["gap_steps"], file="source_file",
        max_span_s=s["session_max_span_s"] if by_time else 0,
    )
    name = F.when(F.col("repeat") == 0, F.col("session_id")).otherwise(F.concat_ws("-", "session_id", F.col("repeat").cast("string")))
    starts = cut.select("lane", F.col("first_seq").alias("seq"), F.struct("first_seq", name.alias("session_id"), F.col("len").alias("frames")).alias("_s"))
    begun = lanes.parted(own.join(starts, ["lane", "seq"], "left"), ["lane"], ["seq"]).df
    placed = lanes.scan(begun, ["seq"], peaks={"_since": F.col("_s")}).withColumn("_s", F.coalesce("_s", "_since")).select(*own.columns, "_s.session_id", "_s.frames")
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1  # a session's length is capped
    size = config["run"]["batch_size"]
    cut = placed.withColumn("split", F.col("frames") > size).withColumn("_at", at).withColumn("slice", F.when(F.col("split"), F.floor(F.col("_at") / size)).otherwise(0))
    named = F.when(F.col("split"), F.concat_ws("/", "session_id", F.col("slice").cast("string"))).otherwise(F.col("session_id"))
    return cut.withColumn("session", named).withColumn("pos", F.when(F.col("split"), F.col("_at") % size).otherwise(F.col("_at")).cast("int")).drop("_at")


def segmented(frames: DataFrame, config: Config, make: Callable[[], Judge] | None) -> DataFrame:
    """`frames` with segment, status, reason and degraded. Without a judge, or by rules alone, a session is one segment."""
    c = config["segment"]
    if make is None or c["strategy"] == "rules":
        return frames.withColumn("segment", F.lit(0).cast("long")).withColumn("status", F.lit("active")).withColumn("reason", F.lit(None).cast("string")).withColumn("degraded", F.lit(False))
    digest = F.substring(F.regexp_replace("text", "\\s+", " "), 1, c["digest_max_chars"])
    plan = calls.window_calls(frames.withColumn("_d", digest), "session", "pos", "_d", c["window"])
    sizes = [r["n"] for r in plan.select((F.col("end") - F.col("start")).alias("n")).distinct().collect()]  # `window` sizes at most
    told = [calls.answered(plan.where(F.col("end") - F.col("start") == n), make, ["session", "start", "end"], shapes.window(n), config["output"]["max_repair_attempts"]).select("session", "start", "end", F.col("output").alias("answer")) for n in sizes]
    answers = told[0]
    for t in told[1:]:
        answers = answers.unionByName(t)
    relations = Written(calls.window_relations(answers, "session"), "relations").df
    own = sessions.stitched_relations(relations, "session", "pos", "start", "relation").join(relations.groupBy("session").agg(F.bool_or("degraded").alias("degraded")), "session")
    rows = frames.join(own, ["session", "pos"])
    return sessions.segments(rows, "session", "pos", "relation", c["min_len"], c["noise_filter"])


def episodes(frames: DataFrame, batch_size: int) -> DataFrame:
    """Records of the active frames' segments: seq, id, text, raw (the members), source_file, line_no, batch_no, session, members.

    Batches take whole sessions in order while all their frames fit, noise included; each slice of a split session is
    a batch of its own.
    """
    member = F.struct("pos", "id", "text", "source_file", "line_no", "seq")
    rows = frames.where("status = 'active'").groupBy("session", "session_id", "slice", "segment").agg(F.array_sort(F.collect_list(member)).alias("_m"), F.bool_or("degraded").alias("degraded"), F.bool_or("split").alias("split"))  # a session's length is capped
    ids = F.transform("_m", lambda m: m["id"])
    first = F.get("_m", 0)
    rows = rows.select(
        "session", "session_id", "slice", "degraded", "split", first["seq"].alias("_first"), ids.alias("members"), F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, 16).alias("id"), F.array_join(F.transform("_m", lambda m: m["text"]), BETWEEN).alias("text"),
        F.to_json(F.struct(F.lit("sequence").alias("kind"), ids.alias("member_ids"))).alias("raw"), first["source_file"].alias("source_file"), first["line_no"].alias("line_no"), F.size("_m").alias("len"),
    )
    rows = Written(ranks(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col("_first"), F.col("id")], "seq").drop("_all"), "episodes").df
    per = frames.groupBy("session_id").agg(F.min("seq").alias("_at"), F.count("*").alias("_n"))
    packed = Written(chains.next_fit(per, "_at", "_n", batch_size), "packed").df
    slices = frames.select("session_id", "slice").distinct().join(packed.select("session_id", "first"), "session_id")
    heads = ranks(slices.select("first", "slice").distinct().withColumn("_all", F.lit(0)), ["_all"], [F.col("first"), F.col("slice")], "batch_no").select("first", "slice", "batch_no")
    return rows.join(slices.join(heads, ["first", "slice"]).select("session_id", "slice", "batch_no"), ["session_id", "slice"]).drop("_first", "slice")


def read(spark: SparkSession, config: Config, make: Callable[[], Judge] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes as records, frames with status and reason, bad lines) of a stream of text frames.

    The frames are those of the input with status absorbed or dropped_noise; reasons are disorder, noise, below_min_len.
    """
    lines, bad = ingest(spark, config, limit)
    rows = Written(ordered(lines, config), "ordered").df
    if config["stream"]["on_disorder"] == "fail" and (late := rows.where("late").orderBy("seq").first()):
        from millrace.sources.jsonl import InputError

        raise InputError(f"out of order: {late['source_file']} line {late['line_no']}")
    judged = Written(segmented(in_sessions(rows, config), config, make), "segmented").df
    records = Written(episodes(judged, config["run"]["batch_size"]), "records").df
    late = rows.where("late").select("seq", "id", F.lit("dropped_noise").alias("status"), F.lit("disorder").alias("reason"))
    return records, calls.absorbed(judged).select("seq", "id", "status", "reason").unionByName(late), bad
