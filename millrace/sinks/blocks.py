"""Blocks of a delivered row's `_meta`: every key is always there, null where its stage is off or gave nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source(file: Column, line_no: Column, pair_index: Column, generated_from: Column | None = None, fields: Column | None = None, generator: Column | None = None) -> Column:
    """Where a record comes from, as JSON: a line's number, or else the index of a pair (null for grown records).

    fields: values passed through, for delivered rows; generator: what made a grown record. Both are JSON texts; a null
    one is written as null.
    """
    ids = generated_from if generated_from is not None else F.array().cast("array<string>")
    shared = [file.alias("file"), F.coalesce(ids, F.array().cast("array<string>")).alias("generated_from")]
    spell = lambda place: F.to_json(F.struct(shared[0], place, shared[1]), {"ignoreNullFields": "false"})
    base = F.when(line_no.isNotNull(), spell(line_no.alias("line_no"))).otherwise(spell(pair_index.alias("pair_index")))
    more = [F.concat(F.lit(f',"{name}":'), F.coalesce(text, F.lit("null"))) for name, text in (("fields", fields), ("generator", generator)) if text is not None]
    return F.concat(F.regexp_replace(base, r"\}$", ""), *more, F.lit("}")) if more else base


def scores(rows: DataFrame, key: list[str], mode: str, pool: str | None = None) -> DataFrame:
    """(key, scores) from (key, criterion, score, aggregate, batch_no): criteria in order, then aggregate, mode, batch and pool, as JSON."""
    per = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("criterion", "score"))).alias("_s"), F.first("aggregate").alias("_a"), F.first("batch_no").alias("_b"), *([F.first(pool).alias("_p")] if pool else []))  # a rubric's criteria
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    each = F.transform("_s", lambda x: F.concat(F.to_json(F.array(x["criterion"])), F.lit(":"), number(x["score"])))
    names = F.transform(each, lambda t: F.regexp_replace(t, r'^\[(".*")\]:', "$1:"))
    tail = [F.concat(F.lit('"__aggregate__":'), number(F.col("_a"))), F.lit(f'"mode":"{mode}"'), F.concat(F.lit('"batch_no":'), number(F.col("_b")))]
    if pool:
        tail.append(F.concat(F.lit('"pool":'), F.coalesce(F.regexp_replace(F.to_json(F.array("_p")), r"^\[|\]$", ""), F.lit("null"))))
    return per.select(*key, F.concat(F.lit("{"), F.array_join(F.concat(names, F.array(*tail)), ","), F.lit("}")).alias("scores"))


def stream(episode_id: Column, session_id: Column, members: Column, orders: Column, steps: Column | None = None, split: Column | None = None, repaired: Column | None = None, degraded: Column | None = None, thread_id: Column | None = None, fragments: Column | None = None) -> Column:
    """An episode's place in its stream. members: array<struct(id, source)>, orders: order keys of the members."""
    no = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    parts = [episode_id.alias("episode_id")] + ([thread_id.alias("thread_id")] if thread_id is not None else [])
    parts += [session_id.alias("session_id"), F.array(F.get(orders, 0), F.get(orders, F.size(orders) - 1)).alias("order_span"), F.size(members).alias("member_count")]
    parts += [F.transform(members, lambda m: m["id"]).alias("member_ids"), F.transform(members, lambda m: m["source"]).alias("member_sources")]
    parts += [no(split).alias("session_split"), no(repaired).alias("repaired"), (degraded if degraded is not None else F.lit(None).cast("string")).alias("degraded")]
    parts += [fragments.alias("fragments")] if fragments is not None else []
    return F.struct(*parts, (steps if steps is not None else F.lit(None).cast("array<string>")).alias("steps"))


def meta(record: Column, run: Column, source_: Column, **blocks: Column) -> Column:
    """`_meta` as JSON. blocks: stream, scores, dedup, classification, annotation, verification, each JSON text or null."""
    order = ("stream", "scores", "dedup", "classification", "annotation", "verification")
    if unknown := blocks.keys() - set(order):
        raise ValueError(f"no such block: {', '.join(sorted(unknown))}")
    inner = [F.concat(F.lit(f'"{name}":'), F.coalesce(blocks[name], F.lit("null")) if name in blocks else F.lit("null")) for name in order]
    head = [F.concat(F.lit('"id":'), F.regexp_replace(F.to_json(F.array(record)), r"^\[|\]$", "")), F.concat(F.lit('"run":'), run), F.concat(F.lit('"source":'), source_)]
    return F.concat(F.lit("{"), F.concat_ws(",", *head, *inner), F.lit("}"))


def raw_payload(kind: Column, raw: Column, tree: Column, image: Column, member_ids: Column, member_sources: Column) -> Column:
    """What stands for a record's content where nothing was annotated, as JSON: the raw object, a screen's lines and picture, or an episode's members."""
    screen = F.to_json(F.struct(F.coalesce(tree, F.lit("")).alias("ui_tree"), F.coalesce(image, F.lit("")).alias("image_path")))
    episode = F.to_json(F.struct(F.lit("sequence").alias("kind"), member_ids.alias("member_ids"), member_sources.alias("member_sources")))
    return F.when(kind == "sequence", episode).when(kind == "ui", screen).otherwise(F.coalesce(raw, F.lit("{}")))


def reject(record: Column, source_: Column, stage: Column, reason: Column, errors: Column, label: Column | None = None, content: Column | None = None, last_output: Column | None = None) -> Column:
    """A rejected row as JSON. label: only where classes are given; content: only where rejects are kept whole."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
    parts = [F.concat(F.lit('"id":'), text(record)), F.concat(F.lit('"source":'), source_), F.concat(F.lit('"stage":'), text(stage)), F.concat(F.lit('"reason":'), text(reason)), F.concat(F.lit('"errors":'), F.to_json(F.coalesce(errors, F.array().cast("array<string>"))))]
    parts += [F.concat(F.lit('"label":'), text(label))] if label is not None else []
    whole = [F.concat(F.lit(',"record":'), content)] if content is not None else []
    if content is not None and last_output is not None:
        whole.append(F.when(reason == "schema_violation", F.concat(F.lit(',"raw_last_output":'), text(last_output))).otherwise(""))
    return F.concat(F.lit('{"_meta":{'), F.concat_ws(",", *parts), F.lit("}"), *whole, F.lit("}"))
