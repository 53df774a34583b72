"""Column functions on screen trees: arrays of node structs in depth-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where app and activity stand, and roles that take part in interaction.
APP_KEYS, ACTIVITY_KEYS = ("package", "package_name", "pkg"), ("activity", "activity_name", "window_title")
INTERACTIVE = ("Button", "EditText", "CheckBox", "Switch", "ImageButton")
POOR_CHARS, POOR_CAP = 8, 400


def shown(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["visible"])


def linear(nodes: Column, quantize: int = 0) -> Column:
    """One line for each visible node: indent, role, text, description, bounds, further fields."""
    def line(n: Column) -> Column:
        box = F.transform(n["bounds"], lambda c: (F.floor(c / quantize) if quantize else c).cast("string"))
        extra = F.transform(F.filter(F.map_entries(n["extra"]), lambda e: e["value"] != ""), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), e["value"]))
        quoted = lambda before, v: F.when(v != "", F.concat(F.lit(before), v, F.lit('"'))).otherwise("")
        return F.concat(F.repeat(F.lit("  "), n["depth"]), n["role"], quoted(' "', n["text"]), quoted(' desc="', n["content_desc"]), F.lit(" ["), F.array_join(box, ","), F.lit("]"), F.array_join(extra, ""))
    return F.array_join(F.transform(shown(nodes), line), "\n")


def first_extra(nodes: Column, keys: tuple[str, ...]) -> Column:
    """The first non-empty value that a visible node has under one of the keys."""
    values = F.transform(shown(nodes), lambda n: F.coalesce(*[F.when(n["extra"][k] != "", n["extra"][k]) for k in keys]))
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def title(nodes: Column) -> Column:
    return F.get(F.filter(F.transform(shown(nodes), lambda n: n["text"]), lambda t: t != ""), 0)


def dedup_text(nodes: Column, quantize: int = 4) -> Column:
    """The text by which screens are compared: their lines with quantised bounds."""
    return linear(nodes, quantize)


def entities(nodes: Column) -> Column:
    """Distinct texts and descriptions of visible nodes, in order."""
    pieces = F.flatten(F.transform(shown(nodes), lambda n: F.array(n["text"], n["content_desc"])))
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


def apps(screens: DataFrame, key: list[str], nodes: str) -> DataFrame:
    """(key, apps): the distinct apps of the screens of each key, such as an episode's frames; screens without one add none."""
    return screens.groupBy(*key).agg(F.array_sort(F.collect_set(first_extra(F.col(nodes), APP_KEYS))).alias("apps"))


def page(nodes: Column) -> Column:
    """What tells a page from others: app, activity and title as JSON; null without an app or an activity."""
    app, act = first_extra(nodes, APP_KEYS), first_extra(nodes, ACTIVITY_KEYS)
    return F.when(app.isNotNull() & act.isNotNull(), F.to_json(F.array(app, act, title(nodes)), {"ignoreNullFields": "false"}))


def digest(nodes: Column, most: int) -> Column:
    """One line for a screen: app, activity, title and what stands on it, cut to `most` characters."""
    def pieces(n: Column) -> Column:
        star = F.exists(F.array(*[F.lit(r) for r in INTERACTIVE]), lambda r: F.contains(n["role"], r))
        return F.transform(F.filter(F.array(n["text"], n["content_desc"]), lambda p: p != ""), lambda p: F.struct(p.alias("p"), star.alias("s")))
    flat = F.flatten(F.transform(shown(nodes), pieces))
    firsts = F.transform(F.array_distinct(F.transform(flat, lambda x: x["p"])), lambda p: F.get(F.filter(flat, lambda x: x["p"] == p), 0))
    salient = F.array_join(F.transform(firsts, lambda x: F.concat(F.when(x["s"], "*").otherwise(""), x["p"])), "、")
    app, act, head_text = first_extra(nodes, APP_KEYS), first_extra(nodes, ACTIVITY_KEYS), title(nodes)
    head = F.when(app.isNull(), "").when(act.isNull(), F.concat(F.lit("["), app, F.lit("] "))).otherwise(F.concat(F.lit("["), app, F.lit(" activity="), act, F.lit("] ")))
    body = F.when(head_text.isNull(), salient).otherwise(F.concat(head_text, F.lit("｜"), salient))
    full = F.when(body == "", F.rtrim(head)).otherwise(F.concat(head, body))
    return F.when(nodes.isNull(), "").when(F.length(full) > most, F.concat(F.substring(full, 1, most - 1), F.lit("…"))).otherwise(full)


def poor(nodes: Column) -> Column:
    """Whether a screen says too little: nothing to read on it, or a digest of under 8 characters."""
    return nodes.isNull() | (F.size(entities(nodes)) == 0) | (F.length(digest(nodes, POOR_CAP)) < POOR_CHARS)


def diff(pairs: DataFrame, key: list[str], before: str, after: str, quantize: int = 4) -> DataFrame:
    """(key, added, removed, text_changed, change_ratio): multiset difference of the visible nodes of two screens."""
    def side(column: str, name: str) -> DataFrame:
        rows = pairs.select(*key, F.explode(shown(F.coalesce(F.col(column), F.array().cast(pairs.schema[column].dataType)))).alias("n"))
        box = F.transform("n.bounds", lambda c: F.floor(c / quantize) if quantize else c)
        place = F.struct(F.col("n.role"), box.alias("box"), F.col("n.depth"))
        return rows.groupBy(*key, place.alias("place"), F.struct("n.text", "n.content_desc").alias("what")).agg(F.count("*").alias(name))
    both = side(before, "a").join(side(after, "b"), [*key, "place", "what"], "full_outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    per = both.groupBy(*key, "place").agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(F.least(a, b)).alias("same"))
    pairs_there = F.least("a", "b")
    out = per.groupBy(*key).agg(F.sum(F.col("b") - pairs_there).alias("added"), F.sum(F.col("a") - pairs_there).alias("removed"), F.sum(pairs_there - F.col("same")).alias("text_changed"), F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    out = pairs.select(*key).join(out, key, "left").na.fill(0, ["added", "removed", "text_changed", "_a", "_b"])
    return out.withColumn("change_ratio", (F.col("added") + F.col("removed") + F.col("text_changed")) / F.greatest(F.lit(1), "_a", "_b")).drop("_a", "_b")
