"""Calls to a judge: for each kind of call a plan (rows with a prompt) and a resolution (what the answers come to).

A plan is a DataFrame, one row a call; `judges.ask` or a table gives the answers; a resolution takes rows with
`answer` and gives the stage's verdicts. Answers that are missing or out of shape come to what the stage does without
one, as each resolution says. Wording is this engine's own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.functions import text as text_fn
from millrace.functions.fit import INFLATION
from millrace.judges import Judge, ask
from millrace.operators import quality, votes
from millrace.runtime import Written

#: What a step is taken for where no answer says it, and the step between two runs of a thread.
OTHER_STEP, SEAM_STEP = "other", "app_switch"


def told(shape: dict) -> str:
    return "Answer with one JSON object of this shape and nothing else: " + json.dumps(shape, ensure_ascii=False, separators=(",", ":"))


def prompt(*parts: str | Column) -> Column:
    """Parts on lines of their own; null parts go."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def answered(plan: DataFrame, make: Callable[[], Judge], key: list[str], shape: dict, repairs: int = 2, check: Callable[[dict], list[str] | None] | None = None) -> DataFrame:
    """(key, output, problems, rounds, settled) of every call: asked again with what is wrong, `repairs` times at most.

    settled: at once, mended or asked_again; null where no round gave an object in shape. Answers are written round
    by round, so that no call is made twice because a task is.
    """
    open_, done = plan.select(*key, "prompt"), None
    for k in range(repairs + 1):
        got = ask(open_, make, key).withColumn("_s", shapes.shaped_column(F.col("answer"), shape, check))
        got = open_.join(got, key).select(*key, "prompt", "_s.*", "problem")
        got = Written(got.withColumn("problems", F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.col("problems"))), "answers").df
        good = F.col("output").isNotNull()
        settled = F.when(good, F.lit("asked_again") if k else F.when(F.col("mended"), "mended").otherwise("at_once"))
        out = got.where(good | F.lit(k == repairs)).select(*key, "output", "problems", F.lit(k).alias("rounds"), settled.alias("settled"))
        done = out if done is None else done.union(out)
        if k < repairs:
            left = got.where(~good)
            if left.isEmpty():
                break
            open_ = left.select(*key, prompt(F.col("prompt"), "The last answer was wrong:", F.array_join("problems", "\n"), "Answer again.").alias("prompt"))
    return done


# frames of a session
def window_calls(frames: DataFrame, session: str, pos: str, digest: str, width: int = 20) -> DataFrame:
    """(session, start, end, prompt): windows of `width` frames that share one frame with the next.

    Frames (pos from 0 in each session) find their windows by arithmetic: one, or two for a shared frame.
    """
    size = frames.groupBy(session).agg(F.max(pos).alias("_last"))
    step = width - 1
    own = F.floor(F.col(pos) / step)
    both = F.filter(F.array(own, F.when((F.col(pos) % step == 0) & (own > 0), own - 1)), lambda w: w.isNotNull() & ((w == 0) | (w * step < F.col("_last"))))
    rows = frames.join(size, session).select(session, pos, digest, F.explode(both).alias("_w"))
    lines = rows.groupBy(session, "_w").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(digest, F.lit("")).alias("d")))).alias("_l"))  # `width` frames at most
    line = F.array_join(F.transform("_l", lambda x: F.concat((x["p"] - F.col("_w") * step).cast("string"), F.lit(": "), x["d"])), "\n")
    ask_ = "Say for each numbered screen how it goes on from the ones before it: " + ", ".join(shapes.RELATIONS) + "."
    return lines.select(session, (F.col("_w") * step).alias("start"), (F.col("_w") * step + F.size("_l")).alias("end"), prompt(ask_, line).alias("prompt"))


def window_relations(answers: DataFrame, session: str) -> DataFrame:
    """(session, pos, start, relation, degraded) from (session, start, end, answer).

    Of entries for one frame the first counts; a frame without one continues. A window without an answer in shape
    makes its whole session degraded: all its frames continue, so that it stays one episode.
    """
    found = F.from_json("answer", "struct<frames:array<struct<index:int,relation:string>>>")["frames"]
    rows = answers.withColumn("_f", found).withColumn("_bad", F.col("_f").isNull())
    rows = rows.withColumn("degraded", F.max("_bad").over(Window.partitionBy(session)))
    each = rows.select(session, "start", "degraded", "_f", F.explode(F.sequence(F.lit(0), (F.col("end") - F.col("start") - 1).cast("int"))).alias("_i"))
    first = F.get(F.filter("_f", lambda x: x["index"] == F.col("_i")), 0)["relation"]
    known = F.when(~F.col("degraded") & first.isin(*shapes.RELATIONS), first)
    return each.select(session, (F.col("start") + F.col("_i")).alias("pos"), "start", F.coalesce(known, F.lit("continues")).alias("relation"), "degraded")


def episodes(assembled: DataFrame, session: str, pos: str, frame: str) -> DataFrame:
    """(session, segment, episode_id, members, head, tail, len) of the active frames of `sessions.segments`.

    An episode's id is made of its members' ids in order. Its members, whose frames then count as absorbed, are as many
    as the session's length cap lets them be.
    """
    rows = assembled.where("status = 'active'").groupBy(session, "segment").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(frame).cast("string").alias("id")))).alias("_m"))
    ids = F.transform("_m", lambda x: x["id"])
    return rows.select(session, "segment", F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, 16).alias("episode_id"), ids.alias("members"), F.get("_m", 0)["p"].alias("head"), F.element_at("_m", -1)["p"].alias("tail"), F.size("_m").alias("len"))


def absorbed(assembled: DataFrame) -> DataFrame:
    """`sessions.segments` rows as a run accounts for them: frames that went into an episode are absorbed."""
    return assembled.withColumn("status", F.when(F.col("status") == "active", "absorbed").otherwise(F.col("status")))


# steps between neighbours
def step_calls(pairs: DataFrame, key: list[str], before: str, after: str, instruction: str = "", change: str | None = None) -> DataFrame:
    """(key, prompt) of each pair of neighbouring frames that is no seam (`seam` true: no call)."""
    lines = [F.concat(F.lit("Before: "), F.col(before)), F.concat(F.lit("After: "), F.col(after))] + ([F.concat(F.lit("Change: "), F.col(change))] if change else [])
    rows = pairs.where(~F.coalesce("seam", F.lit(False))) if "seam" in pairs.columns else pairs
    return rows.select(*key, prompt("Say which action leads from the first screen to the second: " + ", ".join(shapes.ACTIONS) + ".", *([instruction] if instruction else []), *lines).alias("prompt"))


def steps(pairs: DataFrame, answers: DataFrame, key: list[str], on_error: str = "fallback") -> DataFrame:
    """(key, action_type, target, value, description, kind) of every pair.

    A seam is a step of its own kind (`thread_seam`) without a call; its description names the threads between. A pair
    whose answer is out of shape is an `other` step of kind `extraction_invalid`, or, with on_error fail, a null one.
    Directions of scrolling are lower-case.
    """
    got = answers.select(*key, F.from_json("answer", "struct<action_type:string,target:string,value:string,description:string>").alias("_a"))
    rows = pairs.join(got, key, "left")
    seam = F.coalesce(F.col("seam"), F.lit(False)) if "seam" in pairs.columns else F.lit(False)
    between = F.col("interrupted_by") if "interrupted_by" in pairs.columns else F.array().cast("array<string>")
    good = F.coalesce(F.col("_a.action_type").isin(*shapes.ACTIONS) & F.col("_a.description").isNotNull(), F.lit(False))
    value = F.when(F.col("_a.action_type") == "scroll", F.lower("_a.value")).otherwise(F.col("_a.value"))
    lost = F.lit(OTHER_STEP if on_error == "fallback" else None).cast("string")
    return rows.select(
        *key,
        F.when(seam, SEAM_STEP).when(good, F.col("_a.action_type")).otherwise(lost).alias("action_type"),
        F.when(~seam & good, F.col("_a.target")).alias("target"), F.when(~seam & good, value).alias("value"),
        F.when(seam, F.concat(F.lit("back after "), F.array_join(between, ", "))).when(good, F.col("_a.description")).otherwise("").alias("description"),
        F.when(seam, "thread_seam").when(~good, "extraction_invalid").alias("kind"),
    )


def step_line(index: Column, action: Column, target: Column, value: Column, description: Column, kind: Column) -> Column:
    """One step as a line of text."""
    dash = F.lit("-")
    mark = F.when(kind == "extraction_invalid", " [not recognised]").when(kind == "thread_seam", " [seam]").otherwise("")
    return F.concat(index.cast("string"), F.lit(". "), action, F.lit(" (on "), F.coalesce(target, dash), F.lit(", value "), F.coalesce(value, dash), F.lit(") "), description, mark)


def change_line(added: Column, removed: Column, changed: Column, ratio: Column) -> Column:
    """A screen's difference to the one before as a line of text."""
    return F.format_string("%d added, %d removed, %d with other text, %.0f%% changed", added, removed, changed, ratio * 100)


def critique_line(judge: Column, aspect: Column, opinion: Column) -> Column:
    return F.concat(F.when(judge.isNotNull(), F.concat(judge, F.lit("/"))).otherwise(""), aspect, F.lit(": "), opinion)


def fragment_lines(fragments: DataFrame, thread: str) -> DataFrame:
    """(thread, text): the fragments (first_pos, last_pos, len, cause) of each thread, a line each, in order."""
    line = F.format_string("frames %d to %d (%d, %s)", "first_pos", "last_pos", "len", "cause")
    rows = fragments.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct("first_pos", line.alias("l")))).alias("_l"))
    return rows.select(thread, F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("text"))


def affected_pairs(before: DataFrame, after: DataFrame, episode: str, pos: str) -> DataFrame:
    """(episode, left, right): neighbours that an episode has after its members were changed and didn't have before."""
    def pairs(df: DataFrame) -> DataFrame:
        right = F.lead(pos).over(Window.partitionBy(episode).orderBy(pos))
        return df.select(episode, F.col(pos).alias("left"), right.alias("right")).where("right is not null")

    return pairs(after).join(pairs(before), [episode, "left", "right"], "left_anti")


def renumbered(kept: DataFrame, episode: str, pos: str) -> DataFrame:
    """`kept` steps with idx from 0 in each episode, in order of pos."""
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(episode).orderBy(pos)) - 1)


# classes
def class_calls(items: DataFrame, key: list[str], text: str, classes: list[dict], instruction: str = "", most: int | None = None) -> DataFrame:
    """(key, prompt): which of the classes (name, description) an item belongs to."""
    table = "\n".join(f"{c['name']}: {c.get('description', '')}" for c in classes)
    return items.select(*key, prompt("Name the class of the text." if most is None else f"Name up to {most} classes of the text.", *([instruction] if instruction else []), table, F.col(text)).alias("prompt"))


def class_verdicts(answers: DataFrame, key: list[str], classes: list[str], fallback: str, most: int | None = None, samples: int = 1, on_error: str = "fallback") -> DataFrame:
    """(key, labels, agreement, source) from (key, answer), `samples` rows a key.

    An answer out of shape abstains. Labels stand in more than half of the samples; else it is the fallback. Without a
    single vote the labels are the fallback (source fallback), or null where on_error is fail.
    """
    raw = F.from_json("answer", "struct<class:string,classes:array<string>>")
    named = F.coalesce(raw["classes"], F.when(raw["class"].isNotNull(), F.array(raw["class"])))
    known = votes.normalized_labels(named, classes, fallback, most)
    rows = answers.withColumn("_l", F.when(named.isNotNull() & (F.size(known) > 0), known))
    some = rows.groupBy(*key).agg(F.count("_l").alias("_votes"))
    voted = votes.label_votes(rows.select(*key, F.col("_l").alias("labels")), key, "labels", samples, classes, fallback).join(some, key)
    none = F.col("_votes") == 0
    failed = F.lit(None).cast("array<string>") if on_error == "fail" else F.col("labels")
    return voted.select(*key, F.when(none, failed).otherwise(F.col("labels")).alias("labels"), "agreement", F.when(none, "fallback").otherwise("judge").alias("source"))


# scores
def comparison_calls(plan: DataFrame, items: DataFrame, pool: list[str], item: str, text: str, criteria: list[str], judges: list[str] | None = None, both_orders: bool = False) -> DataFrame:
    """(pool, round, first, second, judge, flipped, prompt) of each pair of a plan, for each judge and order.

    `flipped`: the second item is shown as A. Without both_orders the plan's own draw (first_is_a) decides.
    """
    shown = [items.select(F.col(item).alias(c), F.col(text).alias(f"_{c}")) for c in ("first", "second")]
    rows = plan.join(shown[0], "first").join(shown[1], "second").withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges or ["default"]])))
    orders = F.array(F.lit(False), F.lit(True)) if both_orders else F.array(~F.col("first_is_a"))
    rows = rows.withColumn("flipped", F.explode(orders))
    a, b = F.when(F.col("flipped"), F.col("_second")).otherwise(F.col("_first")), F.when(F.col("flipped"), F.col("_first")).otherwise(F.col("_second"))
    ask_ = "Compare A and B on each of: " + ", ".join(criteria) + "."
    return rows.select(*pool, "round", "first", "second", "judge", "flipped", prompt(ask_, "A:", a, "B:", b).alias("prompt"))


def comparisons(answers: DataFrame, pool: list[str], criteria: list[str]) -> DataFrame:
    """(pool, round, first, second, criterion, winner): A is the first item, B the second; null where all calls failed.

    Of judgments of one criterion the first counts; one that is absent is a tie, an answer out of shape a failed call.
    Orders of a judge are composed first, then the panel votes.
    """
    key = [*pool, "round", "first", "second"]
    found = F.from_json("answer", "struct<judgments:array<struct<criterion:string,winner:string>>>")["judgments"]
    rows = answers.select(*key, "judge", "flipped", found.alias("_j"), F.explode(F.array(*[F.lit(c) for c in criteria])).alias("criterion"))
    said = F.get(F.filter("_j", lambda x: x["criterion"] == F.col("criterion")), 0)["winner"]
    said = F.when(F.col("_j").isNull(), None).when(said.isin("A", "B"), said).otherwise("tie")
    turned = F.when(F.col("flipped") & (said == "A"), "B").when(F.col("flipped") & (said == "B"), "A").otherwise(said)
    each = rows.select(*key, "judge", "criterion", "flipped", turned.alias("v")).groupBy(*key, "judge", "criterion")
    orders = each.agg(F.max(F.when(~F.col("flipped"), F.col("v"))).alias("ab"), F.max(F.when(F.col("flipped"), F.col("v"))).alias("ba"), F.count("*").alias("_n"))
    verdict = F.when(F.col("_n") > 1, quality.compose_orders(F.col("ab"), F.col("ba"))).otherwise(F.coalesce("ab", "ba"))
    return quality.panel_majority(orders.withColumn("verdict", verdict), [*key, "criterion"], "verdict")


def score_calls(items: DataFrame, key: list[str], text: str, criteria: list[tuple[str, float, str]]) -> DataFrame:
    """(key, criterion, weight, prompt): one call for each item and criterion (name, weight, question)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(float(w)).alias("weight"), F.lit(q).alias("q")) for c, w, q in criteria]))
    rows = items.select(*key, F.col(text).alias("_t"), each.alias("c"))
    return rows.select(*key, "c.criterion", "c.weight", prompt(f"Give the text 0 to {shapes.POINTS} points.", F.col("c.q"), F.col("_t")).alias("prompt"))


def scores(answers: DataFrame, key: list[str]) -> DataFrame:
    """(key, criterion, weight, score) with score in 0 to 1; null where the answer is out of shape or of another criterion."""
    first = F.get(F.from_json("answer", "struct<scores:array<struct<criterion:string,score:int>>>")["scores"], 0)
    good = (first["criterion"] == F.col("criterion")) & first["score"].between(0, shapes.POINTS)
    return answers.select(*key, "criterion", "weight", F.when(good, first["score"] / shapes.POINTS).alias("score"))


# growth
def sample_calls(plan: DataFrame, seeds: DataFrame, item: str, text: str, per_call: int = 4, instruction: str = "") -> DataFrame:
    """(call_index, pool columns, model, style, seed_ids, prompt) of a plan of `generate.call_plan`."""
    shown = plan.select("call_index", F.posexplode("seed_ids").alias("_k", item)).join(seeds.select(item, F.col(text).alias("_t")), item)
    texts = shown.groupBy("call_index").agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_s"))  # seeds of one call
    lines = F.array_join(F.transform("_s", lambda x: x["_t"]), "\n---\n")
    rows = plan.join(texts, "call_index", "left")
    style = F.when(F.col("style").isNotNull(), F.concat(F.lit("Style: "), F.col("style")))
    return rows.select(*plan.columns, prompt(f"Write {per_call} new texts like these, none of them a copy.", *([instruction] if instruction else []), style, lines).alias("prompt"))


def samples(answers: DataFrame, key: list[str], per_call: int) -> DataFrame:
    """(key, place, text) of every sample; a call whose answer has not just `per_call` texts gives none."""
    got = F.from_json("answer", "struct<samples:array<string>>")["samples"]
    rows = answers.withColumn("_s", got).where((F.size("_s") == per_call) & F.forall("_s", lambda x: x.isNotNull()))
    return rows.select(*key, F.posexplode("_s").alias("place", "text"))


def screened(samples_: DataFrame, text: str, check: Callable[[str], list[str] | None]) -> DataFrame:
    """`samples_` with `refused`: what the user's own check of a text says; a check that fails refuses the sample."""
    from millrace.judges import violations

    @F.pandas_udf("array<string>")
    def said(texts):
        def one(t: str) -> list[str]:
            try:
                return violations(check(t))
            except Exception as error:  # the user's code; the row tells it
                return [f"{type(error).__name__}: {error}"]

        return texts.map(one)

    return samples_.withColumn("refused", said(F.col(text)))


def reentered(records: DataFrame, grown: DataFrame, batch_size: int) -> DataFrame:
    """`records` and the grown ones behind them: seq goes on, batches are their own, `source` says which is which."""
    from millrace.sources.jsonl import batches

    last = records.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s"), F.coalesce(F.max("batch_no"), F.lit(0)).alias("b")).first()
    numbered = batches(grown, ["call_index", "place"], batch_size)
    new = numbered.withColumn("seq", F.col("seq") + last["s"]).withColumn("batch_no", F.col("batch_no") + last["b"]).withColumn("origin", F.lit("grown"))
    return records.withColumn("origin", F.lit("given")).unionByName(new.drop("call_index", "place"), allowMissingColumns=True)


# outputs and reviews
def annotation_calls(items: DataFrame, key: list[str], text: str, instruction: str, shape: dict, shots: list[tuple[str, str]] = ()) -> DataFrame:
    """(key, prompt): the user's instruction and shape, worked examples, the item."""
    worked = "\n".join(f"Text: {a}\nAnswer: {b}" for a, b in shots)
    return items.select(*key, prompt(instruction, told(shape), *([worked] if worked else []), F.concat(F.lit("Text: "), F.col(text))).alias("prompt"))


def review_calls(items: DataFrame, key: list[str], text: str, output: str, judges: list[str], instruction: str = "") -> DataFrame:
    """(key, judge, prompt): each judge looks at each output once."""
    rows = items.withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges])))
    return rows.select(*key, "judge", prompt("Say what is wrong with the answer, if anything, then whether it passes.", *([instruction] if instruction else []), F.concat(F.lit("Text: "), F.col(text)), F.concat(F.lit("Answer: "), F.col(output))).alias("prompt"))


def reviews(answers: DataFrame, key: list[str]) -> DataFrame:
    """(key, verdict, critiques, defects) of each item.

    An answer out of shape is a fail without critiques. Critiques of several judges carry the judge's name. Defects
    are those of failing judges; a fail that names none is one of label_mismatch.
    """
    kind = "struct<critiques:array<struct<aspect:string,opinion:string>>,defects:array<struct<kind:string,members:array<string>,position:string>>,verdict:string>"
    rows = answers.withColumn("_r", F.from_json("answer", kind))
    rows = rows.withColumn("_v", F.when(F.col("_r.verdict").isin(*shapes.VERDICTS), F.col("_r.verdict")).otherwise("fail"))
    panel = F.count("*").over(Window.partitionBy(*key))
    judge = F.when(panel > 1, F.col("judge"))
    lines = F.transform(F.coalesce("_r.critiques", F.array().cast("array<struct<aspect:string,opinion:string>>")), lambda c: critique_line(F.col("_judge"), c["aspect"], c["opinion"]))
    rows = rows.withColumn("_judge", judge).withColumn("_c", lines)
    default = F.array(F.struct(F.lit("label_mismatch").alias("kind"), F.lit(None).cast("array<string>").alias("members"), F.lit(None).cast("string").alias("position")))
    named = F.coalesce(F.filter("_r.defects", lambda d: d["kind"].isin(*votes.DEFECTS)), F.array().cast("array<struct<kind:string,members:array<string>,position:string>>"))
    rows = rows.withColumn("_d", F.when(F.col("_v") == "fail", F.when(F.size(named) > 0, named).otherwise(default)))
    defects = rows.where("_v = 'fail'").select(*key, "judge", F.explode("_d").alias("d")).select(*key, "judge", "d.kind", F.coalesce("d.position", F.lit("")).alias("position"), F.coalesce(F.array_join(F.array_sort("d.members"), ","), F.lit("")).alias("members"))
    table = votes.defect_union(defects, key, "judge", "kind", "position", "members").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "position", "members"))), lambda x: F.concat_ws(":", x["kind"], x["position"], x["members"])).alias("defects"))  # six kinds
    verdicts = votes.verdict_majority(rows, key, "_v").withColumnRenamed("_v", "verdict")
    critiques = rows.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("judge", "_c"))), lambda x: x["_c"])).alias("critiques"))  # a row a judge
    out = verdicts.join(critiques, key).join(table, key, "left")
    return out.withColumn("defects", F.when(F.col("verdict") == "fail", F.coalesce("defects", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def repair_ladder(frames: Column, px: Column, most_px: Column, budget: Column, rest: Column, provider: Column) -> Column:
    """struct(frames, px) of an answer asked anew after a failed review: half the frames, half as large again.

    px is null where pictures have no declared size, are as large as they may be, or wouldn't fit the budget beside
    the prompt's other tokens (`rest`); the frames are halved all the same.
    """
    half = F.greatest(F.lit(2), F.ceil(frames / 2)).cast("int")
    up = F.least(F.round(px * 1.5).cast("int"), most_px)
    cost = F.ceil(text_fn.image_prior(provider, up) * INFLATION)
    return F.struct(half.alias("frames"), F.when((px > 0) & (up > px) & (rest + half * cost <= budget), up).alias("px"))


def token_usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls and tokens of each profile or key, over all (null) and in each, from rows (by, prompt_tokens, output_tokens)."""
    sets = [tuple(by), ()]
    rows = calls.groupingSets(sets, *by)
    return rows.agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
