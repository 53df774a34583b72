"""Fitting of texts and answers: cuts at line ends under a budget, prompt sizes, repair of answers."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import ASCII_PER_TOKEN, CJK_RANGES, OTHER_PER_TOKEN

#: Overhead of a message, the marker of left-out lines, cost of a window's difference line.
MESSAGE_TOKENS, MARKER, DIFF_TOKENS, INFLATION = 4, "…(truncated {n} lines)", 128, 1.2
NODES_LEFT = "…(truncated {n} nodes)"
#: An answer that lost over this many characters and more than a fifth in repair is taken as damaged.
LOSS_CHARS, LOSS_SHARE = 40, 0.8


def estimate(text: str) -> int:
    plain = sum(c < "\x80" for c in text)
    wide = sum(any(a <= ord(c) <= b for a, b in CJK_RANGES) for c in text) if plain < len(text) else 0
    return math.ceil(plain / ASCII_PER_TOKEN + wide + (len(text) - plain - wide) / OTHER_PER_TOKEN)


def fitted(text: str, budget: int, keep: str = "head") -> str:
    """`text` cut at line ends to the budget: its head, or its first and last lines around a marker."""
    if estimate(text) <= budget:
        return text
    lines = text.split("\n")
    fits = lambda k: estimate(build(k)) <= budget
    if keep == "head":
        build = lambda k: "\n".join(lines[:k])
        top = len(lines) - 1
    else:
        build = lambda k: "\n".join([*lines[: 1 + k], MARKER.format(n=len(lines) - 2 - k), lines[-1]])
        top = len(lines) - 3
        if top < 0 or not fits(0):
            return MARKER.format(n=len(lines))
    low, high = 0, max(0, top)  # the largest k that fits: sizes grow with k, but for a digit of the marker
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return build(low)


def capped_tree(lines: str, most: int, size: Callable[[str], int] = len) -> str:
    """A screen's lines cut at line ends to `most` by `size` (characters, or `estimate`), with how many nodes are left out.

    A text that ends with such a marker already adds its nodes to the new one. The marker alone stays where nothing fits.
    """
    if size(lines) <= most:
        return lines
    rows = lines.split("\n")
    gone = 0
    if marked := re.fullmatch(NODES_LEFT.replace("{n}", r"(\d+)").replace("(truncated", r"\(truncated").replace("nodes)", r"nodes\)"), rows[-1]):
        gone, rows = int(marked[1]), rows[:-1]

    def build(k: int) -> str:
        return "\n".join([*rows[:k], NODES_LEFT.format(n=gone + len(rows) - k)])

    low, high = 0, len(rows) - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if size(build(middle)) <= most else (low, middle - 1)
    return build(low)


def capped_tree_column(lines: Column, most: int, tokens: bool = False) -> Column:
    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else capped_tree(t, most, estimate if tokens else len))

    return cut(lines)


def fit_column(text: Column, budget: int, keep: str = "head") -> Column:
    @F.pandas_udf(T.StringType())
    def fit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fitted(t, budget, keep))

    return fit(text)


def prompt_tokens(texts: Column, images: Column, image_cost: Column, messages: Column, schema: Column) -> Column:
    """Estimated tokens of a prompt from the estimates of its text parts."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda s, x: s + x) + images * image_cost + MESSAGE_TOKENS * messages + F.coalesce(schema, F.lit(0))


def least_window(budget: Column, static: Column, digest_chars: int, image: Column | None = None) -> Column:
    """Frames that always fit a window, by the dearest frame there can be."""
    frame = F.lit(digest_chars + DIFF_TOKENS) + (F.ceil(image * INFLATION) if image is not None else F.lit(0))
    return F.greatest(F.lit(0), F.floor((budget - static) / frame))


def calibrated_image_cost(costs, batch: str, cost: str, prior: float, least: int = 8, safety: float = 0.85):
    """(batch, image_cost): the largest cost of the last eight batches over `safety`; until `least` samples the raised prior."""
    from pyspark.sql import Window

    per = costs.groupBy(batch).agg(F.max(cost).alias("_m"), F.count(cost).alias("_n"))
    back = Window.orderBy(batch)  # one row a batch
    seen = F.sum("_n").over(back.rowsBetween(Window.unboundedPreceding, -1))
    top = F.max("_m").over(back.rowsBetween(-8, -1))
    return per.select(batch, F.when(F.coalesce(seen, F.lit(0)) >= least, F.ceil(top / safety)).otherwise(F.ceil(F.lit(prior * INFLATION))).alias("image_cost"))


def repaired(answer: str) -> tuple[dict | None, bool]:
    """(object, damaged): the JSON object of an answer, closed where it was cut off; damaged where much was lost."""
    from millrace.judges import first_object

    body = first_object(answer) or (first_object(answer[answer.find("{") :]) if "{" in answer else None)
    if body is None:
        return None, False
    try:
        found = json.loads(body)
        return (found, False) if isinstance(found, dict) else (None, False)
    except ValueError:
        pass
    for end in range(len(body), 0, -1):  # the longest beginning that closes
        if end < len(body) and body[end] not in ",}]":
            continue
        found = _closed(body[:end])
        if found is not None:
            kept = len(json.dumps(found, ensure_ascii=False, separators=(",", ":")))
            size = len("".join(body.split()))
            return found, size - kept > LOSS_CHARS and kept < LOSS_SHARE * size
    return None, False


def _closed(text: str) -> dict | None:
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    try:
        found = json.loads(text.rstrip().rstrip(",") + '"' * quoted + "".join(reversed(stack)))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None
