"""Shapes of answers as JSON Schemas, and answers brought into shape."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import schema
from millrace.functions.fit import repaired
from millrace.judges import violations
from millrace.operators.votes import DEFECTS

#: What a frame is to those before it, what a step can be, what a verdict can be.
RELATIONS = ("continues", "advances", "returns_to_entry", "context_switch", "interruption")
ACTIONS = ("click", "long_press", "input_text", "scroll", "drag", "open_app", "app_switch", "navigate_back", "navigate_home", "wait", "other")
SIDES, VERDICTS, JOINS, SURE, POINTS = ("A", "B", "tie"), ("pass", "fail"), ("resume", "new"), ("high", "medium", "low"), 5

TEXT: dict[str, Any] = {"type": "string"}
TEXT_OR_NULL: dict[str, Any] = {"type": ["string", "null"]}


def strict(**fields: dict) -> dict:
    """An object with these fields, all required, and no others."""
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def listed(item: dict, least: int | None = None, most: int | None = None) -> dict:
    bounds = {"minItems": least, "maxItems": most}
    return {"type": "array", "items": item} | {k: v for k, v in bounds.items() if v is not None}


def one_of(*names: str) -> dict:
    return {"type": "string", "enum": list(names)}


def whole(least: int, most: int) -> dict:
    return {"type": "integer", "minimum": least, "maximum": most}


def window(frames: int) -> dict:
    return strict(frames=listed(strict(index=whole(0, frames - 1), relation=one_of(*RELATIONS)), frames, frames))


ACTION = strict(action_type=one_of(*ACTIONS), target=TEXT_OR_NULL, value=TEXT_OR_NULL, description=TEXT)
JOIN = strict(verdict=one_of(*JOINS), thread_ref={"type": ["integer", "null"]}, task_name=TEXT, reason=TEXT, confidence=one_of(*SURE))
_CRITIQUES = listed(strict(aspect=TEXT, opinion=TEXT))
REVIEW = strict(critiques=_CRITIQUES, verdict=one_of(*VERDICTS))
EPISODE_REVIEW = strict(critiques=_CRITIQUES, defects=listed(strict(kind=one_of(*DEFECTS), members={"type": ["array", "null"], "items": TEXT}, position=TEXT_OR_NULL, detail=TEXT)), verdict=one_of(*VERDICTS))


def classes(names: list[str], most: int | None = None) -> dict:
    """One class, or a list of at most `most`."""
    return strict(**({"class": one_of(*names)} if most is None else {"classes": listed(one_of(*names), 1, most)}))


def comparison(criteria: list[str]) -> dict:
    return strict(judgments=listed(strict(criterion=one_of(*criteria), winner=one_of(*SIDES)), len(criteria), len(criteria)))


def points(criterion: str) -> dict:
    return strict(scores=listed(strict(criterion=one_of(criterion), reason=TEXT, score=whole(0, POINTS)), 1, 1))


def samples(n: int) -> dict:
    return strict(samples=listed(TEXT, n, n))


def unknown_words(shape: dict) -> list[str]:
    """What of a schema can't be checked here, so that a user's schema can be refused instead of half checked."""
    try:
        schema.compiled(shape)
    except schema.SchemaError as error:
        return [str(error)]
    return []


def pointer(path: tuple[str | int, ...]) -> str:
    """JSON Pointer of a place; the whole is "/"."""
    return "/" + "/".join(str(p).replace("~", "~0").replace("/", "~1") for p in path)


def faults(value: Any, shape: dict | schema.Program, path: tuple[str | int, ...] = ()) -> list[str]:
    """`pointer: what is wrong` of every fault, in the order of the pointers, then of the words."""
    program = shape if isinstance(shape, schema.Program) else schema.compiled(shape)
    return [f"{pointer(p)}: {said}" for p, said in sorted(program.run(value, path), key=lambda x: ([str(k) for k in x[0]], x[1]))]


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def shaped(answer: str | None, shape: dict | schema.Program, check: Callable[[dict], list[str] | None] | None = None) -> tuple[str | None, list[str], bool]:
    """(object as JSON, faults, whether it had to be mended) of an answer; an object only without faults."""
    if answer is None:
        return None, ["/: no answer"], False
    found, damaged = repaired(answer)
    if found is None:
        return None, ["/: no object"], False
    if damaged:
        return None, ["/: too much was lost in mending"], True
    told = faults(found, shape)
    if not told and check is not None:
        told = violations(check(found))
    spelt = json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    mended = "".join(answer.split()) != "".join(spelt.split())
    return (None if told else spelt), told, mended


def shaped_column(answer: Column, shape: dict, check: Callable[[dict], list[str] | None] | None = None) -> Column:
    """struct(output, problems, mended) of an answer; `check` is the user's own, called on sound objects alone."""

    @F.pandas_udf("output string, problems array<string>, mended boolean")
    def one(answers: pd.Series) -> pd.DataFrame:
        program = schema.compiled(shape)
        return pd.DataFrame([shaped(a, program, check) for a in answers], columns=["output", "problems", "mended"])

    return one.asNondeterministic()(answer)


def fault_column(text: Column, shape: dict) -> Column:
    """array of what is wrong with a JSON text by a schema; empty where nothing is."""

    @F.pandas_udf("array<string>")
    def told(texts: pd.Series) -> pd.Series:
        program = schema.compiled(shape)

        def one(t: str | None) -> list[str]:
            try:
                return faults(json.loads(t), program) if t is not None else ["/: nothing there"]
            except ValueError:
                return ["/: no JSON"]

        return pd.Series([one(t) for t in texts], dtype=object)

    return told(text)


def canonical_column(text: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null where it is no JSON."""

    @F.pandas_udf("string")
    def spelt(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else canonical(json.loads(t))
            except ValueError:
                return None

        return texts.map(one)

    return spelt(text)
