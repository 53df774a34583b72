"""Calls that a run will make, from counts alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Run:
    """What of a configuration decides the number of calls; 0 or False where a stage is off."""

    batch_size: int = 256
    pairwise_rounds: int = 4
    pairwise: bool = True
    criteria: int = 4
    criteria_single: bool = False
    judges: int = 1
    both_orders: bool = False
    classify: bool = False
    classify_samples: int = 0
    generate: bool = False
    per_record: int = 2
    per_call: int = 4
    annotate: bool = True
    annotate_samples: int = 0
    verify: bool = False
    verify_judges: int = 1
    window: int = 20
    stitch: bool = False
    votes: int = 1
    second_pass: bool = True
    extract: bool = False


def up(a: int, b: int) -> int:
    return -(-a // b)


def next_fit(lengths: Iterable[int], size: int) -> list[tuple[int, int]]:
    """(frames, sessions) of each batch: whole sessions in order, longer ones in slices of their own."""
    out: list[tuple[int, int]] = []
    frames = pieces = 0
    for n in lengths:
        if frames and frames + n > size:
            out.append((frames, pieces))
            frames = pieces = 0
        if n > size:
            out += [(min(size, n - at), 1) for at in range(0, n, size)]
        else:
            frames, pieces = frames + n, pieces + 1
    return [*out, (frames, pieces)] if frames else out


def estimate(records: int, run: Run, sessions: list[int] | None = None) -> dict[str, int]:
    """Upper bound of calls by stage. sessions: frames of each session where the input is a stream."""
    made = up(records * run.per_record, run.per_call) if run.generate else 0
    total = records + made * run.per_call
    pools = [run.batch_size] * (total // run.batch_size) + [total % run.batch_size] * (total % run.batch_size > 0)
    base, calls = total, dict.fromkeys(("generate", "segment", "stitch", "classify", "extract", "quality", "annotate", "verify"), 0)
    calls["generate"] = made
    if sessions is not None:
        pools, base = [p for _, p in next_fit(sessions, run.batch_size)], len(sessions)
        calls["segment"] = sum(up(n - 1, run.window - 1) for n in sessions if n > 1)
        calls["stitch"] = base * run.votes * (1 + run.second_pass) if run.stitch else 0
        calls["extract"] = sum(n - 1 for n in sessions) if run.extract else 0
    calls["classify"] = (base if sessions is not None else records) * max(1, run.classify_samples) if run.classify else 0
    if run.pairwise and run.criteria:
        calls["quality"] = sum(run.pairwise_rounds * (p // 2) for p in pools) * (run.criteria if run.criteria_single else 1) * run.judges * (1 + run.both_orders)
    else:
        calls["quality"] = base * run.criteria
    calls["annotate"] = base * (run.annotate_samples if run.annotate_samples >= 3 else 1) if run.annotate else 0
    calls["verify"] = base * run.verify_judges if run.verify else 0
    return {"records": total, "batches": len(pools), **{f"{k}_calls": v for k, v in calls.items()}, "total_calls": sum(calls.values())}
