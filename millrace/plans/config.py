"""Configuration: TOML sections with defaults, all faults told at once, views by class."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from typing import Any

#: Sections, keys and defaults. A type stands for a key without a default.
SECTIONS: dict[str, dict[str, Any]] = {
    "run": {"input": None, "output": str, "modality": str, "mode": "process", "batch_size": 256, "seed": 0, "fatal_error_threshold": 20},
    "input": {"text_field": "text", "on_bad_line": "skip", "on_missing_pair": "skip", "on_index_conflict": "fail", "max_image_mb": 20, "ui_tree_max_chars": 30000},
    "dedup": {"enabled": True, "scope": "global", "minhash_threshold": 0.85, "minhash_num_perm": 128, "ngram": 5, "image_phash_max_distance": 8, "ui_dup_requires": "both", "bounds_quantize_px": 4, "semantic": False, "semantic_threshold": 0.95},
    "stream": {"order_by": "input_order", "on_disorder": "skip", "key": [], "gap_s": 300, "gap_steps": 0, "session_max_len": 200, "session_max_span_s": 0},
    "segment": {"enabled": False, "strategy": "hybrid", "window": 20, "digest_max_chars": 400, "noise_filter": True, "min_len": 2, "on_error": "keep"},
    "stitch": {"enabled": False, "max_open": 4, "bias": "conservative", "rescue_short": True, "repass": True, "stale_gap_steps": 0, "votes": 1, "on_error": "keep"},
    "extract": {"enabled": False, "instruction": "", "include_diff": True, "on_error": "fallback"},
    "classify": {"enabled": False, "assignment": "single", "max_labels": None, "fallback_class": "", "self_consistency": 0, "on_error": "fallback", "classes": []},
    "quality": {"enabled": True, "mode": "pairwise", "rounds": 4, "criteria_per_call": "all", "threshold": None, "selection": "threshold", "top_ratio": None, "judges": [], "both_orders": False, "on_unscored": "keep", "rubric": ""},
    "generate": {"enabled": False, "llms": ["default"], "mixture": "round_robin", "weights": [], "styles": [], "num_per_record": 2, "seeds_per_call": 3, "num_per_call": 4, "seed_min_score": None, "seed_examples": [], "standalone_count": None},
    "annotate": {"enabled": True, "instruction": "", "self_consistency": 0, "sequence_frames": 20},
    "verify": {"enabled": False, "judges": [], "policy": "drop", "max_repair_rounds": 1},
    "output": {"schema": None, "meta_mode": "inline", "passthrough_fields": [], "rejects": "refs", "max_repair_attempts": 2},
    "trace": {"enabled": False, "path": "", "channels": ["quality", "verify", "schema"], "content": "refs"},
}
#: What a key may be.
CHOICES = {
    ("run", "modality"): ("text", "ui"), ("run", "mode"): ("process", "generate_only"), ("input", "on_bad_line"): ("skip", "fail"),
    ("input", "on_missing_pair"): ("skip", "fail"), ("input", "on_index_conflict"): ("skip", "fail"), ("dedup", "scope"): ("global", "batch"),
    ("dedup", "ui_dup_requires"): ("both", "tree", "image"), ("stream", "on_disorder"): ("skip", "fail"), ("segment", "strategy"): ("rules", "llm", "hybrid"),
    ("stitch", "bias"): ("conservative", "llm"), ("classify", "assignment"): ("single", "multi"), ("quality", "mode"): ("pairwise", "pointwise"),
    ("quality", "selection"): ("threshold", "top_ratio"), ("quality", "on_unscored"): ("keep", "drop"), ("verify", "policy"): ("drop", "repair"),
    ("output", "meta_mode"): ("inline", "sidecar", "none"), ("output", "rejects"): ("refs", "full"), ("trace", "content"): ("none", "refs", "excerpt", "full"),
}
#: Keys that a class may set for itself.
BY_CLASS = {"quality": ("threshold", "selection", "top_ratio", "rubric", "on_unscored"), "annotate": ("instruction",), "generate": ("styles", "num_per_record"), "verify": ("policy",), "extract": ("instruction",)}
STAGES = ("segment", "stitch", "dedup", "classify", "extract", "quality", "generate", "annotate", "verify")


class ConfigError(ValueError):
    def __init__(self, faults: list[str]):
        self.faults = faults
        super().__init__("\n".join(faults))


@dataclass(frozen=True)
class Config:
    values: dict[str, dict[str, Any]] = field(default_factory=dict)
    classes: dict[str, dict[str, dict[str, Any]]] = field(default_factory=dict)
    digest: str = ""

    def __getitem__(self, section: str) -> dict[str, Any]:
        return self.values[section]

    def stages(self) -> list[str]:
        return [s for s in STAGES if self.values[s]["enabled"]]

    def of_class(self, name: str | None, section: str) -> dict[str, Any]:
        """A section as it holds for a class. A class that sets one selection key takes over the whole choice."""
        own = self.classes.get(name or "", {}).get(section, {})
        base = dict(self.values[section])
        if section == "quality" and own.keys() & {"threshold", "selection", "top_ratio"}:
            base |= {"threshold": None, "selection": "threshold", "top_ratio": None}
        return base | own


def load(*documents: str, overrides: dict[str, dict[str, Any]] | None = None) -> Config:
    """Merge TOML documents, later ones over earlier ones, then the overrides; raise one error with every fault."""
    faults, given = [], {}
    for n, text in enumerate(documents):
        try:
            for name, section in tomllib.loads(text).items():
                if isinstance(section, dict):
                    given[name] = given.get(name, {}) | section
                else:
                    faults.append(f"{name}: not a section")
        except tomllib.TOMLDecodeError as error:
            faults.append(f"document {n + 1}: {error}")
    for name, section in (overrides or {}).items():
        given[name] = given.get(name, {}) | {k: v for k, v in section.items() if v is not None}
    classes = given.pop("class", {})
    values = {}
    for name, keys in SECTIONS.items():
        own = given.pop(name, {})
        faults += [f"{name}.{k}: unknown key" for k in own.keys() - keys.keys()]
        values[name] = {}
        for key, default in keys.items():
            value = own.get(key, None if isinstance(default, type) else default)
            kind = default if isinstance(default, type) else type(default)
            if isinstance(default, type) and key not in own:
                faults.append(f"{name}.{key}: required")
            elif key in own and default is not None and not (isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) or kind is float and isinstance(value, int) and not isinstance(value, bool)):
                faults.append(f"{name}.{key}: {kind.__name__} expected")
            elif (allowed := CHOICES.get((name, key))) and value not in allowed:
                faults.append(f"{name}.{key}: one of {', '.join(allowed)}")
            values[name][key] = value
    faults += [f"{name}: unknown section" for name in given]
    for label, sections in classes.items():
        for section, own in sections.items():
            faults += [f"class.{label}.{section}.{k}: can't be set by class" for k in own if k not in BY_CLASS.get(section, ())]
    faults += _combinations(values, classes)
    if faults:
        raise ConfigError(sorted(faults))
    digest = hashlib.sha256(json.dumps([values, classes], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    return Config(values, classes, digest)


def from_environment(environ: dict[str, str], prefix: str = "MILLRACE_") -> str:
    """TOML of the variables named <prefix><SECTION>__<KEY>; values that are no TOML value are texts."""
    sections: dict[str, list[str]] = {}
    for name, value in sorted(environ.items()):
        section, mark, key = name.removeprefix(prefix).lower().partition("__")
        if name.startswith(prefix) and mark:
            try:
                tomllib.loads(f"x = {value}")
            except tomllib.TOMLDecodeError:
                value = json.dumps(value, ensure_ascii=False)
            sections.setdefault(section, []).append(f"{key} = {value}")
    return "\n".join(f"[{s}]\n" + "\n".join(keys) for s, keys in sections.items())


def example_faults(examples: list[dict], shape: dict, check=None) -> list[str]:
    """Faults of worked examples (each with `output`) against the project's own shape and check, before anything runs."""
    from millrace.functions import shapes
    from millrace.judges import violations

    if out := [f"output.schema: {w}" for w in shapes.unknown_words(shape)]:
        return out
    for k, example in enumerate(examples, 1):
        told = shapes.faults(example.get("output"), shape)
        if not told and check is not None:
            try:
                told = violations(check(example["output"]))
            except Exception as error:  # the user's code
                told = [f"{type(error).__name__}: {error}"]
        out += [f"examples {k}: {t}" for t in told[:1]]
    return out


def prompt_faults(static_tokens: dict[str, int], window: int, max_output: int) -> list[str]:
    """Calls whose fixed prompt alone (by name) is beyond the budget of a declared window; 0 declares none."""
    if not window:
        return []
    budget = window - max_output - max(256, -(-window // 10))
    return [f"{name}: {n} tokens before any record, {budget} allowed" for name, n in static_tokens.items() if n > budget]


def _combinations(v: dict[str, dict[str, Any]], classes: dict) -> list[str]:
    """Rules between sections."""
    names = [c["name"] if isinstance(c, dict) else c for c in v["classify"]["classes"]]
    rules = [
        (v["run"]["mode"] == "process" and not v["run"]["input"], "run.input: required to process"),
        (v["run"]["mode"] == "generate_only" and not v["generate"]["enabled"], "generate.enabled: needed by run.mode generate_only"),
        (v["run"]["mode"] == "generate_only" and v["segment"]["enabled"], "segment: not with run.mode generate_only"),
        (v["run"]["modality"] == "ui" and v["generate"]["enabled"], "generate: for text only"),
        (v["stitch"]["enabled"] and not v["segment"]["enabled"], "stitch: needs segment"),
        (v["extract"]["enabled"] and not v["segment"]["enabled"], "extract: needs segment"),
        (v["extract"]["enabled"] and v["run"]["modality"] != "ui", "extract: for screens only"),
        (v["verify"]["enabled"] and not v["annotate"]["enabled"], "verify: needs annotate"),
        (v["classify"]["enabled"] and not names, "classify.classes: required"),
        (v["classify"]["enabled"] and v["classify"]["fallback_class"] not in names, "classify.fallback_class: one of the classes"),
        (v["quality"]["selection"] == "top_ratio" and not (isinstance(v["quality"]["top_ratio"], (int, float)) and 0 < v["quality"]["top_ratio"] <= 1), "quality.top_ratio: above 0, at most 1"),
        (v["segment"]["window"] < 2, "segment.window: 2 at least"),
        (bool(v["generate"]["weights"]) and len(v["generate"]["weights"]) != len(v["generate"]["llms"]), "generate.weights: one for each model"),
    ]
    shape = v["output"]["schema"]
    if isinstance(shape, dict):
        from millrace.functions import shapes

        rules += [(True, f"output.schema: {w}") for w in shapes.unknown_words(shape)]
    return [text for bad, text in rules if bad] + [f"class.{c}: not among classify.classes" for c in classes if c not in names]
