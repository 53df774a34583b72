"""URL filter: glob rules simulated all at once by a bit-parallel Shift-And automaton.

A canonical url is `host/path`: the host lower-cased (A-Z), then the path as it is, query and fragment
left out. A rule is a glob over that string:

    ?     one character, not `/` in the host part
    *     any run of characters, not `/` in the host part (before the glob's first `/`)
    other the character itself

All rules share one row of bits, one bit for each position of each rule, packed into as many 64-bit words
as they need. A step over one character is `D = ((D << 1) & B[c]) | (D & S[c])`: B[c] holds the positions
that c may enter, S[c] those that wait under a `*`. The step is taken for a whole batch of urls at once,
so the work for a url is its length times the number of words, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (name, verdict). A rule `domain/path` fits that host, its subdomains, and paths that start with `/path`.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs that judge what no rule fits: (glob, verdict); the longest that matches wins, otherwise DEFAULT.
FALLBACK_GLOBS = (
    ("*adult*/*", "block"),
    ("*casino*/*", "block"),
    ("ads.*/*", "block"),
    ("*.ads.*/*", "block"),
    ("*/*/ads/*", "block"),
    ("*/*.exe", "block"),
)
DEFAULT = "allow"
_OTHER = 128  # every character beyond ASCII shares one class


@dataclass(frozen=True)
class GlobAutomaton:
    """Masks of many globs. `accept` holds (word, bit) of each glob's last position."""

    enter: np.ndarray  # [class, word]
    stay: np.ndarray  # [class, word]
    start: np.ndarray  # [word]
    accept: tuple[tuple[int, int], ...]

    @staticmethod
    def build(globs: list[str]) -> GlobAutomaton:
        symbols: list[tuple[int, str, bool]] = []  # position, character, whether in the host part
        waits: list[tuple[int, bool]] = []
        starts, ends, at = [], [], 0
        for glob in globs:
            starts.append(at)
            host = True
            for ch in glob:
                if ch == "*":
                    waits.append((at, host))
                    continue
                host = host and ch != "/"
                at += 1
                symbols.append((at, ch, host))
            ends.append(at)
            at += 1
        words = max(1, -(-at // 64))
        enter = np.zeros((_OTHER + 1, words), np.uint64)
        stay, start = np.zeros_like(enter), np.zeros(words, np.uint64)
        bit = lambda p: np.uint64(1 << (p % 64))
        every = np.arange(_OTHER + 1)
        no_slash = every[every != ord("/")]
        for p, ch, host in symbols:
            classes = (no_slash if host else every) if ch == "?" else [min(ord(ch), _OTHER)]
            enter[classes, p // 64] |= bit(p)
        for p, host in waits:
            stay[no_slash if host else every, p // 64] |= bit(p)
        for p in starts:
            start[p // 64] |= bit(p)
        return GlobAutomaton(enter, stay, start, tuple((p // 64, p % 64) for p in ends))

    def match(self, urls: list[str], block: int = 4096) -> np.ndarray:
        """[url, glob] -> whether the glob fits the whole url. Globs must not hold characters beyond ASCII."""
        out = np.zeros((len(urls), len(self.accept)), bool)
        order = np.argsort([len(u) for u in urls], kind="stable")
        for i in range(0, len(order), block):
            rows = order[i : i + block]
            out[rows] = self._block([urls[r] for r in rows])
        return out

    def _block(self, urls: list[str]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls])
        flat = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = np.minimum(flat, _OTHER)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.repeat(self.start[None, :], len(urls), 0)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(lengths.max(initial=0))):
            alive = slice(int(np.searchsorted(lengths, step, "right")), None)  # lengths ascend in a block
            c = flat[begin[alive] + step]
            d = state[alive]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[alive] = (moved & self.enter[c]) | (d & self.stay[c])
        return np.stack([(state[:, w] >> np.uint64(b)) & one for w, b in self.accept], 1).astype(bool)


def rule_globs(rule: str) -> list[str]:
    """The globs of `domain/path`: the host itself, and its subdomains."""
    return [f"{rule}*", f"*.{rule}*"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge(rules=RULES, fallback=FALLBACK_GLOBS, default: str = DEFAULT):
    """A pandas UDF (host, path) -> struct(rule, verdict)."""
    globs, owner = [], []
    for k, (rule, _) in enumerate(rules):
        globs += rule_globs(rule)
        owner += [k, k]
    automaton = GlobAutomaton.build(globs + [g for g, _ in fallback])
    by_length = sorted(range(len(rules)), key=lambda k: -len(rules[k][0]))
    rest_order = sorted(range(len(fallback)), key=lambda k: -len(fallback[k][0]))
    schema = T.StructType().add("rule", "string").add("verdict", "string")

    @F.pandas_udf(schema)
    def verdicts(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        hits = automaton.match((host + path).tolist())
        fits = np.zeros((len(hits), len(rules)), bool)
        for g, k in enumerate(owner):
            fits[:, k] |= hits[:, g]
        rule, verdict = np.full(len(hits), None, object), np.full(len(hits), default, object)
        for k in reversed(rest_order):
            verdict[hits[:, len(owner) + k]] = fallback[k][1]
        for k in reversed(by_length):
            rule[fits[:, k]] = rules[k][0]
            verdict[fits[:, k]] = rules[k][1]
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    return verdicts


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **rules) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A null url, an empty one or one without `://` has an empty host and path and gets the default
    verdict. Repeated rows are judged each for itself; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    out = out.withColumn("_j", judge(**rules)("host", "path"))
    return out.select(id_col, "host", "path", "_j.rule", "_j.verdict")
