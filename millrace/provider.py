"""A judge over HTTP: two wire formats, keys, retries, a breaker. One client lives in each task.

The limits are those of a task: with T tasks at once a service sees T times `concurrency` requests. The breaker
of a task stops that task's calls; the driver sees failed rows, not a failed job.
"""

from __future__ import annotations

import base64
import email.utils
import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import Lock

#: What a service answers when a prompt is too long, and finish reasons of cut-off answers.
OVERFLOW_WORDS = ("context length", "context_length", "maximum context", "too many tokens", "prompt is too long")
CUT_OFF = ("length", "max_tokens")
#: Longest rest of a key that was told to slow down, and statuses below 500 that are worth another try.
LONGEST_REST_S, AGAIN = 300.0, (408, 409, 429)


class ProviderError(RuntimeError):
    """kind: provider_fatal, provider_retryable_exhausted, context_overflow or output_truncated."""

    def __init__(self, kind: str, message: str):
        self.kind = kind
        super().__init__(f"{kind}: {message}")


@dataclass(frozen=True)
class Profile:
    name: str
    base_url: str
    model: str
    keys: tuple[str, ...]
    wire: str = "chat"  # or "messages"
    concurrency: int = 8
    timeout_s: float = 120
    retries: int = 5
    base_delay_s: float = 1.0
    max_park_s: float = 600  # no call waits longer than this in all, whatever a service asks for
    max_output: int = 4096
    window: int = 0
    temperature: float = 0.0


def body(profile: Profile, system: str, prompt: str, schema: dict | None = None, images: tuple[bytes, ...] = ()) -> dict:
    """The request of either wire format; pictures (PNG or JPEG) come before the text."""
    content: str | list = prompt
    if images:
        kinds = ["image/png" if x[:4] == b"\x89PNG" else "image/jpeg" for x in images]
        spelt = [base64.b64encode(x).decode() for x in images]
        if profile.wire == "messages":
            content = [{"type": "image", "source": {"type": "base64", "media_type": k, "data": d}} for k, d in zip(kinds, spelt, strict=True)]
        else:
            content = [{"type": "image_url", "image_url": {"url": f"data:{k};base64,{d}"}} for k, d in zip(kinds, spelt, strict=True)]
        content.append({"type": "text", "text": prompt})
    if profile.wire == "messages":
        out = {"model": profile.model, "max_tokens": profile.max_output, "temperature": profile.temperature, "messages": [{"role": "user", "content": content}]}
        return out | ({"system": system} if system else {})
    turns = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": content}]
    out = {"model": profile.model, "max_tokens": profile.max_output, "temperature": profile.temperature, "messages": turns}
    return out | ({"response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}} if schema else {})


def answer_of(profile: Profile, reply: dict) -> str:
    """The text of a reply; a cut-off one raises."""
    if profile.wire == "messages":
        text, finish = "".join(p.get("text", "") for p in reply.get("content", [])), reply.get("stop_reason")
    else:
        choice = (reply.get("choices") or [{}])[0]
        text, finish = (choice.get("message") or {}).get("content") or "", choice.get("finish_reason")
    if finish in CUT_OFF:
        raise ProviderError("output_truncated", f"finish reason {finish}")
    return text


def usage_of(reply: dict) -> tuple[int, int]:
    """Tokens of a reply's prompt and answer, by either wire format; 0 where it doesn't say."""
    told = reply.get("usage") or {}
    return int(told.get("prompt_tokens", told.get("input_tokens", 0)) or 0), int(told.get("completion_tokens", told.get("output_tokens", 0)) or 0)


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for: a number or a date; None where it says nothing of use."""
    said = (value or "").strip()
    if re.fullmatch(r"[+-]?\d+(\.\d*)?", said):
        wanted = float(said)
    elif date := email.utils.parsedate_tz(said):
        wanted = email.utils.mktime_tz(date) - now
    else:
        return None
    return max(0.0, wanted)


def delay(attempt: int, base: float, rng: random.Random, most: float = 60.0) -> float:
    """Anything up to a doubling limit, by chance."""
    return rng.random() * min(most, base * 2**attempt)


@dataclass
class Keys:
    """Hands out the key with the fewest calls under way; tired keys rest, refused ones go for good."""

    names: tuple[str, ...]
    busy: dict[str, int] = field(default_factory=dict)
    rest: dict[str, float] = field(default_factory=dict)
    gone: set[str] = field(default_factory=set)
    streak: dict[str, int] = field(default_factory=dict)  # answers in a row that told a key to slow down
    lock: Lock = field(default_factory=Lock)

    def take(self, now: float) -> tuple[str | None, float]:
        """(key, 0), or (None, seconds until one is rested)."""
        with self.lock:
            live = [k for k in self.names if k not in self.gone]
            if not live:
                raise ProviderError("provider_fatal", "every key was refused")
            ready = [k for k in live if self.rest.get(k, 0) <= now]
            if not ready:
                return None, min(self.rest[k] for k in live) - now
            key = min(ready, key=lambda k: self.busy.get(k, 0))
            self.busy[key] = self.busy.get(key, 0) + 1
            return key, 0.0

    def slowed(self, key: str) -> int:
        return self.streak.get(key, 0)

    def give_back(self, key: str, rest_until: float = 0.0, refused: bool = False, slow: bool = False) -> None:
        with self.lock:
            self.streak[key] = self.streak.get(key, 0) + 1 if slow else 0
            self.busy[key] -= 1
            self.rest[key] = max(self.rest.get(key, 0.0), rest_until)
            if refused:
                self.gone.add(key)


@dataclass
class Breaker:
    """Opens after `most` fatal calls in a row."""

    most: int = 20
    streak: int = 0

    def told(self, good: bool) -> None:
        self.streak = 0 if good else self.streak + 1

    @property
    def open(self) -> bool:
        return self.streak >= self.most


def post(url: str, headers: dict[str, str], data: bytes, timeout: float) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, data, headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, dict(reply.headers), reply.read()
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers), error.read()
    except (urllib.error.URLError, TimeoutError) as error:
        return 0, {}, str(error).encode()


class HttpJudge:
    """Answers prompts of a batch at once, as many as the profile allows; an answer or an error for each."""

    def __init__(self, profile: Profile, system: str = "", schema: dict | None = None, send: Callable = post, sleep: Callable = time.sleep, clock: Callable = time.time, breaker: Breaker | None = None, seed: int = 0):
        self.profile, self.system, self.schema = profile, system, schema
        self.send, self.sleep, self.clock = send, sleep, clock
        self.keys, self.breaker, self.rng = Keys(profile.keys), breaker or Breaker(), random.Random(seed)
        self.used = [0, 0, 0]  # calls, tokens of prompts, tokens of answers

    def answer(self, prompts: list[str]) -> list[str | Exception]:
        def safely(prompt: str) -> str | Exception:
            try:
                return self.one(prompt)
            except (ProviderError, ValueError) as error:
                return error

        with ThreadPoolExecutor(self.profile.concurrency) as pool:
            return list(pool.map(safely, prompts))

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector of each text, in one call."""
        got = self._post("/embeddings", {"model": self.profile.model, "input": texts})
        rows = sorted(got["data"], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ProviderError("provider_fatal", f"{len(rows)} vectors for {len(texts)} texts")
        return [r["embedding"] for r in rows]

    def probe(self) -> tuple[bool, float, str]:
        """(whether the service answers, seconds, what it said) of a call for one token."""
        began = self.clock()
        small = replace(self.profile, max_output=1, retries=0)
        judge = HttpJudge(small, send=self.send, sleep=self.sleep, clock=self.clock)
        try:
            said = judge.one("Hi")
        except ProviderError as error:
            return error.kind == "output_truncated", self.clock() - began, str(error)  # cut off is an answer
        return True, self.clock() - began, said

    def one(self, prompt: str) -> str:
        if self.breaker.open:
            raise ProviderError("provider_fatal", "the breaker is open")
        try:
            out = self._tries(prompt)
        except ProviderError as error:
            self.breaker.told(error.kind != "provider_fatal")
            raise
        self.breaker.told(True)
        return out

    def _tries(self, prompt: str) -> str:
        p = self.profile
        reply = self._post("/v1/messages" if p.wire == "messages" else "/chat/completions", body(p, self.system, prompt, self.schema))
        self.used = [a + b for a, b in zip(self.used, (1, *usage_of(reply)), strict=True)]
        return answer_of(p, reply)

    def _post(self, path: str, request: dict) -> dict:
        p, last = self.profile, ""
        waited = 0.0

        def park(seconds: float) -> None:
            nonlocal waited
            waited += seconds
            if waited > p.max_park_s:
                raise ProviderError("provider_retryable_exhausted", f"{seconds:.0f} s more to wait, {p.max_park_s:.0f} s allowed in all; {last}")
            self.sleep(seconds)

        data = json.dumps(request, ensure_ascii=False).encode()
        for attempt in range(p.retries + 1):
            key, wait = self.keys.take(self.clock())
            while key is None:
                park(wait)
                key, wait = self.keys.take(self.clock())
            auth = {"x-api-key": key} if p.wire == "messages" else {"Authorization": f"Bearer {key}"}
            status, headers, content = self.send(p.base_url.rstrip("/") + path, {"Content-Type": "application/json"} | auth, data, p.timeout_s)
            pause = delay(attempt, p.base_delay_s, self.rng)
            asked = retry_after(next((v for k, v in headers.items() if k.lower() == "retry-after"), None), self.clock())
            rest = 0.0
            if status == 429:
                rest = self.clock() + (asked if asked is not None else delay(self.keys.slowed(key), p.base_delay_s, self.rng, LONGEST_REST_S))
            self.keys.give_back(key, rest, status in (401, 403), status == 429)
            text = content.decode("utf-8", "replace")
            if status == 200:
                return json.loads(text)
            if status == 400 and any(w in text.lower() for w in OVERFLOW_WORDS):
                raise ProviderError("context_overflow", text[:200])
            if 400 <= status < 500 and status not in (401, 403, *AGAIN):
                raise ProviderError("provider_fatal", f"{status} {text[:200]}")
            last = f"{status} {text[:200]}"
            if status not in (401, 403, 429) and attempt < p.retries:
                park(asked if asked is not None else pause)
        raise ProviderError("provider_retryable_exhausted", last)
