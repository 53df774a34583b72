import json
import random

import pytest

from millrace import provider as P

PROFILE = P.Profile("p", "http://x/", "m", ("k1", "k2"), retries=3)


def judge(replies, **more):
    seen, slept, clock = [], [], [0.0]

    def send(url, headers, data, timeout):
        seen.append((url, headers.get("Authorization"), json.loads(data)))
        return replies.pop(0)

    def sleep(s):
        slept.append(s)
        clock[0] += s

    return P.HttpJudge(PROFILE, send=send, sleep=sleep, clock=lambda: clock[0], **more), seen, slept


def ok(text, finish="stop"):
    return 200, {}, json.dumps({"choices": [{"message": {"content": text}, "finish_reason": finish}]}).encode()


def test_retries_then_answers():
    j, seen, slept = judge([(500, {}, b""), (429, {"Retry-After": "7"}, b""), ok("yes")])
    assert j.one("q") == "yes" and len(seen) == 3 and seen[0][0] == "http://x/chat/completions"
    assert seen[2][1] != seen[1][1] and 0.5 <= slept[0] <= 1  # the tired key rests, the other goes on


def test_refused_keys_go_for_good():
    j, _, _ = judge([(401, {}, b""), (403, {}, b"")])
    with pytest.raises(P.ProviderError) as e:
        j.one("q")
    assert e.value.kind == "provider_fatal" and j.keys.gone == {"k1", "k2"}


@pytest.mark.parametrize(("reply", "kind"), [((400, {}, b"maximum context length"), "context_overflow"), ((404, {}, b""), "provider_fatal"), (ok("x", "length"), "output_truncated")])
def test_kinds(reply, kind):
    with pytest.raises(P.ProviderError) as e:
        judge([reply])[0].one("q")
    assert e.value.kind == kind


def test_exhausted_and_breaker():
    j, _, _ = judge([(503, {}, b"")] * 4, breaker=P.Breaker(1))
    with pytest.raises(P.ProviderError, match="exhausted"):
        j.one("q")
    j.breaker.told(False)
    with pytest.raises(P.ProviderError, match="breaker"):
        j.one("q")


def test_retry_after_and_delay():
    assert P.retry_after("3", 0) == 3 and P.retry_after("x", 0) is None and P.retry_after(None, 0) is None
    assert P.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", 4) == 6
    assert all(b / 2 <= P.delay(k, 1, random.Random(0)) <= b for k, b in ((0, 1), (3, 8), (10, 60)))


def test_bodies():
    assert P.body(PROFILE, "s", "u", {"type": "object"})["response_format"]["json_schema"]["schema"] == {"type": "object"}
    other = P.Profile("p", "http://x", "m", ("k",), wire="messages")
    assert P.body(other, "s", "u")["system"] == "s"
    assert P.answer_of(other, {"content": [{"text": "a"}, {"text": "b"}], "stop_reason": "end_turn"}) == "ab"


def test_one_failure_leaves_the_others():
    j, _, _ = judge([(404, {}, b""), (404, {}, b"")])
    assert all(isinstance(a, P.ProviderError) for a in j.answer(["a", "b"])) and j.answer([]) == []


def test_no_call_is_parked_beyond_its_limit():
    slept = []
    profile = P.Profile("p", "http://x", "m", ("k",), retries=5, max_park_s=100)
    own = P.HttpJudge(profile, send=lambda *a: (503, {"Retry-After": "86400"}, b"busy"), sleep=slept.append, clock=lambda: 0.0)
    (error,) = own.answer(["q"])
    assert error.kind == "provider_retryable_exhausted" and sum(slept) <= 100
    own = P.HttpJudge(profile, send=lambda *a: (429, {"Retry-After": "86400"}, b"slow"), sleep=slept.append, clock=lambda: 0.0)
    assert own.answer(["q"])[0].kind == "provider_retryable_exhausted" and sum(slept) <= 100
