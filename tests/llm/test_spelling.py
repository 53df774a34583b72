"""Spelling variants against all pairs, the SQL, hot bigrams, odd inputs."""

import random
import zlib

import numpy as np
import pytest
from compare import agree
from pyspark.sql import functions as F

from millrace.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Brute force: every one-edit change of the shorter word's side, by its definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts):
    """All pairs; (word, form, root, n, n_near, form_n)."""
    form, n_near = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w], n_near[w] = best if best and counts[best] >= 2 * n else None, len(close)
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return out


def test_near_by_definition():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    words = sorted(set(words) | {"a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 149})
    for a in words:
        for b in words:
            assert spelling.is_near(a, b) == near(a, b), (a, b)


@pytest.mark.parametrize("wide", [False, True])
def test_pairs_of_a_run(wide, monkeypatch):
    monkeypatch.setattr(spelling, "WIDE", 3 if wide else 200)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(5)) for _ in range(40)})
    side = np.zeros(len(words), int)
    got = {(words[i], words[j]) for a, b in spelling.near_in_runs(words, np.zeros(len(words), int), side) for i, j in zip(a, b, strict=True)}
    assert got == {(v, w) for i, v in enumerate(words) for w in words[i + 1 :] if near(v, w)}
    both = words[:20] + [w + "a" for w in words[:20]]
    sides = np.array([1] * 20 + [2] * 20)
    got = {(both[i], both[j]) for a, b in spelling.near_in_runs(both, np.zeros(40, int), sides) for i, j in zip(a, b, strict=True)}
    assert got == {(v, w) for v in both[:20] for w in both[20:] if near(v, w)}


@pytest.mark.parametrize("meeting", [128, 2])
def test_against_all_pairs(spark, meeting):
    """With meetings of two words, nearly all are dealt by halves, down to one character."""
    rng = random.Random(5)
    parts = ["the", "er", "ing", "tion", "ab", "é", "ers"]
    counts = {"".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))): rng.randrange(3, 90) for _ in range(150)}
    for w in list(counts):
        k = rng.randrange(len(w))
        counts.setdefault(rng.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "x" + w[k + 1 :]]), rng.randrange(3, 12))
    counts = {w: n for w, n in counts.items() if len(w) >= 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n int").select(F.explode(F.array_repeat("word", F.col("n"))).alias("word"))
    got = [tuple(r) for r in spelling.spelling_variants(words, meeting=meeting).collect()]
    assert len(got) == len(counts) and set(got) == variants(counts)


def test_one_bigram_that_all_words_share(spark):
    """A hot meeting: the only rare bigrams are the same in a thousand words."""
    words = [f"zq{a}{b}{c}zq" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    df = spark.createDataFrame([(w,) for w in words for _ in range(3)], "word string")
    got = {r["word"]: r for r in spelling.spelling_variants(df, meeting=16).collect()}
    assert len(got) == 1000 and all(r["n_near"] == 27 and r["form"] is None and r["root"] == w for w, r in got.items())


def test_chains_of_forms(spark):
    counts = {"wordaaaaa": 3, "wordaaaab": 6, "wordaaabb": 12, "wordaabbb": 24, "wordabbbb": 48, "aaaaa": 3, "zzzzz": 5}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    assert {tuple(r) for r in spelling.spelling_variants(words).collect()} == variants(counts)


def test_words_and_slips(spark):
    texts = [(1, "Straße STRASSE ÀB don't x2y"), (2, None), (3, ""), (None, "Null null"), (4, "a" * 30_000 + " " + "b " * 9)]
    got = spelling.words_of(spark.createDataFrame(texts, "doc_id long, text string").withColumn("_run", F.lit(1)), one_in=3).collect()
    want = []
    for key, runs in ((1, ["straße", "strasse", "Àb", "don", "t", "x", "y"]), ("", ["null", "null"]), (4, ["a" * 30_000] + ["b"] * 9)):
        for w in runs:
            h = zlib.crc32(f"{key}:{w}".encode())
            want.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w)
    assert sorted(r["word"] for r in got) == sorted(want)


def test_nothing_and_repeats(spark):
    empty = spark.createDataFrame([], "word string")
    assert spelling.spelling_variants(empty).collect() == []
    odd = spark.createDataFrame([(None,), ("abcd",), ("abcde",)] * 3, "word string")
    assert [tuple(r) for r in spelling.spelling_variants(odd).collect()] == [("abcde", None, "abcde", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, min_length=3)


def test_query(spark):
    agree(spark, SF, queries.QUERIES["op11_spelling_variants"], queries.ORACLES["op11_spelling_variants"])
