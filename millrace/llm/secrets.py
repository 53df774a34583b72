"""Secret scan in DataFrame functions only: fixed patterns, and character Markov models for the rest.

Two first-order Markov chains over the alphabet below are trained by grouped counts on labelled samples:
random strings (hexadecimal, base64 and letter-digit forms of digests) and ordinary identifiers (common
words joined as snake, camel, kebab and dotted names). A long token outside the patterns' spans is a secret
if the log-likelihood ratio of the chains, summed over its transitions, and its mean are large enough. The
trained table is one literal of fixed size; the scan is a projection over the texts and shuffles nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # 16 characters or more; a shorter run holds no longer match
HEX = "[0-9a-f]{32,}"  # a run this long starts where its first match does
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Tokens that the chains judge: whole runs of the alphabet, with letters and digits, of this length or more.
#: FILL stands for the characters of assignments, next to which no token is judged; so too where a text holds it itself.
FILL = "\ufdd0"
TOKEN = rf"(?<![A-Za-z0-9+/_{FILL}-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{20,}}+(?!{FILL})"
MIN_TOTAL, MIN_MEAN = 14.0, 0.45
#: Added to each transition's count in either chain.
SMOOTHING = 1.0
SAMPLES = 3000
MASK = "[SECRET]"
#: Entries of an array that grows by appending, characters of a text that are masked together.
CHUNK, PART = 256, 8192
#: Parts of the identifier sample.
NAMES = (
    "user account session cache index value count total request response server client config default handler "
    "manager factory builder parser reader writer stream buffer queue thread worker event listener message channel "
    "table column record field schema query result cursor update delete insert select filter group order limit "
    "network address socket packet header payload version release build test case module package import export "
    "function method class object string number boolean integer list array matrix vector graph node edge path file "
    "directory folder image video audio document page article section chapter language english german french spanish "
    "straße zeitung rechnung benutzer nachricht ergebnis adresse utilisateur résultat fichier recherche bonjour "
    "usuario archivo resultado mensaje pregunta respuesta annual report summary research january february"
)


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(random, token): n labelled strings of either kind, made by rule from a counter.

    No table is read; the rows are the same in every run, none is null or empty, a few repeat.
    """
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    forms = F.array(digest, F.substring(digest, 1, 40), coded, F.translate(coded, "+/", "-_"), F.regexp_replace(coded, "[+/]", ""), F.upper(F.regexp_replace(coded, "[+/]", "")))
    random = rows.select(F.lit(1).alias("random"), F.get(forms, (F.col("id") % 6).cast("int")).alias("token"))
    words = F.split(F.lit(" ".join(w for w in NAMES.split() if w.isascii())), " ")
    pick = [F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)).cast("int")) for k in range(4)]
    number = F.when(F.col("id") % 4 < 2, (F.col("id") % 2100).cast("string")).otherwise("")
    names = F.array(
        F.concat_ws("_", *pick, number),
        F.concat(pick[0], F.initcap(pick[1]), F.initcap(pick[2]), F.initcap(pick[3]), number),
        F.concat_ws("-", *pick, number),
        F.concat_ws("/", *pick, number),
        F.concat(*pick, number),
        F.upper(F.concat_ws("_", *pick[:3], number)),
    )
    plain = rows.select(F.lit(0).alias("random"), F.get(names, (F.col("id") % 6).cast("int")).alias("token"))
    return random.union(plain)


def train(spark: SparkSession, smoothing: float = SMOOTHING) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary), row by row over ALPHABET.

    Transitions that no sample has count SMOOTHING; characters outside ALPHABET count in neither chain.
    """
    pairs = samples(spark).select("random", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("pair"))
    k = len(ALPHABET)
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # 2 k^2 rows at most
    table = []
    for a in ALPHABET:
        total = [sum(counts.get((c, a + b), 0) for b in ALPHABET) + smoothing * k for c in (0, 1)]
        table += [math.log((counts.get((1, a + b), 0) + smoothing) / total[1]) - math.log((counts.get((0, a + b), 0) + smoothing) / total[0]) for b in ALPHABET]
    return table


@lru_cache(4)
def _trained(spark: SparkSession) -> tuple[float, ...]:
    return tuple(train(spark))


def log_ratio(token: Column, table: tuple[float, ...]) -> Column:
    """Sum of the table over a token's transitions; characters outside ALPHABET count 0."""
    literal = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    k = len(ALPHABET)
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, ch: Column) -> Column:
        at = F.expr("1") * F.instr(F.lit(ALPHABET), ch)
        gain = F.when((acc["last"] > 0) & (at > 0), F.get(literal, (acc["last"] - 1) * k + at - 1)).otherwise(0.0)
        return F.struct(at.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, add: Callable[[Column, Column], Column], start: int) -> Column:
    """array<int> of the running results of `add` (a sum, a maximum), from `start` on.

    Appending copies an array; so each chunk of CHUNK values grows an array of its own, and one more holds the
    chunks' results. The work is then linear but for that last array of one entry in CHUNK.
    """

    def last(xs: Column) -> Column:
        return F.coalesce(F.get(xs, F.size(xs) - 1), F.lit(start))

    def chunks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))

    def joined(own: Column) -> Column:
        before = F.aggregate(own, F.array(F.lit(start)), lambda acc, c: F.array_append(acc, add(last(acc), last(c))))
        pairs = F.slice(F.arrays_zip(own.alias("own"), before.alias("before")), F.lit(1), F.size(own))
        return F.flatten(F.transform(pairs, lambda z: F.transform(z["own"], lambda x: add(z["before"], x))))

    within = F.transform(_let(values, chunks), lambda c: F.aggregate(c, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, add(last(acc), x))))
    return _let(within, joined)


_SPAN = "struct<start:int,kind:int,end:int,token:string>"


def _cut(text: Column, pattern: str, value_group: int) -> Column:
    """array<struct(b, m, v)>: what stands before each match, the match, its value; the rest of the text comes last, without a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else F.transform(whole, lambda m: m)
    return F.arrays_zip(F.split(text, pattern, -1).alias("b"), whole.alias("m"), value.alias("v"))


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """array<struct(start, kind, end, token)> of a pattern's matches, leftmost and apart, in code points."""

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b, 0)
        each = F.zip_with(parts, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("token"), x["v"].alias("v")))
        good = F.filter(each, lambda s: s["token"].isNotNull() & (F.length(s["v"]) >= least))
        return F.transform(good, lambda s: F.struct(s["start"], s["kind"], s["end"], s["token"]).cast(_SPAN))

    return F.when(text.rlike(pattern), _let(_cut(text, pattern, value_group), placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def filled(text: Column, pattern: str, value_group: int, least: int) -> Column:
    """`text` with FILL for each character of a match; its length stays."""
    parts = F.transform(_cut(text, pattern, value_group), lambda x: F.concat(x["b"], F.when(F.length(x["v"]) >= least, F.repeat(F.lit(FILL), F.length(x["m"]))).otherwise(F.coalesce(x["m"], F.lit("")))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "_spans", min_total: float = MIN_TOTAL, min_mean: float = MIN_MEAN) -> DataFrame:
    """`docs` with `out`: struct(base, added), either ordered by start, then kind.

    Added are tokens apart from all base spans. Whether one meets an assignment is seen on the text with the
    assignments filled; the other base patterns match inside a token's run of characters or not at all.
    """
    table = _trained(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(spans(text, ASSIGN, 0, 2, ASSIGN_VALUE), spans(text, ACCESS, 1), spans(text, HEX, 2))
    maybe = _let(filled(text, ASSIGN, 2, ASSIGN_VALUE), lambda t: spans(t, TOKEN, 3))

    def secret(s: Column) -> Column:
        apart = ~s["token"].rlike(ACCESS) & ~s["token"].rlike(HEX)
        return apart & _let(log_ratio(s["token"], table), lambda total: (total >= min_total) & (total >= min_mean * (s["end"] - s["start"] - 1)))

    return docs.withColumn(out, F.struct(F.array_sort(base).alias("base"), F.filter(maybe, secret).alias("added")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    A null text counts as empty: no spans, the digest of nothing. Spans of one start come in the order of
    KINDS. Repeated rows are scanned each for itself, texts of any length whole; other columns are not read.
    """
    found = with_spans(docs.select(F.col(id_col), F.col(text_col)), text_col, "_spans", **limits)
    base, added = F.col("_spans.base"), F.col("_spans.added")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat(base, added))).alias("spans"),
    )


def _apart(found: Column) -> Column:
    """array<struct(start, end)> of the stretches that ordered spans cover; spans that meet but don't overlap stay apart."""

    def stretches(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda s: s["end"]), F.greatest, 0)
        return _let(reach, lambda hi: F.arrays_zip(
            F.filter(F.transform(xs, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(hi, i - 1)), s["start"])), lambda x: x.isNotNull()).alias("start"),
            F.filter(F.transform(hi, lambda h, i: F.when((i == F.size(hi) - 1) | (F.get(xs, i + 1)["start"] >= h), h)), lambda x: x.isNotNull()).alias("end"),
        ))

    return _let(found, stretches)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span in the text replaced by MASK, overlapping spans by one; null texts stay null.

    The text is taken in parts of PART characters, each with the stretches that meet it; the work grows with parts and stretches.
    """
    found = with_spans(docs, text_col, "_spans")
    text = F.col(text_col).cast("string")

    def parts_of(cuts: Column, firsts: Column, pasts: Column) -> Column:
        def masked(part: Column, k: Column) -> Column:
            lo, hi = k * PART, k * PART + F.length(part)

            def pieces(own: Column) -> Column:
                def piece(s: Column, i: Column) -> Column:
                    before = F.coalesce(F.get(own, i - 1)["end"], lo)
                    return F.concat(F.substring(part, before - lo + 1, F.greatest(s["start"] - before, F.lit(0))), F.when(s["start"] >= lo, F.lit(MASK)).otherwise(""))

                rest = F.coalesce(F.get(own, F.size(own) - 1)["end"], lo)
                return F.concat(F.array_join(F.transform(own, piece), ""), F.substring(part, rest - lo + 1, F.length(part)))

            first, past = F.coalesce(F.get(firsts, k), F.size(cuts)), F.coalesce(F.get(pasts, k), F.size(cuts))
            return _let(F.slice(cuts, first + 1, past - first), pieces)

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), masked), "")

    def part_of(cuts: Column) -> Column:
        # for each part the first stretch that ends in it or later, and the first that starts after it: one walk over the stretches
        def steps(place, least: int) -> Column:
            return F.flatten(F.transform(cuts, lambda s, i: F.array_repeat(i, place(s) - F.coalesce(place(F.get(cuts, i - 1)), F.lit(least)))))

        ends = steps(lambda s: F.floor((s["end"] - 1) / PART).cast("int"), -1)
        starts = steps(lambda s: F.floor(s["start"] / PART).cast("int"), 0)
        return _let(ends, lambda firsts: _let(starts, lambda pasts: parts_of(cuts, firsts, pasts)))

    changed = (F.size("_spans.base") + F.size("_spans.added")) > 0
    walked = _let(_apart(F.array_sort(F.concat("_spans.base", "_spans.added"))), part_of)
    return found.withColumn(text_col, F.when(changed, walked).otherwise(F.col(text_col))).drop("_spans")
