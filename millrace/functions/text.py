"""Column functions on texts, keys and budgets."""

from __future__ import annotations

import json

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code point ranges that count one token a character.
CJK_RANGES = (
    (0x3000, 0x303F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6),
    (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF),
    (0x2EBF0, 0x2EE5F), (0x30000, 0x3134F), (0x31350, 0x323AF),
)
#: Fixed values of the token budget.
MARGIN_FLOOR, MARGIN_RATIO, ASCII_PER_TOKEN, OTHER_PER_TOKEN = 256, 0.10, 3.0, 2.0
PATCH_PX, PATCH_CAP, FIT_PX, SHORT_PX, TILE_PX, TILE_BASE, TILE_TOKENS = 28, 1568, 2048, 768, 512, 85, 170
#: What counts as white space in texts to compare.
OTHER_SPACE = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: White space that isn't a single blank already; most characters are told from it by one range.
UNEVEN_SPACE = f"(?![!-~])(?:[{OTHER_SPACE}][ {OTHER_SPACE}]*| [ {OTHER_SPACE}]+)"
#: What NFC may change or put together with its neighbours; all that is below U+0300 is in NFC, whatever its order.
COMPOSABLE = "[^\\x00-\\u02FF]"


def record_id(raw_json: Column) -> Column:
    """First 16 hex digits of the sha256 of a record's canonical JSON."""
    return F.substring(F.sha2(raw_json, 256), 1, 16)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized(text: Column) -> Column:
    """NFC, runs of Unicode white space as one blank, no blanks around. Only texts that NFC may change are sent to Python."""
    sent = text.rlike(COMPOSABLE)
    composed = F.when(sent, nfc(F.when(sent, text))).otherwise(text)
    return F.trim(F.regexp_replace(composed, UNEVEN_SPACE, " "))


def sequence_text(members: Column) -> Column:
    """The text by which sequences are compared: their members' normalised texts with U+001E between them."""
    return F.array_join(F.transform(members, lambda t: F.coalesce(t, F.lit(""))), "\u001e")


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a text of n characters or fewer is its only one, an empty text has none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(grams))


def token_estimate(text: Column) -> Column:
    """ceil(ascii / 3 + cjk + other / 2) over the characters of a text."""
    cjk = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
    size = F.length(text)
    wide = size - F.length(F.regexp_replace(text, cjk, ""))
    plain = size - F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return F.ceil(plain / ASCII_PER_TOKEN + wide + (size - wide - plain) / OTHER_PER_TOKEN)


def margin(window: Column) -> Column:
    return F.greatest(F.lit(MARGIN_FLOOR), F.ceil(window * MARGIN_RATIO))


def input_budget(window: Column, max_output: Column) -> Column:
    """Tokens left for the prompt; 0 where no window is declared."""
    return F.when(window <= 0, F.lit(0)).otherwise(window - max_output - margin(window))


def embed_budget(window: Column) -> Column:
    return F.when(window <= 0, F.lit(0)).otherwise(window - margin(window))


def image_prior(provider: Column, px: Column) -> Column:
    """Tokens of an image of that long edge, worst aspect ratio: patches for one wire format, tiles for the other."""
    patches = F.least(F.pow(F.ceil(px / PATCH_PX), F.lit(2)).cast("long"), F.lit(PATCH_CAP))
    edge = F.least(px, F.lit(FIT_PX))
    tiles = F.ceil(F.least(F.lit(SHORT_PX), edge) / TILE_PX) * F.ceil(edge / TILE_PX)
    return F.when(provider == "patch", patches).otherwise(TILE_BASE + TILE_TOKENS * tiles)


def order_key(value: Column) -> Column:
    """Epoch seconds of a JSON scalar given as text; null if it is no timestamp.

    Below 1e11 a number is seconds, below 1e14 milliseconds; negative, larger and NaN ones are rejected, as
    are `true` and `false`. Other strings are read as ISO-8601, without a zone as UTC.
    """
    number = value.try_cast("double")
    scaled = F.when(F.isnan(number) | (number < 0) | (number >= 1e14), None).when(number < 1e11, number).otherwise(number / 1000.0)
    iso = F.unix_micros(value.try_cast("timestamp")) / 1e6
    return F.when(number.isNotNull(), scaled).when(value.rlike("^\\s*\\d{4}-\\d{2}-\\d{2}([T ].*)?$"), iso)


def bounds(value: Column) -> Column:
    """[l, t, r, b] of `[l,t][r,b]`, else four zeros."""
    found = F.regexp_extract_all(value, F.lit("-?\\d+"), F.lit(0))
    shape = value.rlike("^\\s*\\[\\s*-?\\d+\\s*,\\s*-?\\d+\\s*\\]\\s*\\[\\s*-?\\d+\\s*,\\s*-?\\d+\\s*\\]\\s*$")
    return F.when(shape, found.cast("array<int>")).otherwise(F.array(*[F.lit(0)] * 4))


def visible(value: Column) -> Column:
    """False for `false`, `0`, `no` and the empty string, in any case and with blanks around; null is visible."""
    return ~F.coalesce(F.lower(F.trim(value)).isin("false", "0", "no", ""), F.lit(False))


def keyframes(n: Column, k: int) -> Column:
    """Positions of at most k frames out of n, the first and the last among them."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(spread)


def fragment_keyframes(lens: Column, k: int) -> Column:
    """Positions of at most k frames of a thread of fragments of these lengths, each fragment with one at least.

    What k leaves beyond one frame a fragment is shared by length less one, whole parts first, then by the largest
    rest, earlier fragments first. A fragment spreads its own evenly; one alone is its first, in the last fragment
    its last. With more fragments than k frames, or one fragment, the frames are spread over the whole.
    """
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda s, x: s + x.cast("int"))

    def quotas(n: Column) -> Column:
        m = F.size(lens)
        spare, weight = F.lit(k) - m, n - m
        share = F.transform(lens, lambda x, i: F.struct((-((x - 1) * spare % weight)).alias("rest"), i.alias("i"), F.floor((x - 1) * spare / weight).cast("int").alias("whole")))
        left = spare - F.aggregate(share, F.lit(0), lambda s, x: s + x["whole"])
        lucky = F.transform(F.slice(F.array_sort(share), 1, F.greatest(left, F.lit(0))), lambda x: x["i"])
        return F.transform(share, lambda x: F.struct(x["i"], (x["whole"] + 1 + F.array_contains(lucky, x["i"]).cast("int")).alias("q")))

    def picks(n: Column) -> Column:
        def own(x: Column) -> Column:
            size = F.get(lens, x["i"])
            start = total(F.slice(lens, F.lit(1), x["i"]))
            alone = F.array(F.when(x["i"] == F.size(lens) - 1, size - 1).otherwise(F.lit(0)))
            many = F.transform(F.sequence(F.lit(0), x["q"] - 1), lambda j: F.floor(j * (size - 1) / F.greatest(x["q"] - 1, F.lit(1))).cast("int"))
            return F.transform(F.when(x["q"] == 1, alone).otherwise(many), lambda p: p + start)

        return F.flatten(F.transform(quotas(n), own))

    n = total(lens)
    return F.when((n <= k) | (F.size(lens) <= 1) | (F.size(lens) > k), keyframes(n, k)).otherwise(picks(n))


def lookup(raw: Column, dotted: str) -> Column:
    """struct(state, value) of a dotted path in a JSON text: missing, null or there, and the value as JSON."""
    path = "$" + "".join(f".{p}" for p in dotted.split("."))
    found = F.try_variant_get(F.try_parse_json(raw), path, "variant")
    state = F.when(found.isNull(), "missing").when(F.is_variant_null(found), "null").otherwise("there")
    return F.struct(state.alias("state"), F.when(state == "there", F.to_json(found)).alias("value"))


def passed_through(raw: Column, fields: list[str]) -> Column:
    """JSON object of the given top-level fields that a JSON text has, with their own values; a null value is there.

    A name is a name, whatever is in it: dots part nothing here.
    """
    parsed = F.try_parse_json(raw)

    def place(name: str) -> str:
        mark = "'" if "'" not in name else '"'
        return f"$[{mark}{name}{mark}]"

    own = [F.concat(F.lit(f"{json.dumps(f, ensure_ascii=False)}:"), F.to_json(F.try_variant_get(parsed, place(f), "variant"))) for f in dict.fromkeys(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *own) if own else F.lit(""), F.lit("}"))
