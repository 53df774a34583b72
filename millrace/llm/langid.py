"""Language identification by string kernels.

Kernel: a text is the set of character n-grams (orders 1 to 4, the blended spectrum) that occur in it, hashed
into BUCKETS cells; k(x, y) = |X and Y| / sqrt(|X| |Y|). Texts are lower-cased and everything that is not a
letter counts as one blank, so that marks, digits and their frequency don't matter.

Training: a hash-ordered sample of the labelled rows of each language, smaller the more languages there are,
but of every language; rows without a letter don't count. LANDMARKS of them, one of each at least, span the
Nyström features k(x, landmarks) K^-1/2; kernel ridge regression on these, one language against the rest,
gives one weight vector for each language. Scoring is two matrix products for a batch of texts: presence
rows by landmark rows, and the normalised result by the weights.

A language's score is its regression value through a softmax; `score` is the winner's.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fold
from millrace.runtime import Written, small_batches

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Bounds of the fit: rows of each language, rows in all, landmarks in all; but LEAST rows and a landmark of each language.
SAMPLE_PER_LANG, SAMPLE_ROWS, LANDMARKS, LEAST = 400, 25_600, 160, 8
#: What `presence` counts as a letter.
LETTER = "\\p{L}"
RIDGE = 1e-2
SHARPNESS = 12.0
UNKNOWN = "und"
_CHUNK = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _letters() -> np.ndarray:
    """[code point] -> itself if a letter, else a blank."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, len(points))
    return np.where(letter, points, np.uint32(32))


_TABLE: np.ndarray | None = None


def presence(text: str, out: np.ndarray) -> int:
    """Set `out`[cell] for each n-gram of `text`; the number of its letters."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    letters = 0
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for at in range(0, len(text), _CHUNK):
        end = at + _CHUNK + max(ORDERS) - 1  # n-grams across the cut are seen
        part = " " * (at == 0) + text[at:end].lower() + " " * (end >= len(text))
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _TABLE[codes]
        letters += int((codes != 32).sum())
        keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]  # runs of blanks are one
        codes = codes[keep].astype(np.uint64)
        rolled = np.zeros(len(codes), np.uint64)
        for order in ORDERS:
            if len(codes) < order:
                break
            rolled = (rolled[: len(codes) - order + 1] * _MIX[0]) + codes[order - 1 :] + np.uint64(order)
            out[((rolled ^ (rolled >> np.uint64(29))) * _MIX[1]) >> shift] = 1
    return letters


def _rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    rows, letters = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            letters[k] = presence(text, rows[k])
    return rows, letters


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    landmarks: np.ndarray  # [landmark, BUCKETS], packed bits
    weights: np.ndarray  # [landmark + 1, language]

    def scores(self, texts: list[str | None], block: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each text (-1: none) and its score."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.langs:
            return best, score
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        norms = np.sqrt(marks.sum(1))
        for at in range(0, len(texts), block):
            rows, letters = _rows(texts[at : at + block])
            size = np.sqrt(np.maximum(rows.sum(1), 1))
            kernel = (rows @ marks.T) / norms / size[:, None]
            value = np.c_[kernel, np.ones(len(kernel))] @ self.weights
            odds = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)))
            odds /= odds.sum(1, keepdims=True)
            top = odds.argmax(1)
            some = letters > 0
            best[at : at + block][some] = top[some]
            score[at : at + block][some] = odds[np.arange(len(top)), top][some]
        return best, score


def sample_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(key, lang, bits): packed presence rows of at most `per_lang` training rows of every language, by hash order of the key.

    The key is the hash of id and text, so that rows without an id differ by their texts; rows that repeat both count
    once. Rows whose lang is null, or whose text is null or has no letter, are left out before the sample is drawn. A
    null id is in the fold of the empty text.
    """
    small_batches(docs.sparkSession)
    trained = (fold(F.col(id_col), 3) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key")
    train = docs.where(trained).select(key, F.col(lang_col).cast("string").alias("_lang"))
    counts = Written(train.groupBy("_lang").agg(F.approx_count_distinct("_key").alias("_n")), "lang-counts")
    per_lang = min(per_lang, max(LEAST, SAMPLE_ROWS // max(1, counts.df.count())))
    place = F.pmod(F.xxhash64("_key"), F.lit(1 << 31))
    near = train.withColumn("_h", place).join(F.broadcast(counts.df), "_lang").where(F.col("_h") * F.col("_n") < float(2 * per_lang + 64) * (1 << 31))
    own = Window.partitionBy("_lang").orderBy("_h", "_key")  # some 2 * per_lang + 64 keys a language are left
    chosen = near.select("_key", "_lang", "_h").distinct().withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= per_lang).select("_key", "_lang")
    chosen = Written(chosen, "lang-sample").df
    counts.drop()
    texts = docs.where(trained).select(key, F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    picked = texts.join(F.broadcast(chosen), ["_key", "_lang"], "left_semi").dropDuplicates(["_key", "_lang"])  # at most SAMPLE_ROWS keys, or LEAST a language

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["_text"]:
                row = np.zeros(BUCKETS, np.uint8)
                out.append(np.packbits(row).tobytes() if text and presence(text, row) else None)
            yield pd.DataFrame({"key": batch["_key"], "lang": batch["_lang"], "bits": out}).dropna(subset=["bits"])

    return picked.mapInPandas(bits, "key long, lang string, bits binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on the bounded sample: SAMPLE_ROWS rows (or LEAST a language) of BUCKETS bits come to the driver, no texts."""
    got = sorted((r["lang"], r["key"], bytes(r["bits"])) for r in sample_rows(docs, id_col, text_col, lang_col, per_lang).collect())
    langs = tuple(sorted({g[0] for g in got}))
    if not langs:
        return Model((), np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((1, 0)))
    packed = np.frombuffer(b"".join(g[2] for g in got), np.uint8).reshape(len(got), -1)
    index = {name: k for k, name in enumerate(langs)}
    own = np.array([index[g[0]] for g in got])
    each = max(1, LANDMARKS // len(langs))
    marked = np.concatenate([np.flatnonzero(own == k)[:each] for k in range(len(langs))])
    marks = np.unpackbits(packed[marked], axis=1).astype(np.float32)
    norms = np.sqrt(marks.sum(1))
    within = (marks @ marks.T) / norms / norms[:, None]
    value, vector = np.linalg.eigh(within.astype(float))
    kept = value > 1e-8 * value.max()
    root = vector[:, kept] / np.sqrt(value[kept])  # Nyström: features = kernel @ root
    balance = len(own) / len(langs) / np.maximum(np.bincount(own, minlength=len(langs)), 1)
    left, right = np.zeros((root.shape[1] + 1,) * 2), np.zeros((root.shape[1] + 1, len(langs)))
    for at in range(0, len(got), 256):
        rows = np.unpackbits(packed[at : at + 256], axis=1).astype(np.float32)
        kernel = (rows @ marks.T) / norms / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
        features = np.c_[kernel @ root, np.ones(len(rows))]
        mine = own[at : at + 256]
        weighed = (balance[mine][:, None] * features).T
        left += weighed @ features
        right += weighed @ np.where(mine[:, None] == np.arange(len(langs)), 1.0, -1.0)
    penalty = RIDGE * len(own) / len(marks) * np.eye(len(left))
    penalty[-1, -1] = 1e-6
    solved = np.linalg.solve(left + penalty, right)
    return Model(langs, packed[marked], np.vstack([root @ solved[:-1], solved[-1:]]))


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of a text; `und` with score 0 if it is null or has no letter."""

    @F.pandas_udf(T.StructType().add("lang_pred", "string").add("score", "double"))
    def best(texts: pd.Series) -> pd.DataFrame:
        top, score = model.scores(texts.tolist())
        names = np.array([*model.langs, UNKNOWN], object)
        return pd.DataFrame({"lang_pred": names[top], "score": score})

    return best.asNondeterministic()(text)  # else a filter on the result has it computed twice


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    Null, empty and letterless texts are `und` with score 0, as is every text when no row is labelled.
    Ties go to the language that sorts first. Repeated rows are judged each for itself; texts of any length
    are read whole.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col), (fold(F.col(id_col), 3) == 1).alias("held_out"), predict(F.col(text_col), model).alias("_p"))
    return out.select(id_col, "held_out", "_p.lang_pred", "_p.score")
