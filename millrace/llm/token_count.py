"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Offline, every vocabulary string is run through the merges once: those that come out as a single token
form the whole-token set. A text is cut into pre-tokens; each pre-token in the set counts 1 without any
merge, and only the rest is merged. Counts of stretches between spaces are kept in a bounded table, as
natural text repeats them.

Cutting is exact: where a single space or line break stands between two other characters, the pattern
of this family of vocabularies always begins a new pre-token there (a space belongs to the word after it,
a line break stands alone). Texts with other white space go through the library's own splitter.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BYTE_ALPHABET as _BYTES
from millrace.llm.common import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Entries of the tables of counted stretches and of merged pre-tokens, per Python worker.
TABLE_ENTRIES = 250_000
#: Longer stretches aren't kept.
KEPT_CHARS = 48
#: A word of Latin letters with ASCII marks after it: two pre-tokens at most, no library call needed.
_PLAIN = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!#-&(-/:-@\[-`{-~]*)")
_IRREGULAR = re.compile(r"[^\S \n]|\s\s|\s\Z|\A\n|[\x1c-\x1f\x85]")


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = False
        self.tok, self.model, self.split = tok, tok.model, tok.pre_tokenizer.pre_tokenize_str
        self.special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        self.whole = whole_tokens(path)
        self.merged: dict[str, int] = {}
        self.after_space, self.heads = Table(self.stretch, " "), Table(self.stretch, "")

    def pretoken(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        n = self.merged.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece))
            if len(piece) <= KEPT_CHARS:
                if len(self.merged) >= TABLE_ENTRIES:
                    self.merged.clear()
                self.merged[piece] = n
        return n

    def stretch(self, text: str) -> int:
        if plain := _PLAIN.fullmatch(text):
            word, marks = plain.groups()
            word = word.replace(" ", _BYTES[32]) if word.isascii() else "".join(map(_BYTES.__getitem__, word.encode()))
            return self.pretoken(word) + (self.pretoken(marks) if marks else 0)
        return sum(self.pretoken(p) for p, _ in self.split(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):  # the library finds its special strings before it splits
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if _IRREGULAR.search(text):
            return self.stretch(text)
        lines = text.split("\n")
        words = [w for line in lines for w in line.split(" ")[1:]]
        heads = [line.partition(" ")[0] for line in lines]
        return len(lines) - 1 + sum(map(self.after_space.__getitem__, words)) + sum(map(self.heads.__getitem__, heads))


class Table(dict):
    """Counts of stretches, each with `prefix` before it; bounded, emptied when full."""

    def __init__(self, count, prefix: str):
        self.count, self.prefix = count, prefix

    def __missing__(self, key: str) -> int:
        n = self.count(self.prefix + key) if key or self.prefix else 0
        if len(key) <= KEPT_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[key] = n
        return n


@lru_cache(2)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings (in the byte alphabet of the file) that encode alone as one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return frozenset(v for v in tok.get_vocab(with_added_tokens=False) if len(tok.model.tokenize(v)) == 1)


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text as the library gives them, without added ones; null counts as empty."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = _counter(path)
        return pd.Series(np.array([own.count(t) if t is not None else 0 for t in texts], np.int64))

    return count(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each for itself. Texts of
    any length are counted whole. Special strings inside a text are taken as the library's default does.
    """
    text = F.col(text_col)
    out = docs.select(
        F.col(id_col),
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        token_count(text, path or tokenizer_path(VOCABULARY)).alias("n_tokens"),
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
