"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than this share of all rows, and so many at least; it is then dealt to SALTS tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 1000, 2000, 64


def tokenizer_path(name: str) -> str:
    """Where the file `name` of the public tokenizers lies; the files are never copied."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """Keys with more than HOT_SHARE of `total` rows: fewer than 1 / HOT_SHARE, whatever the data."""
    least = max(int(total * HOT_SHARE), HOT_ROWS)
    return [r[key] for r in counts.where(F.col(n) > least).select(key).collect()] if total > least else []


def hot_join(rows: DataFrame, one: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join of `rows` with `one`, which has one row for each key; rows of hot keys are dealt to SALTS tasks."""
    if not hot:
        return rows.join(one, key)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def hash_first(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """Some `n` of `total` distinct rows, those whose key's hash comes first; of so many only about 2 n leave the tasks."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    near = rows.where(place < int(min(1.0, (2 * n + 64) / max(total, 1)) * (1 << 31)))
    return near.distinct().orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 31)), *rows.columns).limit(n)


#: The alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest for characters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_REST = [b for b in range(256) if b not in _PRINTABLE]
BYTE_ALPHABET = [chr(b) if b in _PRINTABLE else chr(256 + _REST.index(b)) for b in range(256)]
