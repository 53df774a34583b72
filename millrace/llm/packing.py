"""Packing of documents into fixed-length token sequences by cutting-stock column generation.

1. Each document becomes its token ids and the closing id, cut into pieces of SEQUENCE ids and a rest.
   Every id lies in exactly one piece.
2. Piece lengths are counted on a grid of GRID ids (a bounded histogram: SEQUENCE / GRID bins).
3. A linear program chooses patterns (how many pieces of each bin share one sequence). Its columns are
   priced by an unbounded knapsack over the grid, until no pattern improves it.
4. Pattern counts are rounded down; what they leave (bounded by the number of patterns, not of rows) is
   packed first-fit decreasing on the histogram.
5. Pieces are ranked inside their bin, in buckets so that no bin is ranked in one task, and the r-th piece
   of a bin takes the r-th slot that the patterns have for it.

The driver sees the histogram and the patterns only, both bounded by the grid. The pieces go once through
a written table; token ids are made once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BYTE_ALPHABET as _BYTES
from millrace.llm.common import tokenizer_path
from millrace.runtime import Written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEQUENCE = 4096
GRID = 16
#: Pieces of one bin that are ranked in one task.
BUCKET_ROWS = 1024
#: Entries of the table of encoded stretches, per Python worker, and the longest that is kept.
TABLE_ENTRIES, KEPT_BYTES = 250_000, 48
#: Letters whose composition and lower case need no table, and ASCII marks but for the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!#-&(-/:-@\[-`{-~]*)")


class Encoder(dict):
    """UTF-8 text -> ids as little-endian unsigned 32-bit numbers.

    This vocabulary's splitter drops white space and never joins across it, so that the stretches between
    white space are encoded one by one; those seen before come from a bounded table.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]

    def __missing__(self, stretch: bytes) -> bytes:
        text = stretch.decode()
        if plain := _PLAIN.fullmatch(text):  # its letters, lower-cased, are one pre-token, its marks another
            word, marks = plain.groups()
            if marks and word:
                ids = self[word.encode()] + self[marks.encode()]
            else:
                spelt = "".join(map(_BYTES.__getitem__, text.lower().encode()))
                ids = np.array([t.id for t in self.merge(spelt)], "<u4").tobytes()
        else:
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(stretch) <= KEPT_BYTES:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids binary, doc_tokens) of every piece; null text counts as empty.

    `ids` holds little-endian unsigned 32-bit ids. A text without tokens gives one piece: the closing id.
    """
    path = path or tokenizer_path(VOCABULARY)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * sequence

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for batch in batches:
            rows, start, length, ids, total = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                data = own.encode(text.as_py() or b"") + end
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
                    total.append(len(data) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                [id_col, "start", "length", "ids", "doc_tokens"],
            )

    schema = T.StructType([docs.schema[id_col]]).add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_t")).mapInArrow(pieces, schema)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (a count for each size) of the highest value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, c, "right"))  # sizes ascend
        best[c], last[c] = best[c - 1], -1
        if fit:
            gain = best[c - sizes[:fit]] + values[:fit]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    pattern, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        k = int(last[c])
        if k >= 0:
            pattern[k] += 1
            c -= int(sizes[k])
        else:
            c -= 1
    return float(values @ pattern), pattern


def patterns(demand: dict[int, int], capacity: int, max_columns: int = 4000) -> list[tuple[dict[int, int], int]]:
    """(pattern, how often) such that every demanded piece has exactly one slot.

    Column generation on `min sum(x), A x = demand, x >= 0` by the revised simplex method, then rounding
    down and first-fit decreasing for the rest. `max_columns` bounds the work; stopping early keeps a valid
    packing.
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0), int)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)  # the basis: one pattern for each size
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ need
    for step in range(max_columns):
        dual = inverse.sum(0)
        value, new = price(dual, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        columns[:, out] = new
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    chosen: list[tuple[dict[int, int], int]] = []
    left = need.astype(int)
    for j in np.argsort(-x, kind="stable"):
        a = columns[:, j].astype(int)
        used = a > 0
        times = min(int(x[j] + 1e-6), int((left[used] // a[used]).min()))
        if times > 0:
            left = left - times * a
            chosen.append(({int(s): int(c) for s, c in zip(sizes[used], a[used], strict=True)}, times))
    return chosen + first_fit({int(s): int(c) for s, c in zip(sizes, left, strict=True)}, capacity)


def first_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """First-fit decreasing on a histogram; equal bins are opened together."""
    chosen = []
    left = {s: c for s, c in left.items() if c > 0}
    while left:
        room, own = capacity, {}
        for s in sorted(left, reverse=True):
            if k := min(left[s], room // s):
                own[s] = k
                room -= k * s
        times = min(left[s] // k for s, k in own.items())
        chosen.append((own, times))
        left = {s: c - times * own.get(s, 0) for s, c in left.items() if c > times * own.get(s, 0)}
    return chosen


def segments(chosen: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, end rank, slots of the bin in a sequence, first sequence, first slot)."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for own, times in chosen:
        slot = 0
        for s in sorted(own, reverse=True):
            out.append((s, rank[s], rank[s] + own[s] * times, own[s], sequence, slot))
            rank[s] += own[s] * times
            slot += own[s]
        sequence += times
    return out


def pack(pieces: DataFrame, keys: list[str], sequence: int = SEQUENCE, grid: int = GRID) -> DataFrame:
    """`pieces` with sequence_id and offset. `pieces` must be a stored table (it is read twice)."""
    spark = pieces.sparkSession
    bin_of = F.ceil(F.col("length") / grid).cast("int")
    counts = {r["_bin"]: r["_n"] for r in pieces.groupBy(bin_of.alias("_bin")).agg(F.count("*").alias("_n")).collect()}  # sequence / grid rows at most
    capacity = sequence // grid
    plan = segments(patterns(counts, capacity))
    schema = "_bin int, _first long, _end long, _each long, _sequence long, _slot long"
    slots = F.broadcast(spark.createDataFrame(plan, schema))  # at most 2 patterns a bin, each of under sqrt(2 * bins) sizes
    buckets = F.array(*[F.lit(-(-counts.get(b, 0) // BUCKET_ROWS) or 1) for b in range(capacity + 1)])
    dealt = pieces.withColumn("_bin", bin_of)
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.get(buckets, F.col("_bin")).cast("long")))
    per = dealt.groupBy("_bin", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_bin").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_bin", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_bin", "_bucket").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(per, ["_bin", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(slots, "_bin").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_each"))).withColumn("_slot", F.col("_slot") + at % F.col("_each"))
    fill = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(fill), F.lit(0)).cast("long"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, grid: int = GRID, with_ids: bool = True, digest: Column | None = None) -> DataFrame:
    """One row for each piece: id, start, length, [ids], ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, the closing id alone. Repeated rows and repeated ids are documents
    of their own. An empty table gives no rows. Texts of any length are cut whole. Other columns are not
    read. `with_ids` keeps each piece's ids (binary, little-endian unsigned 32-bit); without them only
    their crc32 goes through the written table.
    """
    pieces = tokenized_pieces(docs, id_col, text_col, path, sequence)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        pieces = pieces.drop("ids")
    kept = Written(pieces, "pieces").df
    return pack(kept, [id_col, "start", "ids_crc32"], sequence, grid)
