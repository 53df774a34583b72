"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

One inserted, deleted or replaced character touches at most two bigrams of either word. So of the three bigrams of a
word that come first in one global order (rarest first), at least one is untouched and is among the first three of the
near word too, at the same place or, in the longer word, one further. Words meet only under such a bigram, its place and
their lengths, and each meeting is verified.

A bigram that very many words have among their rarest gives a large meeting. A meeting of more than `MEETING` words is
dealt again, as often as needed: the edit lies in one half of the stretch that may differ, so the other half is equal,
and words meet once under each half. What may still differ shrinks to one character, so meetings are bounded by the
alphabet in the end, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hot_join, hot_keys
from millrace.runtime import Written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: Bigrams of a word that are joined: one more than an edit can touch.
RAREST = 3
#: Words that meet under one key without being dealt again.
MEETING = 128
#: Longer words are compared one by one, not in a matrix of characters.
WIDE = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """Maximal runs of letters of a whole text, as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def misspelt(word: Column, key: Column, one_in: int = 97) -> Column:
    """`word` without one character where crc32 of `key:word` is a multiple of `one_in`: the planted slips."""
    h = F.crc32(F.concat(key, F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the distinct `word` values that are long and frequent enough; nulls don't count."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigram_ranks(vocab: DataFrame) -> dict[str, int]:
    """Place of each bigram in the global order, rarest first. There are at most as many as pairs of letters of the alphabet."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, 2)))
    counts = vocab.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r["gram"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, ranks: dict[str, int], most: int = RAREST) -> list[int]:
    """Places of the rarest bigrams of a word; of equal ones the first come first."""
    return [k for _, k in sorted((ranks[word[k : k + 2]], k) for k in range(len(word) - 1))[:most]]


def _prefixes(ranks: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            places = [rarest(w, ranks) for w in words]
            owner = np.repeat(np.arange(len(words)), [len(p) for p in places])
            flat = [(words[k][p : p + 2], p) for k, own in enumerate(places) for p in own]
            take = pa.array(owner)
            columns = [batch.column("word").take(take), batch.column("n").take(take), pa.array([g for g, _ in flat], pa.string()), pa.array([p for _, p in flat], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "gram", "p"])

    return run


_SAME, _SHORT, _LONG = 0, 1, 2


def _meetings(prefixes: DataFrame) -> DataFrame:
    """(key, side, s, e, word, n): under `key` the words of a meeting may differ in [s, e), for the longer side [s, e + 1)."""
    size, p = F.length("word"), F.col("p")

    def key(place: Column, length: Column, side: int) -> Column:
        return F.struct(F.xxhash64("gram", place, length, F.lit(min(side, 1))).alias("key"), F.lit(side).alias("side"), F.lit(0).alias("s"), (length.cast("int")).alias("e"))

    keys = F.array(key(p, size, _SAME), key(p, size, _SHORT), key(p + 1, size, _SHORT), key(p, size - 1, _LONG))
    return prefixes.select(F.explode(keys).alias("_k"), "word", "n").select("_k.*", "word", "n")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row under two keys: one half of what may differ is equal, and only the other may differ still."""
    s, e, long_ = F.col("s"), F.col("e"), F.when(F.col("side") == _LONG, 1).otherwise(0)
    low = F.floor((s + e) / 2).cast("int")
    high = low + F.when((F.col("side") != _SAME) & (low < e), 1).otherwise(0)  # an insertion is before `high` or at `low` at most

    def half(tag: int, begin: Column, size: Column, left: Column, right: Column) -> Column:
        text = F.substring("word", (begin + 1).cast("int"), size.cast("int"))
        return F.struct(F.xxhash64("key", F.lit(tag), text).alias("key"), "side", left.alias("s"), right.alias("e"))

    both = F.array(half(0, s, high - s, high, e), half(1, low + long_, e - low, s, low))
    return rows.select(F.explode(both).alias("_k"), "word", "n").select("_k.*", "word", "n")


def is_near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one word to the other."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    lo, hi = 0, len(a)  # the longest common start, by halves
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def near_in_runs(words: list[str], group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose words are near: of one group and, where it has two sides, of different sides. Groups come in one piece."""
    n = len(words)
    sizes = np.array([len(w) for w in words])
    wide = int(sizes.max(initial=0)) > WIDE
    if not wide:
        chars = np.array(words, f"<U{max(1, sizes.max(initial=1))}").view(np.uint32).reshape(n, -1)
    for step in range(1, n):
        a = np.flatnonzero(group[step:] == group[:-step])
        if not len(a):
            return
        b = a + step
        keep = (side[a] == _SAME) | (side[a] != side[b])
        a, b = a[keep], b[keep]
        if wide:
            ok = np.array([is_near(words[i], words[j]) for i, j in zip(a, b, strict=True)], bool)
        else:
            differ = chars[a] != chars[b]
            ok = np.zeros(len(a), bool)
            even = sizes[a] == sizes[b]
            ok[even] = differ[even].sum(1) == 1
            odd = np.flatnonzero(~even)
            if len(odd):
                flip = sizes[a[odd]] > sizes[b[odd]]
                short, long_ = np.where(flip, b[odd], a[odd]), np.where(flip, a[odd], b[odd])
                start = differ[odd].argmax(1)  # words of unequal length differ somewhere
                at = np.arange(chars.shape[1] - 1)
                shifted = (chars[short][:, :-1] != chars[long_][:, 1:]) & (at[None, :] >= start[:, None])
                ok[odd] = (sizes[long_] - sizes[short] == 1) & ~shifted.any(1)
        yield a[ok], b[ok]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links both ways of each meeting; rows come ordered by (size, key), meetings in one piece."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        size = table.column("size").to_numpy()
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):  # words of about one length, so that a matrix isn't wider than them
            part = table.slice(lo, hi - lo)
            key, side = part.column("key").to_numpy(), part.column("side").to_numpy()
            for a, b in near_in_runs(part.column("word").to_pylist(), key, side):
                if len(a):
                    left, right = pa.array(np.r_[a, b]), pa.array(np.r_[b, a])
                    word, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
                    yield pa.RecordBatch.from_arrays([word.take(left), n.take(left), word.take(right), n.take(right)], ["word", "n", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 15:
            whole = pa.Table.from_batches(kept)
            key, size = whole.column("key").to_numpy(), whole.column("size").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])])[-1])
            if cut:  # the last meeting may go on in the next batch
                yield from solve(whole.slice(0, cut))
                kept, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if kept:
        yield from solve(pa.Table.from_batches(kept))


def near_words(vocab: DataFrame, meeting: int = MEETING) -> tuple[DataFrame, list[Written]]:
    """(word, n, near, near_n) of every two near words, both ways, each once; and the tables it is read from.

    vocab: distinct words of four characters at least, as shorter ones needn't keep an untouched bigram.
    """
    ranks = bigram_ranks(vocab)
    prefixes = vocab.mapInArrow(_prefixes(ranks), "word string, n long, gram string, p int")
    out, used = [], []
    level = Written(_meetings(prefixes), "meetings")
    while True:
        side = F.col("side")
        counts = level.df.groupBy("key").agg(F.count("*").alias("_n"), F.count_if(side != _LONG).alias("_a"), F.count_if(side != _SHORT).alias("_b"))
        counts = Written(counts.where((F.col("_n") > 1) & (F.col("_a") > 0) & (F.col("_b") > 0)).select("key", "_n"), "counts")
        total, most = counts.df.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
        marked = Written(hot_join(level.df, counts.df, "key", hot_keys(counts.df, "key", "_n", total)), "marked")
        level.drop()
        counts.drop()
        used.append(marked)
        large = (F.col("_n") > meeting) & (F.col("e") - F.col("s") > F.when(side == _SAME, 1).otherwise(0))
        small = marked.df.where(~large).select("key", "side", "word", "n", F.when(side == _LONG, F.length("word") - 1).otherwise(F.length("word")).alias("size"))
        out.append(small.repartition("key").sortWithinPartitions("size", "key").mapInArrow(_verify, "word string, n long, near string, near_n long"))
        if most <= meeting or marked.df.where(large).isEmpty():
            break
        level = Written(_halves(marked.df.where(large)), "meetings")
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links.repartition("word").dropDuplicates(["word", "near"]), used


def _roots(forms: DataFrame) -> Written:
    """(word, root) of every row of forms (word, form): pointers are doubled until all stand at a word without form."""
    now = Written(forms.select("word", F.coalesce("form", "word").alias("at")), "roots")
    while True:
        per = Written(now.df.groupBy("at").agg(F.count("*").alias("_n")), "pointed")
        hot = hot_keys(per.df, "at", "_n", per.df.agg(F.sum("_n")).first()[0] or 0)
        per.drop()
        ahead = now.df.select(F.col("word").alias("at"), F.col("at").alias("_next"))
        step = Written(hot_join(now.df, ahead, "at", hot).select("word", F.col("_next").alias("at"), (F.col("_next") != F.col("at")).alias("_moved")), "roots")
        now.drop()
        now = step
        if now.df.where("_moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = 2, meeting: int = MEETING) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word that is long and frequent enough.

    words: one row an occurrence, in a column `word`; nulls and shorter words don't count, no words give no rows. A word's
    form is its near word of largest n (ties: the smallest in code-point order) where that n is `ratio` times its own at
    least, else null; the root is where forms lead, the word itself if it has none. `ratio` must be over 1, so that
    forms never lead round.
    """
    if min_length < RAREST + 1 or ratio <= 1:
        raise ValueError("words need four characters at least, and the ratio must be over 1")
    vocab = Written(vocabulary(words.select("word"), min_length, min_count), "vocabulary")
    links, used = near_words(vocab.df, meeting)
    best = F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near"))).alias("_best")
    found = links.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = vocab.df.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("_best._n") >= ratio * F.col("n"), F.col("_best")).alias("_best"))
    forms = Written(joined.select("word", F.col("_best.near").alias("form"), "n", "n_near", (-F.col("_best._n")).alias("form_n")), "forms")
    for spent in (vocab, *used):
        spent.drop()
    roots = _roots(forms.df)
    return forms.df.join(roots.df.select("word", F.col("at").alias("root")), "word").select("word", "form", "root", "n", "n_near", "form_n")


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 97) -> DataFrame:
    """One row for each run of letters of every whole text, A-Z lower-cased, with its planted slip; a null text has none, a null id counts as empty."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    spread = docs.select(key.alias("_key"), F.explode(runs(F.col(text_col))).alias("_run"))
    return spread.select("_key", lower_ascii(F.col("_run")).alias("_run")).select(misspelt(F.col("_run"), F.col("_key"), one_in).alias("word"))
