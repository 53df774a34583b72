"""SimHash near-duplicates: links at two or fewer differing bits, found by Gray-order hierarchical indexes.

Fingerprints are made once per document and collapsed to distinct values. Distinct ones are dealt out by
exact routing: the 64 bits are cut into three blocks, and two fingerprints with at most two differing bits
agree on one block at least. A routing group that holds more than GROUP_ROWS fingerprints is dealt out again
by its own remaining bits in the same way, up to three times; after the third, at most 22 bits are free, so
that no group can hold more than 2^22 fingerprints whatever the data.

Inside a task, the fingerprints of each group lie in Gray-rank order. Neighbouring ones share bits: each node
of the index holds the mask and the pattern of the bits on which all below it agree, level by level up to the
group's root. A search adds up the differences at the bits that each node fixes anew and leaves the whole
node out once the sum passes the limit.

Links are joined inside the task, so that it returns one link for each fingerprint at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hot_join, hot_keys
from millrace.llm.graph import components
from millrace.runtime import Written, small_batches

SEED = 42
WORDS = 3
LIMIT = 2
GROUP_ROWS = 4096
FANOUT = 8
_HASHES = 1 << 16
_FULL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """64 majority bits of the hashes of a text's word shingles, repeats included; 0 where there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        part = words[at : at + _HASHES + WORDS - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return prints(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code comes in the Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def links_within(codes: np.ndarray, groups: np.ndarray, limit: int = LIMIT, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows i < j of one group that differ in at most `limit` bits.

    Rows must be ordered by group and, in it, by Gray rank.
    """
    n = len(codes)
    head = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    # levels[k]: pattern, fixed bits, bits fixed anew below the parent, first row, end row, first child, end child
    both, either, first, end = codes.copy(), codes.copy(), np.arange(n), np.arange(1, n + 1)
    counts = np.diff(np.r_[head, n])
    levels = [{"and": both, "or": either, "first": first, "end": end, "child": None}]
    while counts.max(initial=1) > 1:
        below = levels[-1]
        parents = -(-counts // FANOUT)
        starts = np.repeat(np.cumsum(np.r_[0, counts[:-1]]), parents) + FANOUT * (np.arange(parents.sum()) - np.repeat(np.cumsum(np.r_[0, parents[:-1]]), parents))
        ends = np.r_[starts[1:], len(below["and"])]
        levels.append({"and": np.bitwise_and.reduceat(below["and"], starts), "or": np.bitwise_or.reduceat(below["or"], starts), "first": below["first"][starts], "end": below["end"][ends - 1], "child": (starts, ends)})
        counts = parents
    for level in levels:
        level["mask"] = ~(level["and"] ^ level["or"])
        level["new"] = level["mask"].copy()
    for above, below in zip(levels[1:], levels, strict=False):
        sizes = above["child"][1] - above["child"][0]
        below["new"] = below["mask"] & ~np.repeat(above["mask"], sizes)
    root_of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, n]))
    for at in range(0, n, block):
        query = np.arange(at, min(n, at + block))
        node = root_of[query]
        differ = np.zeros(len(query), np.int64)  # a root's pattern holds for its whole group
        for depth in range(len(levels) - 1, 0, -1):
            lo, hi = levels[depth]["child"]
            size = (hi - lo)[node]
            child = np.repeat(lo[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(np.r_[0, size[:-1]]), size) if len(node) else node
            query, differ = np.repeat(query, size), np.repeat(differ, size)
            below = levels[depth - 1]
            differ = differ + np.bitwise_count((codes[query] ^ below["and"][child]) & below["new"][child])
            keep = (differ <= limit) & (below["end"][child] > query + 1)
            query, node, differ = query[keep], child[keep], differ[keep]
        yield query, node


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of n rows is linked to, through any number of links."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _blocks(mask: int) -> list[int]:
    """`mask` and one more third of the free bits, for each third."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [round(k * len(free) / 3) for k in range(4)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group to its least rows; the input comes ordered by (route, key), groups in one piece."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def solve(table: pa.Table) -> pa.RecordBatch:
        codes = table.column("fp").to_numpy().view(np.uint64)
        route, key = table.column("route").to_numpy(), table.column("key").to_numpy()
        order = np.lexsort((gray_rank(codes), key, route))
        codes, route, key = codes[order], route[order], key[order]
        groups = np.cumsum(np.r_[False, (route[1:] != route[:-1]) | (key[1:] != key[:-1])]) if len(codes) else route
        root = forest(len(codes), links_within(codes, groups))
        apart = np.flatnonzero(root != np.arange(len(codes)))
        signed = codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[apart]), pa.array(signed[root[apart]])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 18:
            whole = pa.Table.from_batches(kept)
            route, key = whole.column("route").to_numpy(), whole.column("key").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (key[1:] != key[:-1])])[-1])
            if cut:  # the last group may go on in the next batch
                yield solve(whole.slice(0, cut))
                kept, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if kept:
        yield solve(pa.Table.from_batches(kept))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` at LIMIT or fewer differing bits.

    Null fingerprints link with nothing; repeated ones count once. Equal numbers of differing bits need no rule, as
    every link within LIMIT counts. No fingerprints give no links.
    """
    return _near_links(distinct)[0]


def _near_links(distinct: DataFrame) -> tuple[DataFrame, tuple[Written, ...]]:
    """As near_links, with the tables that the links are read from."""
    out, masks, used = [], [0], []
    rows = distinct.select("fp", F.lit(0).alias("route"), F.lit(0).cast("long").alias("key")).where("fp is not null").distinct()
    for level in range(3):
        finer = [_blocks(m) for m in masks]
        routes = [F.struct(F.lit(3 * k + j).alias("route"), F.lit(_signed(m)).alias("mask")) for k, own in enumerate(finer) for j, m in enumerate(own)]
        masks = [m for own in finer for m in own]
        third = F.slice(F.array(*routes), F.col("route") * 3 + 1, 3) if level else F.array(*routes)
        dealt = rows.select("fp", F.explode(third).alias("_r")).select("fp", "_r.route", F.col("fp").bitwiseAND(F.col("_r.mask")).alias("key"))
        if level < 2:
            large = dealt.groupBy("route", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_ROWS)
            used.append(Written(dealt.join(large, ["route", "key"], "left"), "routes"))
            marked = used[-1].df
            rows = marked.where(F.col("_n").isNotNull()).select("fp", "route", "key")
            dealt = marked.where(F.col("_n").isNull()).select("fp", "route", "key")
        spread = dealt.repartition("route", "key").sortWithinPartitions("route", "key")
        out.append(spread.select("fp", "route", "key").mapInArrow(_star_links, "a long, b long"))
    return out[0].union(out[1]).union(out[2]), tuple(used)


def _groups(prints: DataFrame, order: str) -> tuple[Written, list[int]]:
    """(fp, component, least `order` of the component) of each distinct fingerprint, and the fingerprints that very many rows have."""
    distinct = Written(prints.groupBy("fp").agg(F.min(order).alias("_least"), F.count("*").alias("_n")), "distinct")
    hot = hot_keys(distinct.df, "fp", "_n", distinct.df.agg(F.sum("_n")).first()[0] or 0)
    links, used = _near_links(distinct.df)
    joined = components(links, used).select(F.col("node").alias("fp"), "component")
    least = distinct.df.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = Written(least.select("fp", "component", "_least"), "components")
    per = Written(least.df.groupBy("component").agg(F.min("_least").alias("component_id"), F.count("*").alias("_n")), "least")
    wide = hot_keys(per.df, "component", "_n", per.df.agg(F.sum("_n")).first()[0] or 0)
    of = Written(hot_join(least.df.select("fp", "component"), per.df.select("component", "component_id"), "component", wide), "groups")
    for spent in (distinct, least, per):
        spent.drop()
    return of, hot


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the least id, or any of a null id where no id of the component is known."""
    small_batches(docs.sparkSession)
    row = F.struct(F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at"))
    rows = Written(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), fingerprint_column(F.col(text_col)).alias("fp"), row.alias("_row")), "numbered").df
    of, _ = _groups(rows.select("fp", "_row"), "_row")
    kept = rows.withColumn("_at", F.col("_row._at")).join(of.df.select(F.col("component_id._at").alias("_at")).distinct(), "_at", "left_semi")
    return kept.select("_doc.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other.
    component_id is the least id reachable by links, the row's own included (null only where no id of the
    component is known). Repeated rows share a component. An empty table gives no rows; other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    prints = Written(docs.select(F.col(id_col).alias("_id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints").df
    of, hot = _groups(prints, "_id")
    out = hot_join(prints, of.df.select("fp", "component_id"), "fp", hot)
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
