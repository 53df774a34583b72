"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Each unit vector o is rotated by a random orthogonal matrix P and kept as its signs: the code stands for
the unit vector x = P' sign(P o) / sqrt(D). Stored with it is the correction factor f = <x, o>. For another
unit vector q, <x, q> / f estimates <o, q> without bias. As q splits into its part along o and a rest of
length sqrt(1 - <o, q>^2), the estimate is off by at most sqrt(1 - f^2) / f times that rest, and, the rotation
being random, by more than eps sqrt(1 - f^2) / f times that rest only with a probability that falls as
exp(-(D - 1) eps^2 / 2). Hence a pair of cosine t or more has, but for a chance of 1 - CONFIDENCE,

    <x, q> >= f t - eps sqrt(1 - f^2) sqrt(1 - t^2)

and only pairs on that side of the bound are computed anew in double precision. eps is 1 at most, where the
bound is certain.

1. Equal vectors of a label are one node that counts as often as it has ids.
2. Each node is encoded once: its code, its factor, and its rotated vector in bytes (the query form, with the
   length of what rounding took) are stored.
3. Nodes of a label lie in blocks of BLOCK rows around pivots; two blocks meet in one task unless the angle
   between their pivots less both radii already exceeds the angle of the threshold. What travels to the meetings
   are codes, factors and query forms. They tell which nodes have any pair to compute anew.
4. Only these nodes' vectors travel, and their meetings settle the pairs. A task returns one row for each node
   that has links, with their number there, and one link to join it to its cluster; pairs are never returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import hash_first, hot_join, hot_keys
from millrace.llm.graph import components
from millrace.llm.simhash import forest
from millrace.runtime import Written, small_batches

THRESHOLD, BLOCK, PIVOTS, SEED, CONFIDENCE = 0.93, 8192, 1024, 7, 1 - 1e-12
#: Numbers of a vector batch that are gathered at once, tasks that share the meetings of a label.
GATHERED, SPREAD = 1 << 20, 32


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs, one row a vector) and correction factors."""
    turned = unit @ turn.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def bound(factor: np.ndarray, threshold: float, dim: int, confidence: float = CONFIDENCE) -> np.ndarray:
    """The least <x, q> that a pair of the threshold's cosine can have, for each stored vector."""
    rest = math.sqrt(1 - threshold * threshold)
    if confidence < 1:
        rest *= min(1.0, math.sqrt(2 * math.log(2 / (1 - confidence)) / max(1, dim - 1)))
    return factor * threshold - np.sqrt(np.maximum(0, 1 - factor * factor)) * rest - 1e-5  # single-precision products


def signs_of(codes: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors, still rotated, that codes stand for."""
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / math.sqrt(dim)


def query_form(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors in bytes, the worth of one step of each, and the length of what rounding took."""
    step = np.abs(turned).max(1) / 127
    small = np.rint(turned / step[:, None]).astype(np.int8)
    return small, step, np.sqrt(((small * step[:, None] - turned) ** 2).sum(1))


def near_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float = THRESHOLD, confidence: float = CONFIDENCE, strip: int = 256, stored: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows of a, rows of b, pairs computed anew), strip by strip; b None: pairs i < j within a. Unit rows.

    stored: codes and factors of b (of a where b is None), if they are at hand.
    """
    other = a if b is None else b
    dim = a.shape[1]
    turn = rotation(dim)
    codes, factor = encode(other, turn) if stored is None else stored
    signs, least = signs_of(codes, dim), bound(factor, threshold, dim, confidence).astype(np.float32)
    turned = (a @ turn.T).astype(np.float32)
    each = max(1, GATHERED // dim)
    for at in range(0, len(a), strip):
        i, j = np.nonzero(turned[at : at + strip] @ signs.T >= least)
        i += at
        if b is None:
            keep = i < j
            i, j = i[keep], j[keep]
        hit = np.zeros(len(i), bool)
        for k in range(0, len(i), each):
            hit[k : k + each] = np.einsum("pd,pd->p", a[i[k : k + each]], other[j[k : k + each]]) >= threshold
        yield i[hit], j[hit], len(i)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _nodes(rows: DataFrame) -> tuple[Written, Written, Written]:
    """Sound rows (_id, _key), the nodes that their equal vectors make (_key, _rep, _m, _group, _v), and ids to nodes (_id, _rep, _m).

    A node is named by two hashes of its label and vector; ids that repeat with different ones have nodes of their own.
    """
    exact = dict(rows.dtypes)["_v"] == "array<double>"
    good = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    one = rows.where(good).where(sound).withColumn("_group", F.concat_ws("|", F.size("_v"), F.col("_label").cast("string"))).drop("_label")
    if exact:  # squares stay finite
        largest = F.array_max(F.transform("_v", F.abs))
        one = one.withColumn("_v", F.transform(F.col("_v"), lambda x: x / largest))
    name = lambda *more: F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "_group", "_v", *more)), 16, "0") for k in (1, 2)])
    one = Written(one.withColumn("_key", name()).dropDuplicates(["_id", "_key"]), "vectors")
    again = one.df.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id", F.lit(True).alias("_again"))
    own = F.when(F.col("_again"), name("_id")).otherwise(F.col("_key"))
    named = Written(one.df.join(again, "_id", "left").withColumn("_key", own).drop("_again"), "named")
    one.drop()
    nodes = Written(named.df.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_m"), F.first("_group").alias("_group"), F.first("_v").alias("_v")), "nodes")
    total = nodes.df.agg(F.sum("_m")).first()[0] or 0
    of = hot_join(named.df.select("_id", "_key"), nodes.df.select("_key", "_rep", "_m"), "_key", hot_keys(nodes.df, "_key", "_m", total))
    members = Written(of.groupBy("_id", "_rep").agg(F.max("_m").alias("_m")), "members")
    return named, nodes, members


def _pivots(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors of at most PIVOTS nodes, by their length; a bounded sample in hash order."""
    picked = [r["_v"] for r in hash_first(nodes.select("_key", "_v"), "_key", PIVOTS, nodes.count()).collect()]
    return {dim: _unit(pd.Series([v for v in picked if len(v) == dim])) for dim in {len(v) for v in picked}}


def _encoded(nodes: DataFrame, by_dim: dict[int, np.ndarray]) -> DataFrame:
    """`nodes` with _code, _factor, _query, _step, _slack, and _pivot, _angle: the nearest of as many pivots as the group has blocks."""
    blocks_of = nodes.groupBy("_group").agg(F.count("*").alias("_n")).select("_group", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"), "_n")
    total = nodes.count()
    sized = hot_join(nodes, blocks_of.select("_group", "_blocks"), "_group", hot_keys(blocks_of, "_group", "_n", total))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["_v"].map(len).to_numpy()
            for dim in np.unique(dims):
                part = batch[dims == dim]
                unit, pivot, angle = _unit(part["_v"]), np.zeros(len(part), np.int64), np.full(len(part), math.pi)
                turn = rotation(int(dim))
                codes, factor = encode(unit, turn)
                small, step, slack = query_form(unit @ turn.T)
                if dim in by_dim:
                    cosine = unit @ by_dim[dim].T
                    cosine = np.where(np.arange(cosine.shape[1])[None, :] < part["_blocks"].to_numpy()[:, None], cosine, -2)
                    pivot, angle = cosine.argmax(1), np.arccos(np.clip(cosine.max(1), -1, 1))
                yield part.drop(columns="_blocks").assign(_code=[c.tobytes() for c in codes], _factor=factor, _query=[q.tobytes() for q in small], _step=step, _slack=slack, _pivot=pivot, _angle=angle)

    schema = T.StructType(list(nodes.schema.fields)).add("_code", "binary").add("_factor", "double").add("_query", "binary").add("_step", "double").add("_slack", "double").add("_pivot", "long").add("_angle", "double")
    return sized.select(*nodes.columns, "_blocks").mapInPandas(encoded, schema)


def _meetings(placed: DataFrame, by_dim: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(_group, _pivot, _part, _meet, _side): the meetings that each block takes part in, and on which side."""
    about = placed.groupBy("_group", "_pivot", "_part", F.size("_v").alias("_dim")).agg(F.max("_angle").alias("_radius"))
    left, right = (about.select("_group", *[F.col(c).alias(f"{c}{s}") for c in ("_pivot", "_part", "_dim", "_radius")]) for s in "12")
    left = left.withColumn("_salt", F.pmod(F.xxhash64("_pivot1", "_part1"), F.lit(SPREAD)).cast("int"))  # a label's meetings are found by SPREAD tasks
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    later = F.struct("_pivot1", "_part1") <= F.struct("_pivot2", "_part2")
    meet = left.join(right, ["_group", "_salt"]).where(later & (F.col("_dim1") == F.col("_dim2")))
    meet = meet.withColumn("_far", _pivot_angle(by_dim)(F.col("_dim1"), F.col("_pivot1"), F.col("_pivot2")))
    meet = meet.where(F.col("_far") - F.col("_radius1") - F.col("_radius2") <= math.acos(threshold) + 1e-6)
    apart = (F.col("_pivot1") != F.col("_pivot2")) | (F.col("_part1") != F.col("_part2"))
    sides = F.array(*[F.struct(F.col(f"_pivot{s}").alias("_pivot"), F.col(f"_part{s}").alias("_part"), F.lit(k).alias("_side")) for k, s in enumerate("12")])
    each = F.explode(F.when(apart, sides).otherwise(F.slice(sides, 1, 1)))
    return meet.select("_group", F.concat_ws("-", "_pivot1", "_part1", "_pivot2", "_part2").alias("_meet"), each.alias("_e")).select("_group", "_e.*", "_meet")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, confidence: float = CONFIDENCE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Linked are two vectors of one id each whose labels are equal and not null, whose lengths agree and whose
    cosine is at least `threshold`. Null and zero vectors, those with null or non-finite components, and rows
    with a null id link with nothing; a null id is its own component (null) and kept. Rows that repeat an id
    get the same result: its different (label, vector) are vectors of their own that don't link with each other,
    their links are added up and their components are one. An empty table gives no rows; other columns are not read.
    """
    small_batches(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast(kind).alias("_v"))
    named, nodes, members = _nodes(rows)
    named.drop()
    by_dim = _pivots(nodes.df)
    coded = Written(_encoded(nodes.df, by_dim), "coded")
    cell = F.concat_ws("|", "_group", "_pivot")
    cells = coded.df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n")).select("_cell", "_n", F.ceil(F.col("_n") / BLOCK).alias("_parts"))
    total = coded.df.count()
    placed = hot_join(coded.df.withColumn("_cell", cell), cells.drop("_n"), "_cell", hot_keys(cells, "_cell", "_n", total))
    placed = Written(placed.withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_parts"))).drop("_parts", "_cell"), "blocks")
    coded.drop()
    meet = Written(_meetings(placed.df, by_dim, threshold), "meetings")
    keys = ["_group", "_pivot", "_part"]
    dealt = placed.df.select(*keys, "_key", "_rep", "_code", "_factor", "_query", "_step", "_slack", F.size("_v").alias("_dim")).join(meet.df, keys)

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        """Nodes of a meeting that have a pair to compute anew."""
        sides, dim = [pdf[pdf["_side"] == s] for s in (0, 1)], int(pdf["_dim"].iloc[0])
        first, other = sides[0], sides[1] if len(sides[1]) else sides[0]
        within = other is first
        signs = signs_of(np.frombuffer(b"".join(other["_code"]), np.uint8).reshape(len(other), -1), dim)
        least = bound(other["_factor"].to_numpy(), threshold, dim, confidence).astype(np.float32)
        query = np.frombuffer(b"".join(first["_query"]), np.int8).reshape(len(first), dim)
        step, slack = first["_step"].to_numpy(np.float32), first["_slack"].to_numpy(np.float32)
        left, right = np.zeros(len(first), bool), np.zeros(len(other), bool)
        for at in range(0, len(first), 256):
            near = (query[at : at + 256] * step[at : at + 256, None]) @ signs.T + slack[at : at + 256, None] >= least
            if within:
                near &= np.arange(len(first))[None, :] > np.arange(at, at + len(near))[:, None]
            left[at : at + 256] |= near.any(1)
            right |= near.any(0)
        found = [first["_key"][left | right]] if within else [first["_key"][left], other["_key"][right]]
        keys_ = pd.concat(found)
        out = pd.DataFrame({"_key": keys_.to_numpy(), "_side": np.repeat([0, 1][: len(found)], [len(f) for f in found])})
        return out.assign(_group=pdf["_group"].iloc[0], _meet=pdf["_meet"].iloc[0])

    open_ = Written(dealt.groupBy("_group", "_meet").applyInPandas(screen, "_key string, _side int, _group string, _meet string"), "open")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["_side"] == s] for s in (0, 1)]
        both = pd.concat(sides)
        reps, times = both["_rep"].to_numpy(object), both["_m"].to_numpy()
        n, links = len(sides[0]), np.zeros(len(both), np.int64)
        within = not len(sides[1])
        a, b = _unit(sides[0]["_v"]), None if within else _unit(sides[1]["_v"])
        held = sides[0] if within else sides[1]
        stored = np.frombuffer(b"".join(held["_code"]), np.uint8).reshape(len(held), -1), held["_factor"].to_numpy()

        def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j, _ in near_pairs(a, b, threshold, confidence, stored=stored):
                j = j if within else j + n
                apart = reps[i] != reps[j]
                i, j = i[apart], j[apart]
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                yield i, j

        root = forest(len(both), linked())
        some = np.flatnonzero(links)
        return pd.DataFrame({"_rep": reps[some], "_links": links[some], "_root": reps[root[some]]})

    id_type = vectors.schema[id_col].dataType
    exact = open_.df.join(placed.df.select("_key", "_rep", "_m", "_code", "_factor", "_v"), "_key")
    found = Written(exact.groupBy("_group", "_meet").applyInPandas(settle, T.StructType().add("_rep", id_type).add("_links", "long").add("_root", id_type)), "found")
    for spent in (nodes, placed, meet, open_):
        spent.drop()
    counts = found.df.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    joined = components(found.df.select(F.col("_rep").cast("long").alias("a"), F.col("_root").cast("long").alias("b"))).withColumnRenamed("node", "_rep")
    reps = members.df.groupBy("_rep").agg(F.count("*").alias("_n")).join(counts, "_rep", "left").join(joined, "_rep", "left")
    reps = Written(reps, "linked")
    of = hot_join(members.df, reps.df.drop("_n"), "_rep", hot_keys(reps.df, "_rep", "_n", members.df.count()))
    of = of.select("_id", (F.coalesce("_links", F.lit(0)) + F.col("_m") - 1).alias("_links"), F.coalesce("component", F.col("_rep").cast("long")).alias("component"))
    ids = rows.select("_id")
    per = Written(ids.where("_id is not null").groupBy("_id").agg(F.count("*").alias("_n")).join(of, "_id", "left"), "results")
    for spent in (found, reps, members):
        spent.drop()
    known = hot_join(ids.where("_id is not null"), per.df.drop("_n"), "_id", hot_keys(per.df, "_id", "_n", per.df.agg(F.sum("_n")).first()[0] or 0))
    result = known.unionByName(ids.where("_id is null").select("_id", F.lit(0).cast("long").alias("_links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce(F.col("component"), F.col("_id").cast("long"))
    return result.select(
        F.col("_id").alias(id_col),
        F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("_id").cast("long")).alias("kept"),
    )


def _pivot_angle(by_dim: dict[int, np.ndarray]):
    @F.pandas_udf("double")
    def angle(dim: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([math.acos(max(-1.0, min(1.0, float(by_dim[d][x] @ by_dim[d][y])))) if d in by_dim else 0.0 for d, x, y in zip(dim, a, b, strict=True)], dtype=float)

    return angle
