"""The manifest against a tree built in one list, at several arities and spans, and its proofs against tampering."""

import random
from hashlib import sha256

import pyarrow as pa
import pytest
from compare import agree
from pyspark.sql import functions as F

from millrace.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def brute(rows, arity):
    """rows: (group, order, leaf, seen) -> sorted (order, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for g, o, leaf, seen in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((o, leaf, seen))
    trees = {g: levels([leaf for _, leaf, _ in own], arity) for g, own in groups.items()}
    top = levels([t[-1][0] for t in trees.values()], arity)
    out = []
    for j, (g, own) in enumerate(groups.items()):
        for i, (o, leaf, seen) in enumerate(own):
            chain, at = [], seen or leaf
            for tree, k in ((trees[g], i), (top, j)):
                for level in tree[:-1]:
                    first = k // arity * arity
                    run = level[first : first + arity]
                    before, after = run[: k - first], run[k - first + 1 :]
                    chain += before + after
                    at, k = H(*before, at, *after), k // arity
            out.append((o, leaf, trees[g][-1][0], top[-1][0], H(*chain), at, at == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("arity", "span"), [(2, 10), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_against_one_list(spark, arity, span):
    rng = random.Random(arity * 10 + span)
    rows = []
    for g, n in ((None, 1), ("", 2), ("b", 37), ("a", 8), ("é", 9), ("big", 100)):
        rows += [(g, rng.choice([None, *range(60)]), H(str(rng.randrange(400))), rng.choice([None, None, H("seen")])) for _ in range(n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, own string, now string").withColumn("i", F.lit(1)).withColumn("grp", F.lit("x")).withColumn("digest", F.lit(2))
    got = merkle.manifest(df.repartition(5), F.col("own"), F.col("now"), arity=arity, span=span).collect()
    want = brute(rows, arity)
    # rows of one order and leaf may stand in either order among themselves: compare what doesn't depend on it
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    assert sorted(r["proof_sha256"] for r in got) == sorted(w[4] for w in want)
    assert sum(r["verified"] for r in got) == sum(w[6] for w in want)
    for r in got:
        assert merkle.fold(bytes.fromhex(r["leaf"]), bytes(r["siblings"]), bytes(r["shape"])).hex() == r["root"]


def test_digests_in_any_order():
    """Partial parents take their children in any order, from any task."""
    rng = random.Random(1)
    leaves = [bytes([k]) * 32 for k in range(23)]
    rows = [("g", 0, k, 23, d) for k, d in enumerate(leaves)]
    rng.shuffle(rows)

    def batch(part):
        return pa.RecordBatch.from_pylist([dict(zip(("grp", "level", "i", "n", "digest"), r, strict=True)) for r in part])

    def run(part):
        return [tuple(r.values()) for b in merkle._combine(2, 5)(iter([batch(part)])) for r in b.to_pylist()]

    frontier = run(rows[:9]) + run(rows[9:15]) + run(rows[15:])
    assert len(frontier) < 23
    ((_, level, i, n, top),) = run(frontier)
    assert (level, i, n) == (5, 0, 1) and top.hex() == levels([d.hex() for d in leaves], 2)[-1][0]


def test_leaf_values(spark):
    df = spark.createDataFrame([(1, None, "é:", -5), (None, "", "x", None)], "a long, b string, c string, d int")
    got = [r[0] for r in df.select(merkle.digest([F.col(c) for c in "abcd"])).collect()]
    assert got == [H("1:1", "-", "3:é:", "2:-5"), H("-", "0:", "1:x", "-")]


def test_empty_and_single(spark):
    df = spark.createDataFrame([(7, "en", H("x"))], "doc_id long, lang string, h string")
    (r,) = merkle.manifest(df, F.col("h"), F.lit(None).cast("string")).collect()
    assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) == (H("x"), H("x"), H("x"), H(""), True)
    assert merkle.manifest(df.where("false"), F.col("h"), F.lit(None).cast("string")).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(df, F.col("h"), F.col("h"), arity=1)


def test_query_with_nulls(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "s", None, None, ""), (1, "s", None, None, ""), (2, "s", "en", 2**63 - 1, "t"), *((k, "s", "en", 1, "x" * k) for k in range(3, 40))]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got if r["doc_id"] in (None, 1)) and not all(r["verified"] for r in got)


def test_query(spark):
    agree(spark, SF, queries.QUERIES["op12_merkle_manifest"], queries.ORACLES["op12_merkle_manifest"])
