"""Lines that are no UTF-8, delivery over an old output, ties of verdicts, retries, screens with rings of parents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import votes
from millrace.provider import LONGEST_REST_S, delay, retry_after
from millrace.runtime import shared_dir
from millrace.sinks import emit
from millrace.sources import jsonl, ui


def test_bad_bytes_are_one_bad_row(spark, tmp_path):
    (tmp_path / "b.jsonl").write_bytes(b'{"text": "one"}\n\n{"text": "\xff\xfe"}\n{"text": "two"}\r\n[1]\n{"no": 1}')
    (tmp_path / "a.jsonl").write_bytes(b'{"text": "\xc3\xa9"}')
    (tmp_path / "c.txt").write_bytes(b'{"text": "not read"}')
    lines = jsonl.classify_lines(jsonl.read_lines(spark, str(tmp_path)))
    got = {(r["source_file"], r["line_no"]): (r["text"], r["bad"]) for r in lines.collect()}
    assert got == {("a.jsonl", 1): ("é", None), ("b.jsonl", 1): ("one", None), ("b.jsonl", 3): (got["b.jsonl", 3][0], "not_utf8"), ("b.jsonl", 4): ("two", None), ("b.jsonl", 5): (None, "not_object"), ("b.jsonl", 6): (None, "no_text")}
    one = jsonl.classify_lines(jsonl.read_lines(spark, str(tmp_path / "c.txt")))
    assert [r["text"] for r in one.collect()] == ["not read"]


def test_line_numbers_across_blocks(spark, tmp_path):
    texts = [f"text {k} " + "x" * (k % 50) for k in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in texts))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        got = {r["line_no"]: r["text"] for r in jsonl.classify_lines(jsonl.read_lines(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k + 1: t for k, t in enumerate(texts)}


def test_delivery_replaces_and_leaves_nothing_else(spark, tmp_path):
    for n in (3, 2):
        emit.deliver(spark.range(n), str(tmp_path / "out"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("part-*")) == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]


def test_main_rows_are_objects(spark):
    given = ['{"a":1}', ' {"a": "}"}\n', "{}", " { } ", '{"b":2,"_meta":{"x":1},"a":[1,{"c":null}]}']
    rows = spark.createDataFrame([(g,) for g in given], "o string").select("o", emit.main_row(F.col("o"), F.struct(F.lit(1).alias("id"), F.lit(None).cast("string").alias("n"))).alias("v"))
    for r in rows.collect():
        assert json.loads(r["v"]) == json.loads(r["o"]) | {"_meta": {"id": 1, "n": None}} and r["v"].count('"_meta"') == 1


def test_a_tie_passes(spark):
    rows = [(1, "pass"), (1, "fail"), (2, "fail"), (2, "fail"), (2, "pass"), (3, "fail"), (4, "pass")]
    got = votes.verdict_majority(spark.createDataFrame(rows, "k int, v string"), ["k"], "v").collect()
    assert {r["k"]: r["verdict"] for r in got} == {1: "pass", 2: "fail", 3: "fail", 4: "pass"}


def test_delays():
    rng = random.Random(1)
    some = [delay(3, 1.0, rng) for _ in range(400)]
    assert min(some) < 0.5 and 7 < max(some) <= 8 and max(delay(40, 1.0, rng) for _ in range(99)) <= 60 < LONGEST_REST_S
    assert retry_after(" 7 ", 0) == 7 and retry_after("-3", 0) == 0 and retry_after("soon", 0) is None and retry_after(None, 0) is None
    assert retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 20) == 40


def visited(nodes):
    """Depth first by hand: roots, then what no root reaches, in the order of the file."""
    known, out, seen = {n["node_id"] for n in nodes}, [], set()

    def visit(k, depth):
        if k not in seen:
            seen.add(k)
            out.append((k, depth))
            for c, n in enumerate(nodes):
                if n["parent_id"] == nodes[k]["node_id"]:
                    visit(c, depth + 1)

    for k in [*(k for k, n in enumerate(nodes) if n["parent_id"] not in known), *range(len(nodes))]:
        visit(k, 0)
    return out


def test_order_of_flat_trees():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(9)
        nodes = [{"node_id": str(k), "parent_id": rng.choice([None, *map(str, range(n + 1))]), "k": k} for k in range(n)]
        assert [(x["k"], x["depth"]) for x in ui._in_depth_order(nodes)] == visited(nodes)


class Context:
    master = "spark://somewhere"

    def getConf(self):
        return {}


class Session:
    conf, sparkContext = {}, Context()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="share"):
        shared_dir(Session())
