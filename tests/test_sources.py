import json
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as text_fn
from millrace.functions import ui as ui_fn
from millrace.sources import jsonl, ui


def test_lines_keep_place_and_fault(spark, tmp_path):
    rows = ['{"text": "one"}', "", "[1]", "{broken", '{"text": null}', '{"text": {"a": 1}}', '{"other": 1}']
    (tmp_path / "b.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "c.txt").write_text('{"text": "no"}')
    got = jsonl.classify_lines(jsonl.read_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r["line_no"], r["bad"]) for r in got] == [(1, None), (3, "not_object"), (4, "not_json"), (5, "no_text"), (6, None), (7, "no_text")]
    assert json.loads(got[4]["text"]) == {"a": 1}
    good, bad = jsonl.records(jsonl.classify_lines(jsonl.read_lines(spark, str(tmp_path))), limit=1)
    assert [r["text"] for r in good.collect()] == ["one"] and bad.count() == 4
    with pytest.raises(jsonl.InputError):
        jsonl.records(jsonl.classify_lines(jsonl.read_lines(spark, str(tmp_path))), on_bad="fail")


def test_batches_number_in_order(spark):
    got = jsonl.batches(spark.range(100).select((F.col("id") * 7 % 101).alias("k")), ["k"], 30).orderBy("k").collect()
    assert [r["seq"] for r in got] == list(range(1, 101))
    assert [r["batch_no"] for r in got] == [(k // 30) + 1 for k in range(100)]


def test_flat_tree_in_any_order():
    rows = [{"id": 3, "parent": 2, "class": "Text", "text": "deep"}, {"id": 1, "parent": None, "bounds": "[0,0][4,5]"}, {"id": 2, "parent": 1, "visible": "No"}, {"id": 8, "parent": 9}, {"id": 9, "parent": 8}]
    nodes = ui.parse_tree("\n".join(map(json.dumps, rows)) + "\nnot json\n5")
    assert [(n["node_id"], n["depth"]) for n in nodes] == [("1", 0), ("2", 1), ("3", 2), ("8", 0), ("9", 1)]
    assert nodes[0]["bounds"] == [0, 0, 4, 5] and not nodes[1]["visible"] and nodes[0]["role"] == "unknown"


def test_nested_tree_and_empty():
    nodes = ui.parse_tree(json.dumps({"class": "A", "children": [{"class": "B", "children": [{"class": "C"}]}, {"class": "D", "pkg": 7}]}))
    assert [(n["node_id"], n["parent_id"], n["depth"], n["role"]) for n in nodes] == [("1", None, 0, "A"), ("2", "1", 1, "B"), ("3", "2", 2, "C"), ("4", "1", 1, "D")]
    assert nodes[3]["extra"] == {"pkg": "7"}
    assert ui.parse_tree("") is None and ui.parse_tree("[1]\nnull") is None


@pytest.fixture
def screens(spark):
    one = [{"id": 1, "class": "Root", "package": "shop", "bounds": [0, 0, 9, 9]}, {"id": 2, "parent": 1, "class": "Button", "text": "Buy", "bounds": [1, 1, 5, 5]}, {"id": 3, "parent": 1, "class": "Text", "text": "hidden", "visible": False}]
    two = [one[0], one[1] | {"text": "Pay"}, {"id": 4, "parent": 1, "class": "Text", "text": "Total"}]
    rows = [("a", "\n".join(map(json.dumps, one)), "\n".join(map(json.dumps, two)))]
    df = spark.createDataFrame(rows, "k string, x string, y string")
    return df.select("k", ui.tree_nodes(F.col("x").cast("binary")).alias("x"), ui.tree_nodes(F.col("y").cast("binary")).alias("y"))


def test_linear_digest_diff(screens):
    r = screens.select(ui_fn.linear(F.col("x"), 4).alias("l"), ui_fn.digest(F.col("x"), 100).alias("d"), ui_fn.digest(F.col("x"), 9).alias("s"), ui_fn.poor(F.col("x")).alias("p")).first()
    assert r["l"] == 'Root [0,0,2,2] package=shop\n  Button "Buy" [0,0,1,1]'
    assert r["d"] == "[shop] Buy｜*Buy" and r["s"] == "[shop] B…" and not r["p"]
    d = ui_fn.diff(screens, ["k"], "x", "y", 4).first()
    assert (d["added"], d["removed"], d["text_changed"], d["change_ratio"]) == (1, 0, 1, pytest.approx(2 / 3))


def test_pairs_from_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "uitree_01.jsonl").write_text('{"id": 1}')
    (tmp_path / "s" / "image_1.PNG").write_bytes(bytes.fromhex(ui.PNG) + b"x")
    (tmp_path / "uitree_2.jsonl").write_text('{"id": 1}')
    (tmp_path / "image_3.jpg").write_bytes(b"nothing")
    (tmp_path / "uitree_3.jsonl").write_text('{"id": 1}')
    got = {r["idx"]: r["state"] for r in ui.ui_records(spark, str(tmp_path)).collect()}
    assert got == {1: "pair", 2: "missing_image", 3: "image_decode_error"}


def test_normalized_and_shingles(spark):
    df = spark.createDataFrame([("  a　 b\x1fc ",), ("é",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text_fn.normalized(F.col("t"))).collect()] == ["a b c", "é", "", None]
    grams = spark.createDataFrame([("abcdefa",), ("abc",), ("",)], "t string").select(text_fn.shingles(F.col("t"))).collect()
    assert [r[0] for r in grams] == [["abcde", "bcdef", "cdefa"], ["abc"], []]


def test_normalized_sends_python_only_what_nfc_may_change(spark, monkeypatch):
    texts = ["plain", "caf\u00e9 \u0142\u00f3d\u017a\u00a0 x", " \n two  \t words\x85", "e\u0301 cafe\u0301", "\u1112\u1161\u11ab", "\u212b\u2003\u2003x", "q\u0323\u0307 \u2028", "\U0001d15e", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None else re.sub(f"[ {text_fn.OTHER_SPACE}]+".encode().decode("unicode_escape"), " ", unicodedata.normalize("NFC", t)).strip(" ") for t in texts]
    assert [r[0] for r in df.select(text_fn.normalized(F.col("t"))).collect()] == want

    @F.pandas_udf("string")
    def refused(given: pd.Series) -> pd.Series:
        if given.notna().any():
            raise ValueError("a text in NFC was sent")
        return given

    monkeypatch.setattr(text_fn, "nfc", refused)
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts[:3]], "t string").select(text_fn.normalized(F.col("t"))).collect()] == want[:3]
    assert all(unicodedata.is_normalized("NFC", chr(k)) and not unicodedata.combining(chr(k)) for k in range(0x300))


def test_bounds_visible_estimate(spark):
    df = spark.createDataFrame([("[1,2][3,-4]", "No "), ("x", None)], "b string, v string")
    assert [tuple(r) for r in df.select(text_fn.bounds(F.col("b")), text_fn.visible(F.col("v"))).collect()] == [([1, 2, 3, -4], False), ([0, 0, 0, 0], True)]
    t = spark.createDataFrame([("abcd",), ("漢字",), ("éé",), ("ab漢é",), ("",)], "t string")
    assert [r[0] for r in t.select(text_fn.token_estimate(F.col("t"))).collect()] == [2, 2, 1, 3, 0]
