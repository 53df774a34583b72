import pytest
from pyspark.sql import functions as F

from millrace.functions import fit
from millrace.operators import review
from millrace.plans import config

BASE = '[run]\ninput = "in"\noutput = "out"\nmodality = "text"\n'


def test_defaults_and_stages():
    c = config.load(BASE, "[verify]\nenabled = true\n")
    assert c["dedup"]["minhash_threshold"] == 0.85 and c.stages() == ["dedup", "quality", "annotate", "verify"]
    assert c.digest != config.load(BASE).digest == config.load(BASE).digest


def test_every_fault_at_once():
    with pytest.raises(config.ConfigError) as e:
        config.load('[run]\nmodality = "x"\nbatch_size = true\n[dedup]\nfoo = 1\n[what]\n[stitch]\nenabled = true\n')
    told = e.value.faults
    assert {t.split(":")[0] for t in told} == {"dedup.foo", "run.batch_size", "run.input", "run.modality", "run.output", "stitch", "what"}


def test_class_takes_over_selection():
    c = config.load(BASE + '[classify]\nenabled = true\nclasses = ["a", "b"]\nfallback_class = "b"\n[quality]\nthreshold = 0.5\n[class.a.quality]\nselection = "top_ratio"\ntop_ratio = 0.2\n')
    assert c.of_class("a", "quality")["threshold"] is None and c.of_class("b", "quality")["threshold"] == 0.5
    with pytest.raises(config.ConfigError):
        config.load(BASE + "[class.z.quality]\nrounds = 2\n")


def test_fit_text():
    text = "\n".join(f"line {k}" for k in range(20))
    assert fit.fitted(text, 10_000) == text
    head = fit.fitted(text, 12)
    assert text.startswith(head) and fit.estimate(head) <= 12 < fit.estimate(text[: len(head) + 8])
    edges = fit.fitted(text, 20, "edges")
    assert edges.startswith("line 0\n") and edges.endswith("\nline 19") and "truncated" in edges and fit.estimate(edges) <= 20
    assert fit.fitted(edges, 20, "edges") == edges and fit.fitted(text, 1, "edges") == "…(truncated 20 lines)"


def test_repair():
    assert fit.repaired('so: ```{"a": 1}``` done') == ({"a": 1}, False)
    assert fit.repaired('{"a": [1, 2], "b": "cut of') == ({"a": [1, 2], "b": "cut of"}, False)
    assert fit.repaired("nothing") == (None, False)


def test_calibration(spark):
    df = spark.createDataFrame([(1, 80.0)] * 8 + [(2, 100.0), (3, 10.0)], "b long, c double")
    got = {r["b"]: r["image_cost"] for r in fit.calibrated_image_cost(df, "b", "c", 100).collect()}
    assert got == {1: 120, 2: 95, 3: 118}


def test_review_rounds(spark):
    items = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "awful")], "k long, output string")
    judge = lambda df, _: df.select("k", F.when(F.col("output") == "good", "pass").otherwise("fail").alias("verdict"), F.lit("why").alias("critique"))
    fix = lambda df: df.withColumn("output", F.when(F.col("output") == "awful", "bad").otherwise("good"))
    got = {r["k"]: (r["verdict"], r["rounds"], len(r["critiques"])) for r in review.review(items, judge, fix, "k", "repair", 1).collect()}
    assert got == {1: ("pass", 0, 0), 2: ("pass", 1, 1), 3: ("fail", 1, 2)}
    assert {r["verdict"] for r in review.review(items, judge, fix, "k").collect()} == {"pass", "fail"}


def test_routes(spark):
    df = spark.createDataFrame([("label_mismatch", False), ("off_task_members", False), ("missing_head", False), ("missing_tail", True), ("wrong_stitch", False)], "k string, s boolean")
    assert [r[0] for r in df.select(review.defect_route(F.col("k"), F.col("s"), F.lit(False))).collect()] == ["reannotate", "shrink", "reclaim", "mark", "mark"]
    m = spark.createDataFrame([([1, 2], [2]), ([1], [1])], "m array<int>, o array<int>")
    assert [r[0] for r in m.select(review.shrunk(F.col("m"), F.col("o"))).collect()] == [[1], [1]]
