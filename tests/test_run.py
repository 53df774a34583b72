import json

import pytest

from millrace.__main__ import main
from millrace.plans import config
from millrace.plans.run import Verdicts, run, unsupported
from millrace.plans.rubrics import RUBRICS, criteria

TEXTS = ["how do I bake bread at home without an oven", "how do I bake bread at home without an oven", "tell me a story about a lighthouse keeper", "xx", "plan a trip of three days to the mountains"]


def project(tmp_path, more=""):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([json.dumps({"text": t}) for t in TEXTS] + ["broken"]))
    return f'[run]\ninput = "{tmp_path}/in"\noutput = "{tmp_path}/out"\nmodality = "text"\n{more}'


def read(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_run_accounts_for_every_row(spark, tmp_path):
    c = config.load(project(tmp_path, "[quality]\nthreshold = 0.5\n"))
    from pyspark.sql import functions as F

    from millrace.functions.text import record_id

    ids = spark.createDataFrame([(t,) for t in TEXTS], "text string").distinct().select(record_id(F.to_json(F.struct("text"))).alias("id"), "text")
    scores = ids.where("text <> 'xx'").select("id", F.lit("clarity").alias("criterion"), F.lit(1.0).alias("weight"), F.when(F.col("text").contains("story"), 0.2).otherwise(0.9).alias("score"))
    told = run(spark, c, Verdicts(scores=scores))
    assert told["counts"]["balanced"] and told["counts"]["bad_input"] == 1
    assert (told["counts"]["active"], told["counts"]["dropped_dup"], told["counts"]["dropped_lowq"]) == (3, 1, 1)
    main_rows, rejects = read(tmp_path / "out" / "main"), read(tmp_path / "out" / "rejects")
    assert len(main_rows) == 3 and all(r["_meta"]["source"]["file"] == "a.jsonl" for r in main_rows)
    assert sorted((r["_meta"]["stage"], r["_meta"]["reason"]) for r in rejects) == [("dedup", "exact"), ("quality", "below_threshold")]
    assert read(tmp_path / "out" / "report")[0]["quality"][9] == 2


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "p.toml").write_text(project(tmp_path))
    assert main(["validate", str(tmp_path / "p.toml")]) == 0
    assert main(["validate", str(tmp_path / "none.toml")]) == 2
    assert main(["rubric", "ui"]) == 0 and main(["estimate", "14"]) == 0
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.jsonl").write_text("")
    assert main(["run", str(tmp_path / "p.toml"), "--input", str(tmp_path / "empty")]) == 3
    assert "valid" in capsys.readouterr().out


def test_rubrics(spark):
    assert all(len(c) == 4 for c in RUBRICS.values()) and criteria(spark, "ui").where("weight > 1").count() == 1


CLASSES = '[classify]\nenabled = true\nclasses = ["a", "b"]\nfallback_class = "b"\n'
IGNORED = {
    "dedup.semantic": "[dedup]\nsemantic = true\n", "segment.enabled": "[segment]\nenabled = true\n", "generate.enabled": "[generate]\nenabled = true\n",
    "classify.assignment": CLASSES + 'assignment = "multi"\n', "classify.self_consistency": CLASSES + "self_consistency = 3\n", "annotate.self_consistency": "[annotate]\nself_consistency = 3\n",
    "verify.policy": '[verify]\nenabled = true\npolicy = "repair"\n', "class.a.quality.rubric": CLASSES + '[class.a.quality]\nrubric = "r"\n', "output.schema": '[output]\nschema = "x"\n',
    "stitch.enabled": "[segment]\nenabled = true\n[stitch]\nenabled = true\n",
}


@pytest.mark.parametrize("name", IGNORED)
def test_settings_that_a_run_ignores_are_errors(name):
    assert f"{name}: not honoured by run" in unsupported(config.load('[run]\ninput = "i"\noutput = "o"\nmodality = "text"\n' + IGNORED[name]))


def test_other_modes_are_errors_and_the_rest_is_not():
    assert unsupported(config.load('[run]\ninput = "i"\noutput = "o"\nmodality = "ui"\n')) == ["run.modality: runs take text only"]
    only = config.load('[run]\noutput = "o"\nmodality = "text"\nmode = "generate_only"\n[generate]\nenabled = true\n')
    assert "run.mode: not honoured by run" in unsupported(only)
    fine = '[run]\ninput = "i"\noutput = "o"\nmodality = "text"\nbatch_size = 7\n[dedup]\nscope = "batch"\nngram = 3\n[verify]\nenabled = true\n[stitch]\nmax_open = 9\n' + CLASSES
    assert unsupported(config.load(fine)) == []


def test_scope_batch(spark, tmp_path):
    text = project(tmp_path).replace("[run]\n", "[run]\nbatch_size = 1\n")
    assert run(spark, config.load(text), Verdicts())["dedup"]["kinds"] == {"unique": 4, "exact": 1}
    told = run(spark, config.load(text + '[dedup]\nscope = "batch"\n'), Verdicts())
    assert told["dedup"]["kinds"] == {"unique": 5} and told["not_judged"] == ["quality", "annotate"]


def test_cli_takes_verdicts(spark, tmp_path, capsys):
    (tmp_path / "p.toml").write_text(project(tmp_path, "[quality]\nthreshold = 0.5\n"))
    assert main(["run", str(tmp_path / "p.toml")]) == 2
    assert capsys.readouterr().err.splitlines() == ["quality: enabled, but no scores are given", "annotate: enabled, but no outputs are given"]
    from pyspark.sql import functions as F

    from millrace.functions.text import record_id

    ids = spark.createDataFrame([(t,) for t in TEXTS], "text string").distinct().select(record_id(F.to_json(F.struct("text"))).alias("id"), "text")
    ids.select("id", F.lit("c").alias("criterion"), F.lit(1.0).alias("weight"), F.when(F.col("text") == "xx", 0.1).otherwise(0.9).alias("score")).write.parquet(str(tmp_path / "scores"))
    ids.select("id", F.lit("{}").alias("output"), F.lit(None).cast("string").alias("problem")).write.parquet(str(tmp_path / "outputs"))
    assert main(["run", str(tmp_path / "p.toml"), "--scores", str(tmp_path / "scores"), "--outputs", str(tmp_path / "outputs")]) == 0
    counts = json.loads(capsys.readouterr().out)["counts"]
    assert (counts["active"], counts["dropped_dup"], counts["dropped_lowq"]) == (3, 1, 1)
