"""What a run delivers: blocks, rejects, traces, gates by class, the schema check, accounts, a dry run; and what a live run honours."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.functions.text import record_id
from millrace.plans import config
from millrace.plans.live import run_live
from millrace.plans.run import Verdicts, run, unsupported

TEXTS = [f"{a} {b} {k}" for k, (a, b) in enumerate((a, b) for a in ("river", "castle", "engine") for b in ("tale of a long winter", "song about bread and salt", "note on seven old maps", "list of quiet harbours"))]
CLASSES = '[classify]\nenabled = true\nclasses = ["a", "b", "c"]\nfallback_class = "c"\n'
SCHEMA = '[output.schema]\ntype = "object"\nrequired = ["topic"]\n[output.schema.properties.topic]\ntype = "string"\npattern = "^t"\n'


def project(tmp_path, more=""):
    (tmp_path / "in").mkdir(exist_ok=True)
    lines = [json.dumps({"text": t, "lang": "en", "a.b": [1, None], "none": None}) for t in TEXTS]
    (tmp_path / "in" / "x.jsonl").write_text("\n".join([*lines, lines[0], "{", '{"y": 1}']))
    return f'[run]\ninput = "{tmp_path}/in"\noutput = "{tmp_path}/out"\nmodality = "text"\n{more}'


def read(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


@pytest.fixture
def ids(spark):
    raw = F.to_json(F.try_parse_json("line"))
    rows = [(k, t, json.dumps({"text": t, "lang": "en", "a.b": [1, None], "none": None})) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "k long, text string, line string").select("k", "text", record_id(raw).alias("id")).cache()


def verdicts(spark, ids, **more):
    label = F.when(F.col("k") < 4, "a").when(F.col("k") < 8, "b").otherwise("?")
    labels = ids.select("id", label.alias("label"))
    scores = ids.select("id", F.explode(F.array(F.lit("depth"), F.lit("form"))).alias("criterion"), F.lit(1.0).alias("weight"), F.when(F.col("k") != 11, F.col("k") % 4 / 4.0).alias("score"))
    return Verdicts(labels=labels.union(labels), scores=scores.union(scores), **more)  # every verdict comes twice


def test_gates_of_classes_side_by_side(spark, tmp_path, ids):
    """Class a by a threshold of its own, b by a share, c as the project says; repeated verdicts multiply nothing."""
    text = project(tmp_path, '[annotate]\nenabled = false\n[quality]\nthreshold = 0.5\non_unscored = "drop"\n' + CLASSES + "[class.a.quality]\nthreshold = 0.7\n[class.b.quality]\nselection = \"top_ratio\"\ntop_ratio = 0.3\n")
    told = run(spark, config.load(text), verdicts(spark, ids))
    want = {TEXTS[k] for k in (3, 6, 7, 10)}  # a: 0.75 alone; b: the best two of four; c: 0.5 of 0, 0.25, 0.5, none
    rows = read(tmp_path / "out" / "main")
    assert {r["text"] for r in rows} == want and len(rows) == 4
    counts = told["counts"]
    assert counts["balanced"] and (counts["active"], counts["dropped_lowq"], counts["dropped_dup"], counts["bad_input"], counts["scanned"]) == (4, 8, 1, 2, 15)
    assert told["bad"] == {"not_json": 1, "no_text": 1} and told["rejected"] == {"exact": 1, "below_threshold": 6, "top_ratio": 2} and sum(told["quality"]) == 11
    reasons = {(r["_meta"]["label"], r["_meta"]["reason"]) for r in read(tmp_path / "out" / "rejects")}
    assert ("b", "top_ratio") in reasons and ("a", "below_threshold") in reasons and ("b", "below_threshold") not in reasons


def test_meta_and_passed_fields(spark, tmp_path, ids):
    text = project(tmp_path, '[annotate]\nenabled = false\n[output]\npassthrough_fields = ["lang", "a.b", "none", "gone"]\n' + CLASSES)
    run(spark, config.load(text), verdicts(spark, ids))
    rows = {r["text"]: r["_meta"] for r in read(tmp_path / "out" / "main")}
    m = rows[TEXTS[5]]
    assert list(m) == ["id", "run", "source", "stream", "scores", "dedup", "classification", "annotation", "verification"]
    assert m["source"] == {"file": "x.jsonl", "line_no": 6, "generated_from": [], "fields": {"lang": "en", "a.b": [1, None], "none": None}}
    assert m["scores"] == {"depth": 0.25, "form": 0.25, "__aggregate__": 0.25, "mode": "pairwise", "batch_no": 1, "pool": "b"}
    assert m["dedup"]["kind"] == "unique" and m["classification"] == {"label": "b"} and m["stream"] is None and m["verification"] is None
    assert rows[TEXTS[9]]["classification"] == {"label": "c"} and rows[TEXTS[11]]["scores"]["depth"] is None


def test_what_breaks_the_schema_isn_t_delivered(spark, tmp_path, ids):
    output = F.when(F.col("k") == 2, '{"topic": 3}').when(F.col("k") == 3, '{"topic": "x"}').when(F.col("k") == 4, F.lit(None)).otherwise('{"topic": "t"}')
    outputs = ids.select("id", output.alias("output"), F.when(F.col("k") == 4, "schema_violation").alias("problem"), F.when(F.col("k") == 4, F.array(F.lit("/: no object"))).alias("problems"))
    text = project(tmp_path, "[quality]\nenabled = false\n[trace]\nenabled = true\nchannels = [\"dedup\"]\n[output]\nrejects = \"full\"\nmeta_mode = \"sidecar\"\n" + SCHEMA)
    told = run(spark, config.load(text), Verdicts(outputs=outputs))
    assert told["rejected"] == {"exact": 1, "schema_violation": 1, "internal_error": 2} and told["counts"]["failed"] == 3 and told["counts"]["balanced"]
    assert read(tmp_path / "out" / "main") == [{"topic": "t"}] * 9 and len(read(tmp_path / "out" / "meta")) == 9
    rejects = {r["record"]["text"]: r for r in read(tmp_path / "out" / "rejects")}
    assert rejects[TEXTS[2]]["_meta"]["errors"] == ["/topic: string expected"] and rejects[TEXTS[3]]["_meta"]["errors"] == ["/topic: ^t doesn't match"]
    assert rejects[TEXTS[4]]["_meta"]["errors"] == ["/: no object"] and "raw_last_output" in rejects[TEXTS[4]]
    events = read(tmp_path / "out" / "trace")
    assert sorted(e["ev"] for e in events) == ["dedup.duplicate", "error", "error", "error"]


def test_schemas_are_checked_before_a_run(tmp_path):
    with pytest.raises(config.ConfigError, match="output.schema: patern isn't known"):
        config.load(project(tmp_path, SCHEMA.replace("pattern", "patern")))


def test_dry_run(spark, tmp_path, capsys):
    (tmp_path / "p.toml").write_text(project(tmp_path).replace("[run]\n", "[run]\nbatch_size = 5\n"))
    assert main(["run", str(tmp_path / "p.toml"), "--dry-run"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["records"], told["batches"], told["bad"]) == (13, 3, {"not_json": 1, "no_text": 1}) and told["calls"]["annotate_calls"] == 13
    assert not (tmp_path / "out").exists()


def rule(log):
    """Made here, so that tasks needn't import this module."""

    class Rule:
        """Answers by rule and counts prompts in a folder, as tasks share no memory."""

        def __init__(self, log):
            self.log = log

        def answer(self, prompts):
            import uuid

            (self.log / uuid.uuid4().hex).write_text("\n\0".join(prompts))
            return [self.one(p) for p in prompts]

        def one(self, prompt):
            if prompt.startswith("Name the class"):
                return '{"class": "a"}' if "river" in prompt else '{"class": "b"}'
            if prompt.startswith("Compare"):
                names = prompt.split("each of: ")[1].split(".\n")[0].split(", ")
                return json.dumps({"judgments": [{"criterion": n, "winner": "tie"} for n in names]})
            if prompt.startswith("Say what is wrong"):
                return json.dumps({"critiques": [], "verdict": "pass"})
            return json.dumps({"topic": "t river" if prompt.startswith("Rivers!") else "t"})

    return lambda: Rule(log)


def test_a_live_run_honours_its_settings(spark, tmp_path):
    (tmp_path / "log").mkdir()
    text = project(tmp_path, '[annotate]\ninstruction = "Others!"\n[quality]\nrounds = 2\njudges = ["x", "y", "z"]\nboth_orders = true\n[verify]\nenabled = true\njudges = ["u", "v", "w"]\n[output]\nmax_repair_attempts = 1\n' + SCHEMA + CLASSES + 'self_consistency = 3\n[class.a.annotate]\ninstruction = "Rivers!"\n').replace("[run]\n", "[run]\nseed = 7\n")
    log = tmp_path / "log"
    told = run_live(spark, config.load(text), rule(log))
    assert told["counts"]["active"] == 12 and told["counts"]["balanced"]
    prompts = [p for f in log.iterdir() for p in f.read_text().split("\n\0")]
    count = lambda head: sum(p.startswith(head) for p in prompts)
    assert count("Name the class") == 36 and count("Say what is wrong") == 36 and count("Rivers!") == 4 and count("Others!") == 8
    assert count("Compare") == 2 * 3 * 2 * (4 // 2 + 8 // 2)  # rounds, judges, orders, pairs of the two classes
    topics = {r["_meta"]["classification"]["label"]: r["topic"] for r in read(tmp_path / "out" / "main")}
    assert topics == {"a": "t river", "b": "t"}


def test_a_live_run_refuses_before_its_first_call(spark, tmp_path):
    (tmp_path / "log").mkdir()
    loaded = config.load(project(tmp_path, "[annotate]\nself_consistency = 3\n"))
    assert unsupported(loaded, live=True) == ["annotate.self_consistency: not honoured by run"]
    with pytest.raises(config.ConfigError):
        run_live(spark, loaded, rule(tmp_path / "log"))
    assert not list((tmp_path / "log").iterdir())
    mine = config.load(project(tmp_path, '[annotate]\ninstruction = "i"\n'))
    assert unsupported(mine, live=True) == [] and unsupported(mine) == ["annotate.instruction: not honoured by run"]
