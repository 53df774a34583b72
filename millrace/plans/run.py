"""A run over text records: ingest, dedup, classes, scores and gates, routing, accounts."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.functions import text as text_fn
from millrace.functions.text import record_id
from millrace.operators import dedup, quality
from millrace.plans import estimate
from millrace.plans.config import SECTIONS, Config, ConfigError
from millrace.plans.rubrics import RUBRICS
from millrace.runtime import Written, written
from millrace.sinks import blocks, emit, trace
from millrace.sources import jsonl

#: What a run over text records reads; the last three lines are without effect on texts or without their stage.
HONOURED = {
    "run": ("input", "output", "modality", "batch_size"), "input": ("text_field", "on_bad_line", "on_missing_pair", "on_index_conflict", "max_image_mb", "ui_tree_max_chars"),
    "classify": ("enabled", "fallback_class", "classes"), "quality": ("enabled", "mode", "threshold", "selection", "top_ratio", "on_unscored"),
    "annotate": ("enabled",), "verify": ("enabled",), "output": ("schema", "meta_mode", "passthrough_fields", "rejects"), "trace": tuple(SECTIONS["trace"]),
    "dedup": ("enabled", "scope", "minhash_threshold", "minhash_num_perm", "ngram", "image_phash_max_distance", "ui_dup_requires", "bounds_quantize_px", "semantic_threshold"),
    "stream": tuple(SECTIONS["stream"]),
}
#: What a live judge reads besides.
LIVE = {
    "run": ("seed",), "classify": ("self_consistency", "on_error"), "quality": ("rounds", "judges", "both_orders"), "annotate": ("instruction",), "verify": ("judges",), "output": ("max_repair_attempts",),
}
#: What a class may set for itself in a run, and besides with a live judge.
OF_CLASS, OF_CLASS_LIVE = {"quality": ("threshold", "selection", "top_ratio", "on_unscored")}, {"annotate": ("instruction",)}
#: The table that each judged stage needs.
JUDGED = {"classify": "labels", "quality": "scores", "annotate": "outputs", "verify": "reviews"}


def unsupported(config: Config, live: bool = False) -> list[str]:
    """Faults: settings in force that a run doesn't honour."""
    reads = lambda table, more, name: (*table.get(name, ()), *(more.get(name, ()) if live else ()))
    faults = [] if config["run"]["modality"] == "text" else ["run.modality: runs take text only"]
    for name, keys in SECTIONS.items():
        own = config[name]
        if own.get("enabled", True):
            faults += [f"{name}.{k}: not honoured by run" for k, default in keys.items() if k not in reads(HONOURED, LIVE, name) and own[k] != default]
    if not isinstance(config["output"]["schema"], (dict, type(None))):
        faults.append("output.schema: not honoured by run")
    return faults + [f"class.{c}.{s}.{k}: not honoured by run" for c, sections in config.classes.items() for s, own in sections.items() for k in own if k not in reads(OF_CLASS, OF_CLASS_LIVE, s)]


@dataclass
class Verdicts:
    """Tables of a run's judges, all keyed by record id; None where a stage isn't judged.

    labels: (id, label). scores: (id, criterion, weight, score). outputs: (id, output, problem). reviews: (id, verdict).
    Of rows that repeat a key the one that sorts first counts, so that no record is multiplied.
    """

    labels: DataFrame | None = None
    scores: DataFrame | None = None
    outputs: DataFrame | None = None
    reviews: DataFrame | None = None

    def missing(self, config: Config) -> list[str]:
        """Enabled stages without their table."""
        return [s for s, t in JUDGED.items() if config[s]["enabled"] and getattr(self, t) is None]


def ingest(spark: SparkSession, config: Config, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bad rows): seq, id, text, raw, source_file, line_no, batch_no."""
    lines = jsonl.classify_lines(jsonl.read_lines(spark, config["run"]["input"]), config["input"]["text_field"])
    good, bad = jsonl.records(lines, config["input"]["on_bad_line"], limit)
    rows = good.withColumn("id", record_id(F.to_json(F.try_parse_json("line")))).withColumnRenamed("line", "raw").drop("bad")
    return written(jsonl.batches(rows, ["source_file", "line_no"], config["run"]["batch_size"]), "records"), bad


def first_of(verdicts: DataFrame, key: list[str], *fields: str) -> DataFrame:
    """One row a key: of repeated verdicts the one that sorts first."""
    own = verdicts.groupBy(*key).agg(F.min(F.struct(*fields)).alias("_first"))
    return own.select(*key, *[F.col("_first")[f].alias(f) for f in fields])


def deduplicated(records: DataFrame, config: Config) -> DataFrame:
    """`records` with kind, cluster_key, kept_id and status."""
    if config["dedup"]["enabled"]:
        d = config["dedup"]
        items = dedup.dedup(records, "seq", "id", "text", scope="batch_no" if d["scope"] == "batch" else None, threshold=d["minhash_threshold"], permutations=d["minhash_num_perm"], ngram=d["ngram"])
    else:
        items = records.withColumn("kind", F.lit("unique")).withColumn("cluster_key", F.lit(None).cast("string")).withColumn("kept_id", F.lit(None).cast("string"))
    return items.withColumn("status", F.when(F.col("kind") == "unique", "active").otherwise("dropped_dup"))


def class_settings(spark: SparkSession, config: Config) -> DataFrame:
    """(class, selection, threshold, top_ratio, on_unscored): a row for records without a class, and one for each class with what it takes over."""
    names = [c["name"] if isinstance(c, dict) else c for c in config["classify"]["classes"]]
    rows = []
    for name in dict.fromkeys([None, *names]):
        q = config.of_class(name, "quality")
        rows.append((name, q["selection"], None if q["threshold"] is None else float(q["threshold"]), None if q["top_ratio"] is None else float(q["top_ratio"]), q["on_unscored"]))
    return spark.createDataFrame(rows, "class string, selection string, threshold double, top_ratio double, on_unscored string")


def gated(items: DataFrame, settings: DataFrame) -> DataFrame:
    """`items` with selection, and status by the gate of their own class. Classes with a threshold and with a share stand side by side."""
    own = settings.select(F.col("class").alias("_class"), "selection", F.col("threshold").alias("_threshold"), F.col("top_ratio").alias("_ratio"), F.col("on_unscored").alias("_unscored"))
    rows = items.join(F.broadcast(own), F.col("label").eqNullSafe(F.col("_class")), "left")  # a row a class of the project
    ranked = quality.top_ratio(rows.where("status = 'active' and selection = 'top_ratio'").select("seq", "batch_no", "label", "aggregate", "id", "_ratio", "_unscored"), ["batch_no", "label"], "aggregate", "id", F.col("_ratio"), F.col("_unscored"))
    rows = rows.join(ranked.select("seq", F.col("status").alias("_gate")), "seq", "left")
    unscored = F.when(F.col("_unscored") == "keep", "active").otherwise("dropped_lowq")
    by_score = F.when(F.col("aggregate").isNull(), unscored).when(F.col("_threshold").isNull() | (F.col("aggregate") >= F.col("_threshold")), "active").otherwise("dropped_lowq")
    told = F.when(F.col("status") != "active", F.col("status")).when(F.col("selection") == "top_ratio", F.col("_gate")).otherwise(by_score)
    return rows.withColumn("status", told).drop("_class", "_threshold", "_ratio", "_unscored", "_gate")


def judged(items: DataFrame, config: Config, verdicts: Verdicts) -> DataFrame:
    """`deduplicated` rows with status, stage and reason, label, aggregate, output, verdict, errors. Rows never go, they change status."""
    spark = items.sparkSession
    fallback = config["classify"]["fallback_class"] or None
    if config["classify"]["enabled"] and verdicts.labels is not None:
        names = [c["name"] if isinstance(c, dict) else c for c in config["classify"]["classes"]]
        items = items.join(first_of(verdicts.labels, ["id"], "label"), "id", "left").withColumn("label", F.when(F.col("label").isin(names), F.col("label")).otherwise(F.lit(fallback)))
    else:
        items = items.withColumn("label", F.lit(None).cast("string"))
    q = config["quality"]
    if q["enabled"] and verdicts.scores is not None:
        total = quality.weighted_mean(first_of(verdicts.scores, ["id", "criterion"], "weight", "score"), ["id"], "score", "weight")
        items = gated(items.join(total, "id", "left"), class_settings(spark, config))
    else:
        items = items.withColumn("aggregate", F.lit(None).cast("double")).withColumn("selection", F.lit(q["selection"]))
    nothing = F.array().cast("array<string>")
    if config["annotate"]["enabled"] and verdicts.outputs is not None:
        more = ["problems"] if "problems" in verdicts.outputs.columns else []
        items = items.join(first_of(verdicts.outputs, ["id"], "output", "problem", *more), "id", "left")
        items = items.withColumn("errors", F.coalesce(F.col("problems"), nothing) if more else nothing).drop("problems")
        missing = (F.col("status") == "active") & (F.col("output").isNull())
        items = items.withColumn("status", F.when(missing, "failed").otherwise(F.col("status")))
        if isinstance(config["output"]["schema"], dict):
            items = checked(items, config["output"]["schema"])
    else:
        items = items.withColumn("output", blocks.raw_payload(F.lit("text"), F.col("raw"), F.lit(None), F.lit(None), nothing, nothing)).withColumn("problem", F.lit(None).cast("string")).withColumn("errors", nothing)
    if config["verify"]["enabled"] and verdicts.reviews is not None:
        items = items.join(first_of(verdicts.reviews, ["id"], "verdict"), "id", "left")
        items = items.withColumn("status", F.when((F.col("status") == "active") & (F.col("verdict") == "fail"), "dropped_verify").otherwise(F.col("status")))
    else:
        items = items.withColumn("verdict", F.lit(None).cast("string"))
    why = emit.reject_reason(F.col("status"), F.col("kind"), F.col("selection"), F.lit("segment"), F.lit("noise"), F.lit("annotate"), F.coalesce("problem", F.lit("schema_violation")))
    return items.withColumn("_w", why).select("*", "_w.stage", "_w.reason").drop("_w")


def checked(items: DataFrame, shape: dict) -> DataFrame:
    """`items` whose active outputs all fit the schema: others fail as internal errors, whoever made them."""
    told = F.when(F.col("status") == "active", shapes.fault_column(F.col("output"), shape))
    rows = items.withColumn("_faults", told)
    bad = F.size(F.coalesce("_faults", F.array().cast("array<string>"))) > 0
    rows = rows.withColumn("errors", F.when(bad, F.col("_faults")).otherwise(F.col("errors"))).withColumn("problem", F.when(bad, "internal_error").otherwise(F.col("problem")))
    return rows.withColumn("status", F.when(bad, "failed").otherwise(F.col("status"))).drop("_faults")


def process(records: DataFrame, config: Config, verdicts: Verdicts) -> DataFrame:
    """`records` deduplicated and judged."""
    return judged(deduplicated(records, config), config, verdicts)


class Accounts:
    """What a run tells of itself, observed on the rows as they are written, so that it takes no pass of its own."""

    def __init__(self):
        self.seen = Observation("accounts")

    def on(self, items: DataFrame) -> DataFrame:
        scored = F.col("aggregate").isNotNull() & (F.col("kind") == "unique")
        bucket = F.least(F.floor(F.col("aggregate") * 10), F.lit(9))
        known = [F.count_if(F.col("status") == s).alias(s) for s in emit.STATUSES]
        kinds = [F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS]
        reasons = [F.count_if(F.col("reason") == r).alias(f"reason_{r}") for r in REASONS]
        return items.observe(self.seen, F.count("*").alias("rows"), *known, *kinds, *reasons, *[F.count_if(scored & (bucket == k)).alias(f"b{k}") for k in range(10)])

    def told(self, bad: dict[str, int]) -> dict:
        got = self.seen.get
        counts = {s: got[s] for s in emit.STATUSES}
        n_bad = sum(bad.values())
        shown = counts | {"unknown": got["rows"] - sum(counts.values()), "bad_input": n_bad, "scanned": got["rows"] + n_bad, "ingested": got["rows"], "generated": 0, "emitted": counts["active"]}
        shown["balanced"] = shown["unknown"] == 0 and sum(counts.values()) + n_bad == shown["scanned"]
        return {
            "counts": shown, "bad": bad, "kinds": {k: got[f"kind_{k}"] for k in KINDS if got[f"kind_{k}"]},
            "rejected": {r: got[f"reason_{r}"] for r in REASONS if got[f"reason_{r}"]}, "quality": [got[f"b{k}"] for k in range(10)],
        }


#: Kinds of records, and why rows are rejected; both are closed.
KINDS = ("unique", "exact", "near_text")
REASONS = (*KINDS[1:], "below_threshold", "top_ratio", "verify_fail", "schema_violation", "internal_error")


def bad_lines(bad: DataFrame) -> dict[str, int]:
    """Bad lines by what is wrong with them: a handful of kinds."""
    return {r["bad"]: r["count"] for r in bad.groupBy("bad").count().collect()}


def blocks_of(items: DataFrame, config: Config, verdicts: Verdicts) -> DataFrame:
    """`items` with source, meta and reject as JSON, every block of the stages that ran."""
    q = config["quality"]
    if q["enabled"] and verdicts.scores is not None:
        told = first_of(verdicts.scores, ["id", "criterion"], "score")
        per = items.where("status = 'active'").select("seq", "id", "aggregate", "batch_no", "label").join(told, "id")
        items = items.join(blocks.scores(per, ["seq"], q["mode"], "label"), "seq", "left")
    else:
        items = items.withColumn("scores", F.lit(None).cast("string"))
    spelt = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    names = config["output"]["passthrough_fields"]
    none = F.lit(None).cast("long")
    place = blocks.source(F.col("source_file"), F.col("line_no"), none)
    whole = blocks.source(F.col("source_file"), F.col("line_no"), none, fields=text_fn.passed_through(F.col("raw"), names) if names else None)
    run_ = F.lit(json.dumps({"tool": "millrace", "config": config.digest, "mode": config["run"]["mode"]}))
    own = {"scores": F.col("scores")}
    if config["dedup"]["enabled"]:
        own["dedup"] = spelt("kind", "cluster_key", "kept_id")
    if config["classify"]["enabled"]:
        own["classification"] = spelt("label")
    if config["annotate"]["enabled"] and verdicts.outputs is not None:
        own["annotation"] = spelt("problem")
    if config["verify"]["enabled"] and verdicts.reviews is not None:
        own["verification"] = spelt("verdict")
    full = config["output"]["rejects"] == "full"
    reject = blocks.reject(F.col("id"), place, F.col("stage"), F.col("reason"), F.col("errors"), F.col("label") if config["classify"]["enabled"] else None, F.col("raw") if full else None, F.col("output") if full else None)
    return items.withColumn("meta", blocks.meta(F.col("id"), run_, whole, **own)).withColumn("reject", reject).drop("scores")


def run(spark: SparkSession, config: Config, verdicts: Verdicts | None = None, limit: int | None = None, strict: bool = False, live: bool = False, prepared: tuple[DataFrame, dict[str, int]] | None = None) -> dict:
    """Process the input, deliver main, rejects and trace, return the report.

    Settings that a run doesn't honour are a ConfigError. So are enabled stages without their table, where no
    verdicts are given or `strict` is set; elsewhere the report names them as not judged. prepared: deduplicated
    records and counts of bad lines, where they are there already.
    """
    began = time.time()
    if faults := unsupported(config, live):
        raise ConfigError(faults)
    given = verdicts or Verdicts()
    not_judged = given.missing(config)
    missing = ConfigError([f"{s}: enabled, but no {JUDGED[s]} are given" for s in not_judged]) if not_judged and (strict or verdicts is None) else None
    base, bad = prepared or prepare(spark, config, limit, missing)
    accounts, out, mode = Accounts(), config["run"]["output"], config["output"]["meta_mode"]
    items = Written(accounts.on(blocks_of(judged(base, config, given), config, given)), "items")
    kept = items.df.where("status = 'active'")
    emit.deliver(kept.select(emit.main_row(F.col("output"), F.col("meta"), mode, spelt=True).alias("value")), f"{out}/main", text=True)
    if mode == "sidecar":
        emit.deliver(kept.select("meta"), f"{out}/meta", text=True)
    emit.deliver(items.df.where(emit.channel(F.col("status")) == "rejects").select("reject"), f"{out}/rejects", text=True)
    t = config["trace"]
    if t["enabled"]:
        trace.deliver(trace.of_items(items.df), t["path"] or f"{out}/trace", t["channels"], t["content"])
    told = accounts.told(bad)
    clusters = items.df.where("kind <> 'unique'").agg(F.countDistinct("cluster_key")).first()[0]
    told = {"config": config.digest, "counts": told["counts"], "bad": told["bad"], "dedup": {"kinds": told["kinds"], "clusters": clusters}, "rejected": told["rejected"], "quality": told["quality"], "not_judged": not_judged}
    told["seconds"] = round(time.time() - began, 3)
    emit.deliver(spark.range(1).select(F.lit(json.dumps(told, ensure_ascii=False)).alias("value")), f"{out}/report", text=True)
    items.drop()
    return told


def prepare(spark: SparkSession, config: Config, limit: int | None = None, fault: ConfigError | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(deduplicated records, counts of bad lines), written, so that a run reads and deduplicates its input once.

    fault: raised once the input is known to hold something, before anything is made of it.
    """
    records, bad = ingest(spark, config, limit)
    jsonl.require_some(records)
    if fault:
        raise fault
    return written(deduplicated(records, config), "deduplicated"), bad_lines(bad)


def dry_run(spark: SparkSession, config: Config, limit: int | None = None) -> dict:
    """What a run would take in, and the calls that it would make at most, without a call and without output."""
    records, bad = ingest(spark, config, limit)
    n, batches = records.agg(F.count("*"), F.coalesce(F.max("batch_no"), F.lit(0))).first()
    q, c, v, a = (config[s] for s in ("quality", "classify", "verify", "annotate"))
    setting = estimate.Run(
        batch_size=config["run"]["batch_size"], pairwise_rounds=q["rounds"] if q["enabled"] and q["mode"] == "pairwise" else 0, pairwise=q["mode"] == "pairwise", criteria=len(RUBRICS[config["run"]["modality"]]) if q["enabled"] else 0,
        judges=max(1, len(q["judges"])), both_orders=q["both_orders"], classify=c["enabled"], classify_samples=c["self_consistency"], annotate=a["enabled"], annotate_samples=a["self_consistency"], verify=v["enabled"], verify_judges=max(1, len(v["judges"])),
    )
    return {"records": n, "batches": batches, "bad": bad_lines(bad), "calls": estimate.estimate(n, setting)}
