"""A run with a live judge: each stage asks about what the stages before it left, and its answers become a verdict table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import shapes
from millrace.judges import Judge
from millrace.operators import quality
from millrace.plans import calls
from millrace.plans.config import Config, ConfigError
from millrace.plans.rubrics import RUBRICS
from millrace.plans.run import Verdicts, judged, prepare, run, unsupported
from millrace.runtime import Written

Make = Callable[[], Judge]
#: Shape of an output where the project names none.
ANY_OBJECT = {"type": "object"}


def _asked(plan: DataFrame, make: Make, key: list[str], shape: dict, repairs: int) -> DataFrame:
    """`plan` with `answer`: the object in shape, or null."""
    got = calls.answered(plan, make, key, shape, repairs)
    return plan.drop("prompt").join(got.select(*key, F.col("output").alias("answer"), "problems"), key)


def labels(active: DataFrame, config: Config, make: Make) -> DataFrame:
    """(id, label) by the classes of the project, several samples voting where it asks for them."""
    c = config["classify"]
    classes = [x if isinstance(x, dict) else {"name": x} for x in c["classes"]]
    names, n = [x["name"] for x in classes], max(1, c["self_consistency"])
    items = active.select("id", "text").withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    plan = calls.class_calls(items, ["id", "sample"], "text", classes)
    answers = _asked(plan, make, ["id", "sample"], shapes.classes(names), config["output"]["max_repair_attempts"])
    told = calls.class_verdicts(answers, ["id"], names, c["fallback_class"], samples=n, on_error=c["on_error"])
    return told.select("id", F.get("labels", 0).alias("label"))


def scores(active: DataFrame, config: Config, make: Make) -> DataFrame:
    """(id, criterion, weight, score): points, or percentiles of pairwise strengths in each batch's classes."""
    q, rubric = config["quality"], RUBRICS[config["run"]["modality"]]
    repairs = config["output"]["max_repair_attempts"]
    if q["mode"] == "pointwise":
        plan = calls.score_calls(active, ["id"], "text", list(rubric))
        parts = [_asked(plan.where(F.col("criterion") == c), make, ["id", "criterion", "weight"], shapes.points(c), repairs) for c, _, _ in rubric]
        answers = parts[0]
        for p in parts[1:]:
            answers = answers.unionByName(p)
        return calls.scores(answers, ["id"])
    names, pool = [c for c, _, _ in rubric], ["batch_no", "label"]
    items = active.select("id", "text", "batch_no", F.coalesce("label", F.lit("")).alias("label"))
    plan = quality.pairing_plan(items, pool, "id", q["rounds"], config["run"]["seed"])
    asked = calls.comparison_calls(plan, items, pool, "id", "text", names, q["judges"] or None, q["both_orders"])
    key = [*pool, "round", "first", "second", "judge", "flipped"]
    judged = calls.comparisons(_asked(asked, make, key, shapes.comparison(names), repairs), pool, names)
    fitted = quality.fit_pools(judged.where("winner is not null"), [*pool, "criterion"])
    every = items.select("id", *pool, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(w).alias("weight")) for c, w, _ in rubric])).alias("c")).select("id", *pool, "c.*")
    ranked = every.join(fitted.select(F.col("item").alias("id"), *pool, "criterion", "log_strength"), ["id", *pool, "criterion"], "left")
    known = ranked.withColumn("_pct", quality.percentile(F.col("log_strength"), [*pool, "criterion"]))  # a class of one batch
    return known.select("id", "criterion", "weight", F.when(F.col("log_strength").isNotNull(), F.col("_pct")).alias("score"))


def outputs(active: DataFrame, config: Config, make: Make, shape: dict) -> DataFrame:
    """(id, output, problem, problems) by the instruction of each record's class and the project's shape."""
    by_class = {name: told for name in config.classes if (told := config.of_class(name, "annotate")["instruction"]) != config["annotate"]["instruction"]}
    plans = [(F.col("label") == name, told) for name, told in by_class.items()]  # the project's classes
    plans.append((~F.coalesce(F.col("label").isin(*by_class), F.lit(False)) if by_class else F.lit(True), config["annotate"]["instruction"]))
    plan = None
    for own, told in plans:
        part = calls.annotation_calls(active.where(own), ["id"], "text", told, shape)
        plan = part if plan is None else plan.unionByName(part)
    got = calls.answered(plan, make, ["id"], shape, config["output"]["max_repair_attempts"])
    return got.select("id", "output", F.when(F.col("output").isNull(), "schema_violation").alias("problem"), "problems")


def reviews(active: DataFrame, config: Config, make: Make) -> DataFrame:
    """(id, verdict, critiques, defects) of the outputs, by as many judges as the project names."""
    judges = config["verify"]["judges"] or ["default"]
    plan = calls.review_calls(active, ["id"], "text", "output", judges)
    return calls.reviews(_asked(plan, make, ["id", "judge"], shapes.REVIEW, config["output"]["max_repair_attempts"]), ["id"])


def verdicts(base: DataFrame, config: Config, make: Make, shape: dict | None = None) -> Verdicts:
    """Tables of all enabled stages over `run.deduplicated` records. Each is written once, so that no call is made twice.

    Records of one id are asked about once. Only what is still active is asked about, which is what the stages
    before have left.
    """
    own, spent = Verdicts(), []

    def active() -> DataFrame:
        for table in spent:
            table.drop()
        rows = judged(base, config, own).where("status = 'active'")
        first = rows.groupBy("id").agg(F.min("seq").alias("seq"))
        spent[:] = [Written(rows.join(first, ["id", "seq"], "left_semi"), "active")]
        return spent[0].df

    if config["classify"]["enabled"]:
        own = replace(own, labels=Written(labels(active(), config, make), "labels").df)
    if config["quality"]["enabled"]:
        own = replace(own, scores=Written(scores(active(), config, make), "scores").df)
    if config["annotate"]["enabled"]:
        own = replace(own, outputs=Written(outputs(active(), config, make, shape or config["output"]["schema"] or ANY_OBJECT), "outputs").df)
    if config["verify"]["enabled"]:
        own = replace(own, reviews=Written(reviews(active(), config, make), "reviews").df)
    for table in spent:
        table.drop()
    return own


def run_live(spark: SparkSession, config: Config, make: Make, shape: dict | None = None, limit: int | None = None) -> dict:
    """As `run`, with verdicts that a live judge gives; the report is `run`'s.

    Settings that aren't honoured are told before the first call. The input is read and deduplicated once.
    """
    if faults := unsupported(config, live=True):
        raise ConfigError(faults)
    prepared = prepare(spark, config, limit)
    return run(spark, config, verdicts(prepared[0], config, make, shape), limit, strict=True, live=True, prepared=prepared)
