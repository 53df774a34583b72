"""Scores from judgments: plans, votes, fits, percentiles, gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranks import ranks

#: Fixed values of the fit: pseudo-comparison weight, tolerance, rounds.
PSEUDO, TOLERANCE, ROUNDS = 0.1, 1e-6, 200


def pairing_plan(items: DataFrame, pool: list[str], item: str, rounds: int, seed: int = 0) -> DataFrame:
    """(pool, round, first, second, first_is_a): random perfect matchings; an odd item sits a round out.

    The draw is the order of a keyed digest, so that it is the same in any partitioning and in SQL.
    """
    keyed = items.select(*pool, F.col(item).alias("_i"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    keyed = keyed.withColumn("_k", F.sha2(F.concat_ws("|", F.lit(seed), "round", F.col("_i").cast("string")), 256))
    placed = ranks(keyed, [*pool, "round"], [F.col("_k"), F.col("_i")], "_n")
    two = placed.groupBy(*pool, "round", F.floor((F.col("_n") - 1) / 2).alias("_pair")).agg(F.min_by("_i", "_n").alias("first"), F.max_by("_i", "_n").alias("second"), F.min_by("_k", "_n").alias("_k"), F.count("*").alias("_both"))
    return two.where("_both = 2").select(*pool, "round", "first", "second", (F.substring("_k", 1, 1) < "8").alias("first_is_a"))


def compose_orders(ab: Column, ba: Column) -> Column:
    """Verdict of both presentation orders: agreement stands, disagreement or one failure is a tie, two failures null."""
    return F.when(ab.isNull() & ba.isNull(), None).when(ab.eqNullSafe(ba), ab).otherwise("tie")


def panel_majority(votes: DataFrame, key: list[str], verdict: str) -> DataFrame:
    """Strict majority of a panel for each key; a failed judge counts as a tie unless all failed."""
    counted = votes.groupBy(*key).agg(
        F.count("*").alias("_n"), F.count(verdict).alias("_valid"),
        F.count_if(F.col(verdict) == "A").alias("_a"), F.count_if(F.col(verdict) == "B").alias("_b"),
    )
    winner = F.when(F.col("_valid") == 0, None).when(F.col("_a") * 2 > F.col("_n"), "A").when(F.col("_b") * 2 > F.col("_n"), "B").otherwise("tie")
    return counted.select(*key, winner.alias("winner"))


def bradley_terry(n: int, winner: np.ndarray, loser: np.ndarray, weight: np.ndarray, pseudo: float = PSEUDO) -> tuple[np.ndarray, int, bool]:
    """Log strengths by minorise-maximise steps with a virtual opponent of strength 1; (values, rounds, converged).

    Comparisons are kept as a list, so that a pool of n items needs memory for its comparisons, not for n * n.
    """
    if n == 0:
        return np.zeros(0), 0, True
    wins = np.bincount(winner, weight, n) + pseudo / 2
    log = np.zeros(n)
    for k in range(1, ROUNDS + 1):
        strength = np.exp(log)
        share = weight / (strength[winner] + strength[loser])
        rate = np.bincount(winner, share, n) + np.bincount(loser, share, n) + pseudo / (strength + 1)
        new = np.log(wins / rate)
        new -= new.mean()
        moved, log = np.abs(new - log).max(), new
        if moved < TOLERANCE:
            return log, k, True
    return log, ROUNDS, False


def fit_pools(comparisons: DataFrame, pool: list[str], first: str = "first", second: str = "second", winner: str = "winner") -> DataFrame:
    """(pool, item, log_strength, rounds, converged) of each pool; winner: A, B or tie (null: no comparison).

    A pool is one batch of one class and criterion, of bounded size by construction.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        items, code = np.unique(np.r_[pdf[first].to_numpy(), pdf[second].to_numpy()], return_inverse=True)
        a, b = code[: len(pdf)], code[len(pdf) :]
        v = pdf[winner].to_numpy()
        win = np.r_[a[v == "A"], b[v == "B"], a[v == "tie"], b[v == "tie"]]
        lose = np.r_[b[v == "A"], a[v == "B"], b[v == "tie"], a[v == "tie"]]
        weight = np.r_[np.ones((v == "A").sum() + (v == "B").sum()), np.full(2 * (v == "tie").sum(), 0.5)]
        value, rounds, done = bradley_terry(len(items), win, lose, weight)
        out = pd.DataFrame({"item": items, "log_strength": value, "rounds": rounds, "converged": done})
        for c in reversed(pool):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    fields = ", ".join(f"{c} {t}" for c, t in comparisons.select(*pool).dtypes)
    kind = dict(comparisons.dtypes)[first]
    return comparisons.groupBy(*pool).applyInPandas(fit, f"{fields}, item {kind}, log_strength double, rounds int, converged boolean")


def percentile(value: Column, pool: list[Column | str]) -> Column:
    """(average rank - 1) / (n - 1) inside the pool; a pool of one scores 0.5. Equal values share their ranks' mean.

    For pools of bounded size, such as a class of one batch; `ranks.percentiles` is for pools of any size.
    """
    up, all_ = Window.partitionBy(*pool).orderBy(value), Window.partitionBy(*pool)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*pool, value))
    n = F.count(F.lit(1)).over(all_)
    return F.when(n == 1, F.lit(0.5)).otherwise((F.rank().over(up) - 1 + (peers - 1) / 2) / (n - 1))


def weighted_mean(scores: DataFrame, key: list[str], score: str, weight: str) -> DataFrame:
    """Weighted mean of the scores that there are; null if there is none."""
    known = F.when(F.col(score).isNotNull(), F.col(weight))
    total = F.sum(known)
    return scores.groupBy(*key).agg(F.when(total != 0, F.sum(F.col(weight) * F.col(score)) / total).alias("aggregate"))


def threshold_gate(aggregate: Column, threshold: float, on_unscored: str = "keep") -> Column:
    """Status by threshold: a score of the threshold or more stays; unscored rows by their own rule."""
    unscored = "active" if on_unscored == "keep" else "dropped_lowq"
    return F.when(aggregate.isNull(), unscored).when(aggregate >= threshold, "active").otherwise("dropped_lowq")


def top_ratio(scored: DataFrame, pool: list[str], aggregate: str, item: str, ratio: float | Column, on_unscored: str | Column = "keep") -> DataFrame:
    """`scored` with rank and status: the best ceil(ratio * n) of each pool's scored rows stay, ties by item.

    ratio and on_unscored may be columns that are the same in all rows of a pool.
    """
    known = F.col(aggregate).isNotNull()
    marked = scored.withColumn("_known", known)
    ranked = ranks(marked, [*pool, "_known"], [F.desc(aggregate), F.col(item)])
    quota = marked.where("_known").groupBy(*[F.col(c).alias(f"_in_{c}") for c in pool]).agg(F.ceil((F.max(ratio) if isinstance(ratio, Column) else F.lit(ratio)) * F.count("*")).alias("_quota"))
    same = F.lit(True)
    for c in pool:
        same = same & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
    ranked = ranked.join(quota, same, "left").withColumn("rank", F.when(F.col("_known"), F.col("rank")))
    unscored = F.when((F.lit(on_unscored) if isinstance(on_unscored, str) else on_unscored) == "keep", "active").otherwise("dropped_lowq")
    status = F.when(~F.col("_known"), unscored).when(F.col("rank") <= F.col("_quota"), "active").otherwise("dropped_lowq")
    return ranked.withColumn("status", status).select(*[c for c in scored.columns if c not in ("rank", "status")], "rank", "status")


def score_report(scores: DataFrame, pool: str, criterion: str, score: str) -> DataFrame:
    """Mean and ten-bucket histogram of each criterion, over all pools (pool null) and in each."""
    bucket = F.least(F.floor(F.col(score) * 10), F.lit(9))
    rows = scores.where(F.col(score).isNotNull()).withColumn("_b", bucket)
    each = rows.groupingSets([(pool, criterion), (criterion,)], pool, criterion)
    return each.agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"), *[F.count_if(F.col("_b") == k).alias(f"b{k}") for k in range(10)])


def tie_rate(verdicts: DataFrame, pool: str, winner: str) -> DataFrame:
    """Ties among judged comparisons (failed calls left out), over all pools (pool null) and in each."""
    judged = verdicts.where(F.col(winner).isNotNull())
    return judged.groupingSets([(pool,), ()], pool).agg(F.count("*").alias("judged"), (F.count_if(F.col(winner) == "tie") / F.count("*")).alias("tie_rate"))
