"""Packaged rubrics: what a score looks at, by kind of record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (criterion, weight, question of a comparison).
RUBRICS = {
    "text": (
        ("clarity", 1.0, "Which text is easier to follow?"),
        ("substance", 1.0, "Which text says more that is of use?"),
        ("correctness", 1.0, "Which text has fewer mistakes?"),
        ("completeness", 1.0, "Which text leaves less open?"),
    ),
    "ui": (
        ("legibility", 1.0, "Which screen is easier to read?"),
        ("structure", 1.0, "Which screen is better ordered?"),
        ("content", 1.5, "Which screen holds more to work with?"),
        ("integrity", 1.0, "Which screen is more complete?"),
    ),
    "trajectory": (
        ("coherence", 1.0, "Which sequence follows one aim?"),
        ("progress", 1.0, "Which sequence gets further?"),
        ("cleanness", 1.0, "Which sequence has fewer idle steps?"),
        ("closure", 1.0, "Which sequence comes to an end?"),
    ),
}


def criteria(spark: SparkSession, name: str) -> DataFrame:
    """(pool, criterion, weight, ord, question) of a rubric."""
    return spark.createDataFrame([(name, c, w, k, q) for k, (c, w, q) in enumerate(RUBRICS[name])], "pool string, criterion string, weight double, ord int, question string")


#: What 0 to 5 points of a criterion mean; the words hold for every criterion.
LEVELS = ("nothing of it", "hardly any of it", "some of it, with large gaps", "enough of it to be of use", "much of it, with small gaps", "as much of it as one could ask for")


def levels(name: str) -> dict[str, list[str]]:
    """Six levels of each criterion of a rubric."""
    return {c: [f"{k}: {c}: {words}" for k, words in enumerate(LEVELS)] for c, _, _ in RUBRICS[name]}


def level_faults(rubric: dict[str, list[str]]) -> list[str]:
    """Criteria of a project's own rubric that can't be scored in points, as they don't have six levels."""
    return [f"{c}: six levels expected, not {len(own)}" for c, own in rubric.items() if len(own) != len(LEVELS)]
