import numpy as np
import pytest

from millrace.operators import quality


def test_strengths_of_five_comparisons():
    log, _, _ = quality.bradley_terry(4, np.array([3, 2, 1, 3, 2]), np.array([2, 1, 0, 1, 0]), np.ones(5))
    assert list(np.argsort(log)) == [0, 1, 2, 3]
    assert abs(log.sum()) < 1e-9


def test_no_items_and_one():
    assert quality.bradley_terry(0, *[np.zeros(0, int)] * 2, np.zeros(0))[1:] == (0, True)
    assert quality.bradley_terry(1, *[np.zeros(0, int)] * 2, np.zeros(0))[0] == pytest.approx([0.0])


@pytest.mark.parametrize(("values", "want"), [([1, 1, 2], [0.25, 0.25, 1]), ([0, 0, 0], [0.5] * 3), ([7], [0.5]), ([], [])])
def test_percentiles(spark, values, want):
    df = spark.createDataFrame([("p", k, float(v)) for k, v in enumerate(values)], "pool string, k int, v double")
    from pyspark.sql import functions as F

    got = df.select("k", quality.percentile(F.col("v"), ["pool"]).alias("p")).orderBy("k").collect()
    assert [r["p"] for r in got] == pytest.approx(want)


def test_ties_count_half(spark):
    df = spark.createDataFrame([("p", 1, 2, "tie"), ("p", 2, 3, "A"), ("p", 1, 3, None)], "pool string, first long, second long, winner string")
    got = {r["item"]: r["log_strength"] for r in quality.fit_pools(df, ["pool"]).collect()}
    assert got[2] > got[3] and got[1] > got[3]
