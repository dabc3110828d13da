"""Hand-derived cases of the metric policies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallysift.operators import fusion, metrics


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "y int, p int")


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(1, 1)] * 2 + [(1, 0)] + [(0, 0)] * 3, (1.0, 2 / 3, 0.8)),
        ([(1, 1), (0, 0)], (1.0, 1.0, 1.0)),
        ([(1, 1)] * 3 + [(0, 1)], (0.75, 1.0, 6 / 7)),
        ([(1, None), (0, None)], (None, 0.0, None)),
        ([(0, 0)], (None, None, None)),
    ],
)
def test_strict(spark, pairs, want):
    r = metrics.confusion(rows(spark, pairs), "y", "p", missing="strict").first()
    assert (r["precision"], r["recall"], r["f1"]) == tuple(None if w is None else pytest.approx(w) for w in want)


def test_five_missing_positives(spark):
    data = rows(spark, [(1, 1)] + [(1, None)] * 5 + [(0, 0)] * 4)
    assert metrics.confusion(data, "y", "p", missing="strict").first()["recall"] == pytest.approx(1 / 6)
    assert metrics.confusion(data, "y", "p", missing="drop").first()["recall"] == 1.0
    assert metrics.confusion(data, "y", "p", missing="negative").first()["fn"] == 5


def test_policies(spark):
    none = rows(spark, [(0, 0)])
    zero = metrics.confusion(none, "y", "p", undefined="zero").first()
    assert (zero["precision"], zero["recall"], zero["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.confusion(rows(spark, [(1, 0), (0, 1)]), "y", "p").first()["f1"] == 0.0
    assert metrics.confusion(rows(spark, [(1, 0), (0, 1)]), "y", "p", f1="ratios").first()["f1"] is None
    with pytest.raises(Exception, match="no prediction"):
        metrics.confusion(rows(spark, [(1, None)]), "y", "p", missing="error").collect()
    with pytest.raises(ValueError):
        metrics.confusion(none, "y", "p", missing="other")


def test_rounding_is_half_even(spark):
    data = rows(spark, [(1, 1)] * 2 + [(0, 1)])
    assert metrics.confusion(data, "y", "p", digits=4).first()["precision"] == 0.6667


def test_production_rule(spark):
    # (votes, score, veto, crop) -> decision
    cases = [(1, 0.22, 0.08, None, 1), (0, 0.9, 0.9, None, 0), (1, 0.21, 0.9, None, 0), (1, 0.5, 0.07, None, 0), (1, 0.5, None, None, 1), (0, 0.0, 0.0, 0.97, 1), (0, 0.0, 0.0, 0.969, 0)]
    data = spark.createDataFrame(cases, "votes int, score double, veto double, crop double, want int")
    got = data.withColumn("got", fusion.PRODUCTION.decide(F.col("votes"), F.col("score"), F.col("veto"), F.col("crop")))
    assert got.filter("got <> want").count() == 0
    assert (fusion.PRODUCTION.score, fusion.PRODUCTION.veto, fusion.PRODUCTION.crop, fusion.APP.rescue) == (0.22, 0.08, 0.97, (0.85, 0.70))


def test_best_crop_first_of_equals(spark):
    images = spark.createDataFrame([("a",), ("b",)], "k string")
    crops = spark.createDataFrame([("a", "x", 0.9, 2), ("a", "y", 0.9, 1), ("a", "z", 0.1, 0)], "k string, crop_name string, score double, ordinal int")
    got = {r["k"]: (r["max_crop"], r["crop_name"]) for r in fusion.best_crop(images, crops, "k").collect()}
    assert got == {"a": (0.9, "y"), "b": (-1.0, None)}
