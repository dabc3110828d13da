"""Threshold sweeps and parameter grids without one job per candidate.

A sweep is one aggregation to distinct scores and one running sum. Running sums are taken within
bins of the score and shifted by the sums of the bins above, so that no task sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysift.operators.metrics import ratios

#: Bins between the least and the greatest score.
BINS = 256


def binned(rows: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """rows with ``bin``, a monotone number of ``value`` from 0 to bins - 1."""
    span = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    place = F.try_divide((F.col(value) - F.col("low")) * bins, F.col("high") - F.col("low"))
    return rows.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(bins - 1)).cast("int")).drop("low", "high")


def threshold_candidates(rows: DataFrame, score: str) -> DataFrame:
    """(threshold): 0, 1, all distinct scores and the middles between neighbours."""
    values = binned(rows.select(F.col(score).cast("double").alias("v")).filter("v is not null").distinct(), "v")
    inner = Window.partitionBy("bin").orderBy("v")
    nexts = values.groupBy("bin").agg(F.min("v").alias("least"))
    nexts = nexts.select("bin", F.lead("least").over(Window.orderBy("bin")).alias("after"))
    linked = values.withColumn("next", F.lead("v").over(inner)).join(F.broadcast(nexts), "bin")
    middles = linked.select(((F.col("v") + F.coalesce("next", "after")) / 2).alias("v"))
    ends = rows.sparkSession.createDataFrame([(0.0,), (1.0,)], "v double")
    return values.select("v").unionByName(middles).unionByName(ends).filter("v is not null").distinct().select(F.col("v").alias("threshold"))


def threshold_sweep(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn) of ``score >= threshold`` for every distinct score."""
    per = (
        rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("threshold"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    )
    per = binned(per, "threshold")
    bins = per.groupBy("bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bins = bins.select(
        "bin",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.sum("p").over(whole).alias("p_all"),
        F.sum("n").over(whole).alias("n_all"),
    )
    run = Window.partitionBy("bin").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        per.join(F.broadcast(bins), "bin")
        .withColumn("tp", F.sum("pos").over(run) + F.col("p_above"))
        .withColumn("fp", F.sum("neg").over(run) + F.col("n_above"))
        .select("threshold", "tp", "fp", (F.col("p_all") - F.col("tp")).alias("fn"), (F.col("n_all") - F.col("fp")).alias("tn"))
    )


def scored(counts: DataFrame, undefined: str = "zero") -> DataFrame:
    """counts with precision, recall and f1."""
    found = ratios(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"), undefined)
    return counts.select("*", *[v.alias(k) for k, v in found.items()])


def best(rows: DataFrame, order: list[Column], by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` (a tuple of columns), of each group of ``by``; no sort of all rows."""
    keep = keep or [c for c in rows.columns if c not in (by or [])]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    top = rows.groupBy(*(by or [])).agg(F.max_by(F.struct(*keep), key).alias("r"))
    return top.select(*(by or []), "r.*")


def best_threshold(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Highest F1, then recall, then precision; of equals the smallest threshold."""
    return best(rows, [F.col("f1"), F.col("recall"), F.col("precision"), -F.col("threshold")], by)


def grid(spark, **values: list) -> DataFrame:
    """The product of small parameter lists, a column each."""
    out = None
    for name, some in values.items():
        column = spark.createDataFrame([(v,) for v in some], [name])
        out = column if out is None else out.crossJoin(F.broadcast(column))
    return out


def linspace(spark, low: float, high: float, steps: int) -> DataFrame:
    """(step, value): ``steps`` numbers from low to high, both included."""
    share = F.col("id") / F.lit(float(steps - 1))
    return spark.range(steps).select(F.col("id").cast("int").alias("step"), (F.lit(low) + share * (high - low)).alias("value"))


def grid_sweep(rows: DataFrame, truth: str, score: str, steps: int = 1001) -> DataFrame:
    """(step, threshold, tp, fp, fn, tn) of ``score >= threshold`` for thresholds i / (steps - 1).

    Rows are counted once, by the last threshold that they reach; the counts of a threshold are running sums over the steps.
    """
    n = steps - 1
    near = F.floor(F.col(score) * n)
    # the product may round over a threshold, either way
    cell = F.when((near + 1) / n <= F.col(score), near + 1).when(near / n > F.col(score), near - 1).otherwise(near)
    held = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    counts = held.groupBy(F.least(F.greatest(cell, F.lit(-1)), F.lit(n)).cast("int").alias("cell")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )
    grid_ = rows.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("step"))
    dense = grid_.join(counts, F.col("step") == F.col("cell"), "left").select("step", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    above, whole = Window.orderBy(F.col("step").desc()), Window.partitionBy()
    run = above.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dense.withColumn("tp", F.sum("pos").over(run))
        .withColumn("fp", F.sum("neg").over(run))
        .withColumn("fn", F.sum("pos").over(whole) - F.col("tp"))
        .withColumn("tn", F.sum("neg").over(whole) - F.col("fp"))
        .filter("step >= 0")
        .select("step", (F.col("step") / F.lit(float(n))).alias("threshold"), "tp", "fp", "fn", "tn")
    )


def rule_sweep(rows: DataFrame, truth: str, values: list[float], decide) -> DataFrame:
    """(value, tp, fp, fn, tn): counts of ``decide(value)``, a column of 0 and 1, for every value of a small grid; one pass over rows."""
    cases = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("value"), decide(v).alias("p")) for v in values])).alias("x")
    flat = rows.filter(F.col(truth).isNotNull()).select(F.col(truth).alias("y"), cases).select("y", "x.*")
    hit = lambda y, p: F.count_if((F.col("y") == y) & (F.col("p") == p))
    return flat.groupBy("value").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
