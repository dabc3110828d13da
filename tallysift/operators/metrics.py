"""Confusion counts, precision, recall and F1 with the policies named.

Thirteen ways of treating missing predictions, undefined ratios and rounding are reached through four
arguments. All counts of all rules come from one pass with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = ("strict", "drop", "negative", "error")
UNDEFINED = ("null", "zero")
F1 = ("counts", "ratios")


def ratios(tp: Column, fp: Column, positives: Column, undefined: str = "null", f1: str = "counts", digits: int | None = None) -> dict[str, Column]:
    """Precision, recall and F1. ``f1='counts'``: 2 TP over both denominators, undefined if either is 0;
    ``'ratios'``: the harmonic mean, undefined if precision or recall is undefined or 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, positives)
    if f1 == "counts":
        f = F.when((tp + fp > 0) & (positives > 0), F.try_divide(2 * tp, tp + fp + positives))
    else:
        f = F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
    out = {"precision": p, "recall": r, "f1": f}
    if undefined == "zero":
        out = {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}
    if digits is not None:
        out = {k: F.bround(v, digits) for k, v in out.items()}
    return out


def confusion(
    rows: DataFrame,
    truth: str | Column,
    prediction: str | Column,
    missing: str = "strict",
    undefined: str = "null",
    f1: str = "counts",
    digits: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """One row (a group of ``by``) of tp, fp, fn, tn, missing, missing_positive, precision, recall, f1.

    Rows without truth do not count. Rows without prediction: ``strict`` keeps them out of the four
    counts and adds positives to recall's denominator; ``drop`` ignores them; ``negative`` takes them
    as 0; ``error`` fails.
    """
    if missing not in MISSING or undefined not in UNDEFINED or f1 not in F1:
        raise ValueError(f"missing={missing}, undefined={undefined}, f1={f1}")
    y, p = (F.col(c) if isinstance(c, str) else c for c in (truth, prediction))
    if missing == "negative":
        p = F.coalesce(p, F.lit(0))
    elif missing == "error":
        p = F.when(p.isNull() & y.isNotNull(), F.raise_error(F.lit("a labelled row has no prediction")).cast("int")).otherwise(p)
    counts = rows.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if(y.isNotNull() & p.isNull()).alias("missing"),
        F.count_if((y == 1) & p.isNull()).alias("missing_positive"),
    )
    positives = F.col("tp") + F.col("fn") + (F.col("missing_positive") if missing == "strict" else F.lit(0))
    found = ratios(F.col("tp"), F.col("fp"), positives, undefined, f1, digits)
    return counts.select("*", *[v.alias(k) for k, v in found.items()])


def box_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Box-level F1 whose denominators are never 0."""
    p, r = tp / (tp + fp + F.lit(1e-8)), tp / (tp + fn + F.lit(1e-8))
    return 2 * p * r / (p + r + F.lit(1e-8))


def share_of_total(rows: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """(key, n, percent) of each value."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("total"), digits).alias("percent"))


def class_weights(rows: DataFrame, label: str, classes: int = 2) -> DataFrame:
    """(label, n, weight) for every class, absent ones too: rows / (classes * max(n, 1))."""
    spark = rows.sparkSession
    counts = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("n"))
    domain = spark.range(classes).withColumnRenamed("id", "label")
    dense = domain.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = dense.agg(F.sum("n").alias("total"))
    return dense.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (F.lit(float(classes)) * F.greatest("n", F.lit(1)))).alias("weight"))


def histogram(rows: DataFrame, value: str, edges: list[tuple[str, int, int]]) -> DataFrame:
    """(bin, n) for irregular bins (name, least, greatest) of whole numbers; empty bins stay."""
    pick = F.lit(None).cast("string")
    for name, low, high in reversed(edges):
        pick = F.when(F.col(value).between(low, high), name).otherwise(pick)
    counts = rows.groupBy(pick.alias("bin")).agg(F.count("*").alias("n"))
    domain = rows.sparkSession.createDataFrame([(i, n) for i, (n, _, _) in enumerate(edges)], "ordinal int, bin string")
    return domain.join(counts, "bin", "left").select("ordinal", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def upper_median(value: str) -> Column:
    """The middle value, or the upper of the two: the lower of the two in falling order. Partial sums hold distinct values only."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")


def both_policies(rows: DataFrame, truth: str, prediction: str, digits: int = 6) -> DataFrame:
    """(policy, confusion columns): missing predictions as errors (strict), and left out (intersection)."""
    out = None
    for policy, missing in (("strict", "strict"), ("intersection", "drop")):
        part = confusion(rows, truth, prediction, missing=missing, digits=digits).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


def without_rows(rows: DataFrame, key: str, prediction: str, k: int, seed: str = "drop") -> DataFrame:
    """rows in which the predictions of k keys, those with the least hashes, are taken away."""
    h = F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    gone = rows.select(F.col(key).alias("gone")).orderBy(h, key).limit(k)
    marked = rows.join(F.broadcast(gone), F.col(key) == F.col("gone"), "left")
    return marked.withColumn(prediction, F.when(F.col("gone").isNull(), F.col(prediction))).drop("gone")


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how often each combination occurs."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def detection_totals(images: DataFrame, boxes: DataFrame, key: str, cls: str) -> DataFrame:
    """(cls, boxes, images): boxes of each class and images with one; the row of null class holds the totals, images without boxes included."""
    per = boxes.groupBy(F.col(cls).cast("string").alias("cls")).agg(F.count("*").alias("boxes"), F.count_distinct(key).alias("images"))
    total = boxes.agg(F.lit(None).cast("string").alias("cls"), F.count("*").alias("boxes"), F.count_distinct(key).alias("with_box"))
    every = images.agg(F.count_distinct(key).alias("images"))
    return per.withColumn("with_box", F.col("images")).unionByName(total.crossJoin(F.broadcast(every)))


def families(rows: DataFrame, name: str) -> DataFrame:
    """(family): the distinct first two tokens of names between underscores."""
    return rows.select(F.substring_index(name, "_", 2).alias("family")).distinct()
