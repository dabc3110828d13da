"""Bootstrap intervals from hash-indexed draws.

Draw j of replicate r takes item ``hash(seed, r, j) mod n``, so replicates need no driver-side random
numbers, are the same on every run, and a lost task repeats its own. Draws are reduced to counts of
(replicate, item) before they meet the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysift.operators.metrics import ratios
from tallysift.session import settle


def draw(seed: str, replicate: Column, j: Column, n: Column) -> Column:
    """A number below n: the first 48 bits of an MD5, modulo n."""
    key = F.concat_ws("-", F.lit(seed), replicate.cast("string"), j.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long"), n)


def replicates(units: DataFrame, seed: str, times: int, multiplicity: bool = True) -> DataFrame:
    """(rep, unit, k): how often each of the units (unit, numbered 0 to n - 1 as ``no``) is drawn.

    ``multiplicity=False`` counts repeats once, which gives intervals that are too narrow; it is there to
    compare with results made that way.
    """
    spark = units.sparkSession
    n = units.count()
    draws = spark.range(times * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), F.pmod("id", F.lit(max(n, 1))).alias("j"))
    counts = draws.groupBy("rep", draw(seed, F.col("rep"), F.col("j"), F.lit(n)).alias("no")).agg(F.count("*").alias("k"))
    if not multiplicity:
        counts = counts.withColumn("k", F.lit(1).cast("long"))
    return counts.join(units, "no").select("rep", "unit", "k")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """(unit, no): distinct keys numbered from 0 in their order; ranges of keys are numbered apart and shifted by the ranges before."""
    ranges = settle(rows.select(F.col(key).alias("unit")).distinct().repartitionByRange("unit").withColumn("part", F.spark_partition_id()), "units")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("unit"))
    return ranges.join(F.broadcast(sizes), F.col("part") == F.col("p")).select("unit", (F.col("before") + place - 1).cast("long").alias("no"))


def replicate_metrics(rows: DataFrame, key: str, truth: str, prediction: str, reps: DataFrame, on_undefined: str = "zero") -> DataFrame:
    """(rep, precision, recall) with every row counted as often as its unit ``key`` is drawn."""
    y, p, k = F.col(truth), F.col(prediction), F.col("k")

    def total(when: Column) -> Column:
        return F.sum(F.when(when, k).otherwise(F.lit(0).cast("long")))

    counts = rows.join(reps, F.col(key) == F.col("unit")).groupBy("rep").agg(
        total((y == 1) & (p == 1)).alias("tp"), total((y == 0) & (p == 1)).alias("fp"), total((y == 1) & (p == 0)).alias("fn")
    )
    found = ratios(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"), "zero" if on_undefined == "zero" else "null")
    return counts.select("rep", found["precision"].alias("precision"), found["recall"].alias("recall"))


def interval(values: DataFrame, column: str, level: float = 0.95, rule: str = "linear") -> Column:
    """Aggregate expression of [low, high]: interpolated percentiles, or order statistics."""
    tail = (1 - level) / 2
    if rule == "linear":
        return F.percentile(column, F.array(F.lit(tail), F.lit(1 - tail)))
    v = F.array_sort(F.collect_list(column))
    low = F.floor(F.size(v) * tail).cast("int") + 1
    high = F.ceil(F.size(v) * (1 - tail)).cast("int")
    return F.array(F.try_element_at(v, low), F.try_element_at(v, high))
