"""Ordered operators: carry-forward, rates, gaps, and folds over a key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with ``carried``: the last value that is not null, the row's own included."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def moving_rate(rows: DataFrame, key: str, ts: str, order: list[str], size: int = 30) -> DataFrame:
    """rows with ``rate``: 1 over the mean of the last ``size`` gaps in seconds; null for the first row of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / F.lit(1e6)
    gaps = rows.withColumn("gap", gap)
    mean = F.avg("gap").over(w.rowsBetween(-(size - 1), 0))
    return gaps.withColumn("rate", F.try_divide(F.lit(1.0), mean)).drop("gap")


def sequence_gaps(rows: DataFrame, base: str, number: str, side: str) -> DataFrame:
    """(base, min_gap, below_10, below_50) over all val - train number differences of a base; differences are signed.

    Pairs are counted, not made: a val number b has a train number a with b - a < w for each a + w that comes after b.
    """
    per = rows.groupBy(base).agg(
        F.min(F.when(F.col(side) == "val", F.col(number))).alias("low"), F.max(F.when(F.col(side) == "train", F.col(number))).alias("high")
    )
    out = per.filter("low is not null and high is not null").select(base, (F.col("low") - F.col("high")).alias("min_gap"))
    for width in (10, 50):
        train = F.col(side) == "train"
        marks = rows.filter(F.col(side).isin("train", "val") & F.col(number).isNotNull()).select(
            base, train.alias("train"), F.when(train, F.col(number) + width).otherwise(F.col(number)).alias("at")
        )
        # a train number a with a + width = b is no pair: it comes before b
        later = Window.partitionBy(base).orderBy(F.col("at"), F.col("train").desc()).rowsBetween(1, Window.unboundedFollowing)
        seen = marks.withColumn("n", F.count_if("train").over(later))
        found = seen.groupBy(base).agg(F.sum(F.when(~F.col("train"), F.col("n")).otherwise(F.lit(0))).alias(f"below_{width}"))
        out = out.join(found, base)
    return out


def early_stop(rows: DataFrame, key: str, epoch: str, loss: str, patience: int, tolerance: float = 1e-6) -> DataFrame:
    """(key, best_epoch, best_loss, stop_epoch): a loss improves if it is below the best less ``tolerance``;
    after ``patience`` epochs without one training stops (null: it never does). Epochs of a key are few."""
    seq = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(loss).cast("double").alias("l")))).alias("seq"))
    start = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop")
    )

    def step(s: Column, x: Column) -> Column:
        going, better = s["stop"].isNull(), x["l"] < s["best"] - tolerance
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        return F.when(
            going,
            F.struct(
                F.when(better, x["l"]).otherwise(s["best"]).alias("best"),
                F.when(better, x["e"]).otherwise(s["at"]).alias("at"),
                bad.alias("bad"),
                F.when(bad >= patience, x["e"]).alias("stop"),
            ),
        ).otherwise(s)

    end = seq.withColumn("s", F.aggregate("seq", start, step))
    return end.select(key, F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best_loss"), F.col("s.stop").alias("stop_epoch"))


# Hits that make danger, hits that make a warning, and the frames of cooldown.
DANGER, WARNING, COOLDOWN = 5, 2, 30


def alarm_start() -> Column:
    return F.struct(F.lit(0).alias("count"), F.lit(0).alias("cooldown"), F.lit("safe").alias("level"))


def alarm_step(s: Column, hit: Column) -> Column:
    """The alarm after one detection frame. A hit counts unless a cooldown runs, which it shortens; a miss counts
    down and starts a cooldown if there was anything to count. Hits raise the level to danger only; misses
    lower it to warning or safe, and one left over keeps it."""
    count = F.when(hit, F.when(s["cooldown"] == 0, s["count"] + 1).otherwise(s["count"])).otherwise(F.greatest(F.lit(0), s["count"] - 1))
    cooldown = F.when(hit, F.greatest(F.lit(0), s["cooldown"] - 1)).otherwise(F.when(s["count"] > 0, F.lit(COOLDOWN)).otherwise(s["cooldown"]))
    after_hit = F.when(count >= DANGER, "danger").otherwise(s["level"])
    after_miss = F.when(count == 0, "safe").when(count >= WARNING, "warning").otherwise(s["level"])
    level = F.when(hit, after_hit).otherwise(after_miss)
    return F.struct(count.alias("count"), cooldown.alias("cooldown"), level.alias("level"))


def alarm_batch(rows: DataFrame, key: str, order: list[str], hit: str) -> DataFrame:
    """(key, frames, count, cooldown, level) after all frames of a key, in order. The stream form is in ``streaming``."""
    frame = F.struct(*order, F.col(hit).alias("hit"))
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    end = per.withColumn("s", F.aggregate("frames", alarm_start(), lambda s, f: alarm_step(s, f["hit"])))
    return end.select(key, F.size("frames").cast("long").alias("frames"), F.col("s.count").alias("count"), F.col("s.cooldown").alias("cooldown"), F.col("s.level").alias("level"))
