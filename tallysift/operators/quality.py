"""Audits of datasets: annotations, splits, artifacts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotation_audit(boxes: DataFrame, low: float = 1e-6, high: float = 2.0) -> DataFrame:
    """One row of counts over (x, y, w, h, width, height): boxes, incomplete, without area, outside the image."""
    x, y, w, h = (F.col(c) for c in "xywh")
    whole = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    outside = (x < -low) | (y < -low) | (x + w > F.col("width") + high) | (y + h > F.col("height") + high)
    return boxes.agg(
        F.count("*").alias("boxes"),
        F.count_if(~whole).alias("incomplete"),
        F.count_if(whole & ((w <= 0) | (h <= 0))).alias("no_area"),
        F.count_if(whole & F.coalesce(outside, F.lit(False))).alias("outside"),
    )


def split_stats(rows: DataFrame, split: str, label: str) -> DataFrame:
    """(split, n, pos, neg, missing, pos_rate)."""
    y = F.col(label)
    per = rows.groupBy(split).agg(
        F.count("*").alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count_if(y.isNull()).alias("missing")
    )
    return per.withColumn("pos_rate", F.bround(F.try_divide("pos", "n"), 4))


def random_split(rows: DataFrame, key: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """(key, side): ``max(1, int(n * share))`` keys in val, those with the least hashes. Keys are unique.

    Keys are counted by the first 12 bits of their hash; only the bin in which the last val key
    falls is ordered.
    """
    h = F.md5(F.concat(F.lit(seed + "-"), F.col(key).cast("string")).cast("binary"))
    hashed = rows.select(F.col(key), h.alias("h"), F.substring(h, 1, 3).alias("bin"))
    bins = hashed.groupBy("bin").agg(F.count("*").alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bins = bins.select(
        F.col("bin").alias("b"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
        F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) * F.lit(share))).alias("val"),
    )
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("h", key))
    placed = hashed.join(F.broadcast(bins), F.col("bin") == F.col("b"))
    return placed.select(key, F.when(F.col("before") + rank <= F.col("val"), "val").otherwise("train").alias("side"))


def first_names(names: str | Column, most: int) -> Column:
    """Aggregate expression: the first names in order, for a report."""
    return F.slice(F.array_sort(F.collect_set(names)), 1, most)


def reconcile(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, one column of ``value`` a table, agree): agreement is null-safe."""
    out, names = None, list(tables)
    for name, t in tables.items():
        part = t.select(key, F.col(value).alias(name))
        out = part if out is None else out.join(part, key, "full")
    same = F.lit(True)
    for a, b in zip(names, names[1:], strict=False):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return out.withColumn("agree", same)


def sample_manifest(rows: DataFrame, key: str, n_fp: int = 4, n_edge: int = 5) -> DataFrame:
    """(key, bucket) of rows (key, truth, prediction, score, crop): highest false positives, all false
    negatives, and the rows nearest to a threshold that are not among them."""
    # Thresholds and the bands around them.
    near_score = F.when(F.abs(F.col("score") - 0.22) <= 0.03, F.abs(F.col("score") - 0.22))
    near_crop = F.when((F.col("crop") >= 0) & (F.abs(F.col("crop") - 0.97) <= 0.02), F.abs(F.col("crop") - 0.97))
    marked = rows.withColumn("margin", F.least(near_score, near_crop))
    fp = marked.filter("truth = 0 and prediction = 1").orderBy(F.col("score").desc(), key).limit(n_fp).select(key, F.lit("false_positive").alias("bucket"))
    fn = marked.filter("truth = 1 and prediction = 0").select(key, F.lit("false_negative").alias("bucket"))
    picked = fp.unionByName(fn)
    edge = marked.filter("margin is not null").join(picked, key, "left_anti").orderBy("margin", key).limit(n_edge)
    return picked.unionByName(edge.select(key, F.lit("boundary").alias("bucket")))


def require_distinct(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows, if they hold exactly n distinct keys; else an error with the number."""
    found = rows.select(key).distinct().count()
    if found != n:
        raise ValueError(f"{found} distinct names instead of {n}")
    return rows


def newest(files: DataFrame, path: str = "path", modified: str = "modified") -> DataFrame:
    """One row: the path that was changed last, of equals the greatest, and when."""
    return files.agg(F.max(F.struct(F.col(modified).alias("m"), F.col(path).alias("p"))).alias("x")).select(F.col("x.p").alias("path"), F.col("x.m").alias("modified"))


def split_summary(rows: DataFrame, before: str, after: str, label: str) -> DataFrame:
    """(state, split, n, pos, pos_rate) of an old and a new split of the same rows."""
    states = F.explode(F.array(F.struct(F.lit("before").alias("state"), F.col(before).alias("split")), F.struct(F.lit("after").alias("state"), F.col(after).alias("split")))).alias("x")
    flat = rows.select(F.col(label).alias("y"), states).select("y", "x.*")
    per = flat.groupBy("state", "split").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    return per.withColumn("pos_rate", F.bround(F.try_divide("pos", "n"), 4))


def boxes_per_image(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(n_boxes, images): how many images have so many boxes, none included."""
    counts = boxes.groupBy(key).agg(F.count("*").alias("n"))
    per = images.select(key).join(counts, key, "left").select(F.coalesce("n", F.lit(0)).alias("n_boxes"))
    return per.groupBy("n_boxes").agg(F.count("*").alias("images"))


def median_area(boxes: DataFrame, category: str, area: Column) -> DataFrame:
    """(category, n, median_area)."""
    return boxes.groupBy(category).agg(F.count("*").alias("n"), F.percentile(area, F.lit(0.5)).alias("median_area"))


def stage_latency(rows: DataFrame, stage: str, seconds: str, memory: str) -> DataFrame:
    """(stage, n, median, peak): the median time and the highest memory of each stage."""
    return rows.groupBy(stage).agg(F.count(seconds).alias("n"), F.percentile(seconds, F.lit(0.5)).alias("median"), F.max(memory).alias("peak"))


def best_epoch(history: DataFrame, run: str, epoch: str, score: str, seconds: str) -> DataFrame:
    """(run, best_epoch, best, hours): the first epoch with the highest score; hours from the last epoch's clock."""
    return history.groupBy(run).agg(
        F.max_by(epoch, F.struct(F.col(score), (-F.col(epoch)).alias("e"))).alias("best_epoch"),
        F.max(score).alias("best"),
        (F.max_by(seconds, epoch) / 3600).alias("hours"),
    )
