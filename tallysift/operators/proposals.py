"""Box proposals: greedy suppression, overlap labels, crops."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.functions.scalar import box_iou

# Suppression overlap, kept boxes an image, and the overlaps that make a label.
SUPPRESS, KEEP = 0.80, 8
POSITIVE, NEGATIVE = 0.30, 0.05


def suppressed(boxes: Column, overlap: float = SUPPRESS, keep: int = KEEP) -> Column:
    """Boxes kept greedily from an array already in order: each is dropped if it overlaps a kept one
    by ``overlap`` or more, and none are taken after ``keep``."""
    none = F.filter(boxes, lambda b: F.lit(False))

    def step(kept: Column, b: Column) -> Column:
        free = (F.size(kept) < keep) & ~F.exists(kept, lambda k: box_iou(k, b) >= overlap)
        return F.when(free, F.array_append(kept, b)).otherwise(kept)

    return F.aggregate(boxes, none, step)


def greedy_nms(rows: DataFrame, key: str, overlap: float = SUPPRESS, keep: int = KEEP) -> DataFrame:
    """(key, kept) of rows (key, confidence, ordinal, x1, y1, x2, y2); equals go by ordinal."""
    box = F.struct((-F.col("confidence")).alias("minus"), "ordinal", "confidence", "x1", "y1", "x2", "y2")
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return per.select(key, suppressed(F.col("boxes"), overlap, keep).alias("kept"))


def overlap_labels(proposals: DataFrame, truth: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number, max_iou, label): 1 from ``POSITIVE`` overlap with any true box, 0 up to ``NEGATIVE`` in
    an image labelled 0, else null. proposals: (key, number, box, image_label); truth: (key, box)."""
    found = proposals.join(truth.select(key, F.col("box").alias("true_box")), key, "left")
    most = found.groupBy(key, number, "image_label").agg(F.coalesce(F.max(box_iou(F.col("box"), F.col("true_box"))), F.lit(0.0)).alias("max_iou"))
    label = F.when(F.col("max_iou") >= POSITIVE, 1).when((F.col("max_iou") <= NEGATIVE) & (F.col("image_label") == 0), 0)
    return most.select(key, number, "max_iou", label.alias("label"))


def crop_name(stem: Column, kind: str, index: Column, suffix: Column) -> Column:
    """stem__kind_00_suffix, the index from 0 within the image."""
    return F.concat(stem, F.lit(f"__{kind}_"), F.lpad(index.cast("string"), 2, "0"), F.lit("_"), suffix)


def of_type(manifest: DataFrame, kind: str = "yolo") -> DataFrame:
    """Rows of a crop manifest of one proposal type."""
    return manifest.filter(F.col("proposal_type") == kind)


def with_boxes(images: DataFrame, boxes: DataFrame, key: str, box: str) -> DataFrame:
    """images with n_boxes and the array ``boxes`` in order; images without any stay, with none. Boxes of an image are few."""
    per = boxes.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.array().cast(dict(per.dtypes)["boxes"])
    return images.join(per, key, "left").withColumn("boxes", F.coalesce("boxes", none)).withColumn("n_boxes", F.size("boxes"))


def text_labels(images: DataFrame, first: DataFrame, second: DataFrame | None, key: str) -> DataFrame:
    """(key, label, missing): 1 where the label text of the image, in the first folder that has it, is not blank; a missing one is 0.

    first and second: (key, content) of two folders.
    """
    out = images.select(key).join(first.select(key, F.col("content").alias("c1")), key, "left")
    if second is not None:
        out = out.join(second.select(key, F.col("content").alias("c2")), key, "left")
    content = F.coalesce("c1", "c2") if second is not None else F.col("c1")
    filled = F.coalesce(F.length(F.regexp_replace(content, r"\s+", "")) > 0, F.lit(False))
    return out.select(key, filled.cast("int").alias("label"), content.isNull().alias("missing"))


def pixel_boxes(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, line_no, x1, y1, x2, y2) in pixels of images (key, width, height) and relative centre boxes (key, line_no, cx, cy, w, h);
    an image without boxes has a row without numbers."""
    w, h = F.col("width"), F.col("height")
    corner = lambda c, s, side, sign: (F.col(c) + sign * F.col(s) / 2) * side
    out = images.join(labels, key, "left")
    return out.select(
        key, "line_no", corner("cx", "w", w, -1).alias("x1"), corner("cy", "h", h, -1).alias("y1"), corner("cx", "w", w, 1).alias("x2"), corner("cy", "h", h, 1).alias("y2")
    )


def tiles(images: DataFrame, key: str, side: int) -> DataFrame:
    """(key, tile, x1, y1, x2, y2): the whole tiles of a side that images (key, width, height) hold, row by row from 0."""
    across, down = F.floor(F.col("width") / side).cast("int"), F.floor(F.col("height") / side).cast("int")
    held = images.filter((across > 0) & (down > 0)).select(key, across.alias("across"), F.explode(F.sequence(F.lit(0), across * down - 1)).alias("tile"))
    x, y = F.pmod("tile", F.col("across")) * side, F.floor(F.col("tile") / F.col("across")).cast("int") * side
    return held.select(key, "tile", x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + side).alias("y2"))


def hash_seed(name: Column) -> Column:
    """An unsigned 64-bit seed of a name: the first 16 hexadecimal digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def random_tiles(images: DataFrame, key: str, count: int, share: float = 0.5) -> DataFrame:
    """(key, tile, x1, y1, x2, y2): ``count`` squares in every image (key, width, height), placed by a Mersenne Twister seeded with
    ``hash_seed`` of its name; the side is ``share`` of the shorter side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, width, height, seed in batch.itertuples(index=False):
                draw, side = random.Random(int(seed)), max(1, int(min(width, height) * share))
                for i in range(count):
                    x, y = draw.randint(0, max(0, width - side)), draw.randint(0, max(0, height - side))
                    out.append((name, i, x, y, x + side, y + side))
            yield pd.DataFrame(out, columns=[key, "tile", "x1", "y1", "x2", "y2"])

    kind = dict(images.dtypes)[key]
    seeded = images.select(key, F.col("width").cast("int"), F.col("height").cast("int"), hash_seed(F.col(key).cast("string")).cast("string").alias("seed"))
    return seeded.mapInPandas(run, f"{key} {kind}, tile int, x1 int, y1 int, x2 int, y2 int")


def crop_manifest(images: DataFrame, proposals: DataFrame, truth: DataFrame, key: str, n_tiles: int = 4) -> DataFrame:
    """(key, proposal_type, number, label, x1, y1, x2, y2): the crops that a set of images gives.

    images: (key, image_label, width, height); proposals: (key, confidence, ordinal, x1 to y2); truth: (key, number, box).
    True boxes are crops labelled 1; proposals that survive suppression have the label of their overlap with true
    boxes and go without one; images labelled 0 give random tiles labelled 0.
    """
    side = ("x1", "y1", "x2", "y2")
    kept = greedy_nms(proposals, key).select(key, F.posexplode("kept").alias("number", "kept_box")).select(key, "number", F.struct(*[F.col(f"kept_box.{c}") for c in side]).alias("box"))
    marked = overlap_labels(kept.join(images.select(key, "image_label"), key), truth, key, "number").filter("label is not null").select(key, "number", "label")
    flat = lambda rows, kind: rows.select(key, F.lit(kind).alias("proposal_type"), F.col("number").cast("int").alias("number"), F.col("label").cast("int").alias("label"), *[F.col(f"box.{c}").cast("int").alias(c) for c in side])
    own = flat(truth.withColumn("label", F.lit(1)), "gt").unionByName(flat(kept.join(marked, [key, "number"]), "yolo"))
    empty = random_tiles(images.filter("image_label = 0"), key, n_tiles).select(key, F.lit("negative_tile").alias("proposal_type"), F.col("tile").alias("number"), F.lit(0).alias("label"), *side)
    return own.unionByName(empty)
