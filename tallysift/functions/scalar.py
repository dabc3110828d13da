"""Column to Column functions: geometry, scores, hashes, classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two structs x1, y1, x2, y2; 0 where their union has no area."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    common = width * height
    union = box_area(a) + box_area(b) - common
    return F.when(union > 0, F.try_divide(common, union)).otherwise(F.lit(0.0))


def corner_box_to_centre(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corner and size to normalised centre and size; each part is clamped on its own."""
    return {
        "cx": clamp((x + w / 2) / width),
        "cy": clamp((y + h / 2) / height),
        "bw": clamp(w / width),
        "bh": clamp(h / height),
    }


def centre_box_to_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.struct(
        ((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2")
    )


def expanded_box(b: Column, width: Column, height: Column, context: float, least: float) -> Column:
    """The square around a box: its larger side grown by ``context`` on both ends, at least ``least``, no larger than
    the image, moved into it and rounded half to even."""
    grown = [F.greatest(F.lit(1.0), b[hi] - b[lo]) * (1 + 2 * context) for lo, hi in (("x1", "x2"), ("y1", "y2"))]
    side = F.greatest(*grown, F.lit(float(least)))

    def span(lo: str, hi: str, limit: Column) -> tuple[Column, Column]:
        length = F.least(limit.cast("double"), side)
        start = F.least(F.greatest(F.lit(0.0), (b[lo] + b[hi]) / 2 - length / 2), limit - length)
        return F.rint(start).cast("int"), F.rint(start + length).cast("int")

    (x1, x2), (y1, y2) = span("x1", "x2", width), span("y1", "y2", height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area_ratio(b: Column, width: Column, height: Column) -> Column:
    """Share of the image; a box turned over in both axes counts as if it were not."""
    return F.greatest(F.lit(0.0), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])) / F.greatest(height * width, F.lit(1))


def letterbox(width: Column, height: Column, side: int) -> dict[str, Column]:
    """Scale, new size and left and top padding that fit an image into a square."""
    scale = F.least(F.lit(float(side)) / height, F.lit(float(side)) / width)
    w, h = (width * scale).cast("int"), (height * scale).cast("int")
    return {"scale": scale, "new_w": w, "new_h": h, "pad_x": F.floor((F.lit(side) - w) / 2).cast("int"), "pad_y": F.floor((F.lit(side) - h) / 2).cast("int")}


def unletterbox(b: Column, width: Column, height: Column, side: int) -> Column:
    """A box of the square back in the image, cut at its edges."""
    gain = F.least(F.lit(float(side)) / height, F.lit(float(side)) / width)

    def back(v: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(limit.cast("double"), (v - (F.lit(side) - limit * gain) / 2) / gain))

    return F.struct(back(b["x1"], width).alias("x1"), back(b["y1"], height).alias("y1"), back(b["x2"], width).alias("x2"), back(b["y2"], height).alias("y2"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """64-bit hash of a vector: bit i, from the highest, is set where value i is positive."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        at = bits - 1 - i
        out = out.bitwiseOR(F.when(vector[i] > 0, F.lit((1 << at) if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """dHash of an array of grey values, row by row: whether each value is above its right neighbour, highest bit first."""
    out = F.lit(0).cast("long")
    at = height * (width - 1) - 1
    for y in range(height):
        for x in range(width - 1):
            bit = F.lit((1 << at) if at < 63 else -(1 << 63)).cast("long")
            out = out.bitwiseOR(F.when(pixels[y * width + x] > pixels[y * width + x + 1], bit).otherwise(F.lit(0).cast("long")))
            at -= 1
    return out


def positive_share(no: Column, yes: Column) -> Column:
    """Softmax of two logits: the share of the second."""
    return 1 / (1 + F.exp(no - yes))


def bound(value: Column, use) -> Column:
    """``use(value)`` with value computed once, where ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values))


def zero_shot(positive: Column, negative: Column) -> Column:
    """Sigmoid of the mean of positive prompts' logits less that of the negative ones."""
    return 1 / (1 + F.exp(-(mean_of(positive) - mean_of(negative))))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return bound(norm, lambda n: F.transform(vector, lambda x: F.try_divide(x.cast("double"), n)))


def normed_linear(vector: Column, weights: Sequence[float], bias: float, eps: float = 1e-5) -> Column:
    """Layer normalisation without gain, then a linear head."""
    heads = F.array(*[F.lit(float(w)) for w in weights])

    def head(wide: Column, mean: Column, deviation: Column) -> Column:
        products = F.zip_with(wide, heads, lambda x, w: (x - mean) / deviation * w)
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) + bias

    def normed(wide: Column, mean: Column) -> Column:
        variance = mean_of(F.transform(wide, lambda x: (x - mean) * (x - mean)))
        return bound(F.sqrt(variance + eps), lambda d: head(wide, mean, d))

    doubles = F.transform(vector, lambda x: x.cast("double"))
    return bound(doubles, lambda wide: bound(mean_of(wide), lambda mean: normed(wide, mean)))


def id_score(prefix: str, key: Column) -> Column:
    """A fixed number in [0, 1) for a key: the first 32 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(prefix), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def sequence_base(stem: Column) -> Column:
    """What stands before a number of two or more digits at the end; null without one."""
    return F.nullif(F.regexp_extract(stem, r"^(.+?)[-_](\d{2,})$", 1), F.lit(""))


def sequence_number(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"^(.+?)[-_](\d{2,})$", 2), F.lit("")).cast("long")


def float_list(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("double"))


def value_kind(value: Column) -> Column:
    """What a VARIANT label is: ok for the integers 0 and 1, else the code of what is wrong with it."""
    kind = F.schema_of_variant(value)
    # The codes of reports.
    return (
        F.when(value.isNull() | (kind == "VOID"), "null_value")
        .when(kind == "BOOLEAN", "boolean_not_int")
        .when(kind == "STRING", "string_value")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float_not_int")
        .when(kind != "BIGINT", "unsupported_value_type")
        .when(F.try_variant_get(value, "$", "bigint").isin(0, 1), "ok")
        .otherwise("value_out_of_range")
    )


def key_kind(key: Column) -> Column:
    """What an image name is: ok, or the code of what is wrong with it."""
    # The codes of reports.
    return (
        F.when(key.rlike(r"[\\/]") | F.contains(key, F.lit("..")) | (key == "."), "path_traversal_or_separator")
        .when(key == "", "key_not_bare_filename")
        .when(F.regexp_replace(key, r"^\s+|\s+$", "") != key, "key_whitespace")
        .otherwise("ok")
    )


def short_message(message: Column, most: int = 200) -> Column:
    return F.left(message, F.lit(most))
