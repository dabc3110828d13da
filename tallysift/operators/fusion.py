"""Rules that fuse the votes and scores of several models into one decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Votes and scores that a positive needs; a crop score alone, or a pair of full scores, can rescue.

    An absent veto score vetoes nothing and an absent crop score rescues nothing.
    """

    # The thresholds of the production rule.
    votes: int = 1
    score: float = 0.22
    veto: float | None = 0.08
    crop: float | None = 0.97
    rescue: tuple[float, float] | None = None

    def base(self, votes: Column, score: Column, veto: Column) -> Column:
        kept = F.lit(True) if self.veto is None else F.coalesce(veto >= self.veto, F.lit(True))
        return (votes >= self.votes) & (score >= self.score) & kept

    def decide(self, votes: Column, score: Column, veto: Column, crop: Column) -> Column:
        out = self.base(votes, score, veto)
        if self.crop is not None:
            out = out | F.coalesce(crop >= self.crop, F.lit(False))
        if self.rescue is not None:
            out = out | ((score >= self.rescue[0]) & F.coalesce(veto >= self.rescue[1], F.lit(False)))
        return out.cast("int")


PRODUCTION = Rule()
BASE = Rule(crop=None)
#: The full-image rescue.
APP = Rule(crop=None, rescue=(0.85, 0.70))
PANEL = {"final": PRODUCTION, "base": BASE, "app": APP}


def vote_count(*votes: Column) -> Column:
    """Votes of all models; an absent one counts as none."""
    out = F.lit(0)
    for v in votes:
        out = out + F.coalesce(v.cast("int"), F.lit(0))
    return out


def any_box(boxes: Column, confidence: float, area: float = 0.0) -> Column:
    """Whether any (score, area_ratio) of an array passes both thresholds."""
    return F.coalesce(F.exists(boxes, lambda b: (b["score"] >= confidence) & (b["area_ratio"] >= area)), F.lit(False))


def both(*predictions: Column) -> Column:
    return F.least(*[F.coalesce(p, F.lit(0)) for p in predictions])


def either(*predictions: Column) -> Column:
    return F.greatest(*[F.coalesce(p, F.lit(0)) for p in predictions])


def changed(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.filter(F.col(before) != F.col(after))


def best_crop(images: DataFrame, crops: DataFrame, key: str, absent: float = -1.0) -> DataFrame:
    """images with max_crop and crop_name of their highest crop, the first of equals by ordinal.

    crops: (key, crop_name, score, ordinal).
    """
    top = crops.groupBy(key).agg(
        F.max("score").alias("top"), F.max_by("crop_name", F.struct("score", (-F.col("ordinal")).alias("o"))).alias("crop_name")
    )
    return images.join(top, key, "left").withColumn("max_crop", F.coalesce("top", F.lit(absent))).drop("top")


def missing_inputs(images: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """images with the column of each source (key, name) and the array of the sources that have no row for it."""
    out = images
    for name, source in sources.items():
        out = out.join(source.select(key, F.col(name), F.lit(True).alias(f"_{name}")), key, "left")
    gaps = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in sources]))
    return out.withColumn("missing_inputs", gaps).drop(*[f"_{n}" for n in sources])


def agreement(old: DataFrame, new: DataFrame, key: str, bit: str, scores: list[str], tolerance: float = 1e-3) -> DataFrame:
    """(key, same_bit, close) of two result tables; a score that either lacks is close."""
    o, n = old.alias("o"), new.alias("n")
    close = F.lit(True)
    for s in scores:
        close = close & F.coalesce(F.abs(F.col(f"o.{s}") - F.col(f"n.{s}")) <= tolerance, F.lit(True))
    return o.join(n, key, "left").select(key, F.coalesce(F.col(f"o.{bit}") == F.col(f"n.{bit}"), F.lit(False)).alias("same_bit"), close.alias("close"))


def from_details(rows: DataFrame, rule: Rule = PRODUCTION, votes: tuple[str, ...] = ("m", "s", "sa")) -> Column:
    """The decision of a stored details row, all columns text: '' is a branch that was off, votes are counted again."""
    number = lambda c: F.nullif(F.col(c), F.lit("")).try_cast("double")
    return rule.decide(vote_count(*[number(v) for v in votes]), number("score"), number("veto"), number("crop"))


def vetoed(base: Column, veto: Column, least: float = 0.08) -> Column:
    """A stored base decision that stands only with a veto score of at least ``least``."""
    return ((base == 1) & F.coalesce(veto >= least, F.lit(False))).cast("int")


def details_text(*scores: str, digits: int = 8) -> list[Column]:
    """Scores as text with a fixed number of digits; '' where there is none."""
    return [F.when(F.col(s).isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.col(s))).alias(s) for s in scores]


def threshold_name(value: Column, digits: int = 2) -> Column:
    """A number as part of a file name: 0.22 becomes 0p22."""
    return F.replace(F.format_string(f"%.{digits}f", value), F.lit("."), F.lit("p"))


def at_parameters(rows: DataFrame, tolerance: float = 1e-6, **values: float) -> DataFrame:
    """Rows whose text columns are numbers within ``tolerance`` of the values; what is no number does not match."""
    hit = F.lit(True)
    for name, value in values.items():
        hit = hit & F.coalesce(F.abs(F.col(name).try_cast("double") - F.lit(value)) < tolerance, F.lit(False))
    return rows.filter(hit)
