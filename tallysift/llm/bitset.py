"""Filters of fixed size that keep most rows out of a join. Rows they let through may still have no partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a filter: 64 bits each, 1 MB in all, whatever it was made from.
CELLS = 1 << 16
#: What names of columns that operators add for themselves begin with: no column of an input does.
OWN = "__tallysift_"
#: The column that ``maybe_in`` adds.
MAYBE = OWN + "maybe"


def _place(key: Column, cells: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(cells)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def bitset(keys: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """(cell, bits) of the non-null keys; at most ``cells`` rows."""
    cell, bit = _place(F.col(key), cells)
    places = keys.select(cell.alias("cell"), bit.alias("bit"))
    return places.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def maybe_in(rows: DataFrame, key: Column, bits: DataFrame, cells: int = CELLS) -> DataFrame:
    """Adds column ``MAYBE``: false only for rows whose key is certainly not in the set. No shuffle of ``rows``.

    ``cells`` is that of ``bits``.
    """
    cell, bit = _place(key, cells)
    return (
        rows.withColumn(OWN + "cell", cell)
        .join(F.broadcast(bits.select(F.col("cell").alias(OWN + "c"), F.col("bits").alias(OWN + "bits"))), F.col(OWN + "cell") == F.col(OWN + "c"), "left")
        .withColumn(MAYBE, F.coalesce(F.getbit(F.col(OWN + "bits"), bit) == 1, F.lit(False)))
        .drop(OWN + "cell", OWN + "c", OWN + "bits")
    )
