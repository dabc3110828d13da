"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Within a source, documents have unequal expected numbers of copies: they
are proportional to ``appeal``, up to ``MOST``, and such that the expected words of the source are its target. The whole
part of a document's expectation is allocated with certainty; its fraction p is its inclusion probability in a
sample of fixed size: documents are ranked by random odds divided by inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken in that order until the rest of the target is filled. At most
``CLOSERS`` further documents, each the one whose size is nearest to what is still missing, close the gap; they
raise the inclusion of two documents of a source at most.

The query and the pipeline use ``size_appeal``: of two documents, the one with 16 times the words has half the
expected copies.

Scale: texts are reduced to their sizes in the scan. Appeals are rounded to levels, whose sums are one small table. No
order over a whole source is built: ranks fall into bins, about four times the square root of the source's rows,
whose sizes are summed (partial sums map-side), and only the rows of the one bin in which a source's target falls
are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysift.llm.bitset import OWN
from tallysift.session import settle, table

#: Levels of appeal: an eighth of a power of two each, and the farthest from 1 on either side.
LEVELS, FARTHEST = 8, 128
#: No document is taken more often than this.
MOST = 3
#: Documents that may be added to close what the last whole document leaves open.
CLOSERS = 2


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than U+0020 and U+0009 to U+000D; null: 0."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): water filling of the total size by weights.

    Weights are 1, 2, 3 and so on again in code-point order, null last. With sources ordered by
    ``most * source_size / weight``, the capped ones are a prefix; the others share what is left by
    weight. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    by_room = Window.orderBy(F.col("room").asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        ranked.withColumn("room", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
    )
    fits = levels.withColumn("fits", F.col("level") <= F.col("room"))
    rest = F.min(F.when(F.col("fits"), F.struct("room", F.col("source").isNull().alias("last"), "source", "level"))).over(whole)
    return fits.withColumn("rest", rest).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("rest").isNull() | (F.col("room") < F.col("rest.room")), F.col("source_size") * F.lit(float(most)))
        .otherwise(F.least(F.col("rest.level") * F.col("weight"), F.col("source_size") * F.lit(float(most))))
        .alias("target"),
    )


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by key and seed: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def size_appeal(size: Column) -> Column:
    """Relative expected copies by size: a fourth of a power of two less for each binary digit of the number of words."""
    return F.pow(F.lit(2.0), -F.length(F.bin(size)) / 4)


def expectations(levels: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, level, whole, p, need, source_size, target) for rows of (source, level, words): expected copies of a level.

    Copies are ``least(most, rate * 2 ** (level / LEVELS))`` with the rate that fills the source's target: with levels in
    falling order the capped ones come first. A source without words has no copies.
    """
    by_level = Window.partitionBy("source").orderBy(F.col("level").desc())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole_source = Window.partitionBy("source")
    appeal = F.pow(F.lit(2.0), F.col("level") / LEVELS)
    tried = (
        levels.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("capped", F.coalesce(F.sum(F.col("words") * most).over(before), F.lit(0)))
        .withColumn("pull", F.sum(F.col("words") * appeal).over(rest))
        .withColumn("rate", F.try_divide(F.col("target") - F.col("capped"), F.col("pull")))
    )
    fit = F.max(F.when(F.col("rate") * appeal <= most, F.struct("level", "rate"))).over(whole_source)["rate"]
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("fit") * appeal, F.lit(float(most)))))
    shared = tried.withColumn("fit", fit).withColumn("m", copies).withColumn("whole", F.floor(F.col("m") + 1e-9).cast("long"))
    need = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source)
    return shared.withColumn("need", need).select("source", "level", "whole", F.greatest(F.col("m") - F.col("whole"), F.lit(0.0)).alias("p"), "need", "source_size", "target")


def mix(items: DataFrame, seed: str = "mix-", most: int = MOST, closers: int = CLOSERS) -> DataFrame:
    """Copies of each item of (doc_id, size, source, appeal).

    Returns doc_id, size, source, source_size, target, copies, taken, twin. ``appeal`` is a positive
    relative number of expected copies within the source (null or not positive: 1), rounded to a level. Null sources are one
    source. Rows that agree in doc_id, source and size are numbered by ``twin``, so that each has odds of its own; which of
    them is which does not matter. An empty table gives an empty table, a source without words target 0.
    """
    same = Window.partitionBy("doc_id", "source", "size").orderBy("level")
    appeal = F.col("appeal").cast("double")
    level = F.when(appeal > 0, F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.round(F.log2(appeal) * LEVELS)))).otherwise(0)
    rows = settle(
        items.select("doc_id", F.col("size").cast("long").alias("size"), "source", level.cast("int").alias("level")).withColumn("twin", F.row_number().over(same)),
        "mix-sizes",
    )
    levels = rows.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = levels.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    targets = source_targets(sources.select("source", "source_size"), most).select("source", "source_size", "target")
    plan = expectations(levels.drop("n"), targets, most)
    bins = sources.select(F.col("source").alias("b"), (F.ceil(F.sqrt("n")) * 4).alias("bins"))
    plan = settle(plan.join(bins, F.col("source").eqNullSafe(F.col("b"))).drop("b"), "mix-levels")
    p = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = F.col("u")
    ranked = (
        rows.join(plan.select(F.col("source").alias("s"), F.col("level").alias("l"), *plan.columns[2:]), F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l")))
        .withColumn("u", uniform(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("twin")), seed))
        .withColumn("q", F.when(F.col("whole") < most, (u / (1 - u)) / (p / (1 - p))))
        # a monotone map of q to bins; documents that have all their copies take no part
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * F.col("bins")))
    )
    ranked = settle(ranked.drop("u", "p", "s", "l", "level", "bins"), "mix-ranks")
    sums = ranked.filter("bin is not null").groupBy("source", "need", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turning = (
        sums.withColumn("end", F.sum("bin_size").over(upto))
        .filter((F.col("end") >= F.col("need")) & (F.col("end") - F.col("bin_size") < F.col("need")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min("bin").alias("turn"), F.min_by(F.col("end") - F.col("bin_size"), F.col("bin")).alias("base"))
    )
    placed = ranked.join(turning, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    within = Window.partitionBy("source").orderBy("q", "doc_id", "twin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = F.coalesce(F.col("bin") == F.col("turn"), F.lit(False))
    edge = placed.filter(at_edge).withColumn("end", F.col("base") + F.sum("size").over(within))
    clear = placed.filter(~at_edge).withColumn("end", F.lit(None).cast("long"))
    chosen = settle(
        clear.unionByName(edge).withColumn(
            "extra",
            F.coalesce(((F.col("bin") < F.col("turn")) | (F.col("end") <= F.col("need"))).cast("int"), F.lit(0)),
        ),
        "mix-chosen",
    )
    # what the documents before the turning point leave open, and the document nearest to it
    gap = (
        chosen.filter("end is not null")
        .groupBy("source")
        .agg((F.first("need") - F.coalesce(F.max(F.expr("case when extra = 1 then end end")), F.first("base"))).alias("gap"))
    )
    added = None
    for _ in range(closers):
        spare = chosen.filter("extra = 0 and size > 0 and q is not null")
        if added is not None:
            spare = spare.join(added, _same(spare, added), "left_anti")
        closer = _closer(spare, gap)
        gap = closer.select(F.col("c_source").alias("source"), (F.col("gap") - F.col("c_size")).alias("gap"))
        closer = closer.drop("gap")
        added = closer if added is None else added.unionByName(closer)
    copies = F.col("whole") + F.col("extra")
    if added is not None:
        chosen, copies = chosen.join(added, _same(chosen, added), "left"), copies + F.col("c_twin").isNotNull().cast("int")
    return chosen.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "twin"
    )


def _same(rows: DataFrame, closers: DataFrame) -> Column:
    return (
        rows["source"].eqNullSafe(closers["c_source"])
        & rows["doc_id"].eqNullSafe(closers["c_id"])
        & (rows["twin"] == closers["c_twin"])
        & (rows["size"] == closers["c_size"])
    )


def _closer(spare: DataFrame, gap: DataFrame) -> DataFrame:
    """For each source the row left out whose size is nearest to the gap, if it makes the gap smaller."""
    far = F.abs(F.col("size").cast("double") - F.col("gap"))
    return (
        spare.join(gap.select(F.col("source").alias("s"), "gap"), F.col("source").eqNullSafe(F.col("s")))
        .filter(far < F.col("gap"))
        .groupBy(F.col("source").alias("c_source"), "gap")
        .agg(F.min(F.struct(far.alias("far"), "q", "doc_id", "twin", "size")).alias("c"))
        .select("c_source", "gap", F.col("c.doc_id").alias("c_id"), F.col("c.twin").alias("c_twin"), F.col("c.size").alias("c_size"))
    )


def _sized(docs: DataFrame, by_size: bool) -> DataFrame:
    sized = docs.select("doc_id", words(F.col("text")).alias("size"), "source")
    return sized.withColumn("appeal", size_appeal(F.col("size")) if by_size else F.lit(1.0))


def copies_of(docs: DataFrame, seed: str = "mix-", by_size: bool = False) -> DataFrame:
    """docs, all columns, each row as often as ``mix`` takes it, with copy_no from 1 (which replaces a column of that name).

    ``by_size``: expected copies follow ``size_appeal``; else they are the same for all documents of a source.

    Rows that agree in doc_id, size and source are interchangeable; only those that repeat are numbered. Documents
    that are not taken, and those of no words, of which the number of copies does not matter, are as ``mix`` has them.
    """
    names = [c for c in docs.columns if c != "copy_no"]

    def key(doc_id: Column, source: Column, size: Column) -> list[Column]:
        parts = [doc_id, doc_id.isNull(), source, source.isNull(), size]
        return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]

    plan = mix(_sized(docs, by_size), seed).groupBy(*[c.alias(OWN + n) for c, n in zip(key(F.col("doc_id"), F.col("source"), F.col("size")), "ab", strict=True)])
    plan = settle(plan.agg(F.array_sort(F.collect_list("copies")).alias(OWN + "copies")).filter(F.array_max(OWN + "copies") > 0), "mix-plan")
    keyed = docs.select(*names, *[c.alias(OWN + n) for c, n in zip(key(F.col("doc_id"), F.col("source"), words(F.col("text"))), "ab", strict=True)])
    taken = keyed.join(plan, [OWN + "a", OWN + "b"])
    alone = taken.filter(F.size(OWN + "copies") == 1).withColumn(OWN + "n", F.lit(1))
    twins = taken.filter(F.size(OWN + "copies") > 1).withColumn(OWN + "n", F.row_number().over(Window.partitionBy(OWN + "a", OWN + "b").orderBy(OWN + "a")))
    times = F.element_at(F.col(OWN + "copies"), F.col(OWN + "n")).cast("int")
    rows = alone.unionByName(twins).withColumn(OWN + "times", times).filter(F.col(OWN + "times") > 0)
    return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col(OWN + "times"))).alias("copy_no"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(table(spark, sf_dir, "documents"), by_size=True)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
