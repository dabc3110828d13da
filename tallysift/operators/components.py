"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.session import discard, settle

#: Edges that one task takes through a round: shuffles of so few cost more, in tasks and their logs, than they share out.
FEW = 50_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge of (src, dst); root is the least node of its component.

    Each round is two joins with per-node minima; minima are aggregated map-side, and the join that
    meets a hot centre is an inner join that adaptive execution can split. Rounds grow with the
    logarithm of the longest path, and each is written to the shared folder, so that no lineage
    builds up. Rounds of at most ``FEW`` edges are one task each. Self loops count as nodes; null ends are ignored.
    """

    def held(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if mark[0] <= FEW else rows

    named = edges.select(F.col("src"), F.col("dst")).filter("src is not null and dst is not null")
    nodes_alone = named.filter("src = dst").select(F.col("src").alias("node"))
    pairs = named.filter("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    pairs = settle(pairs, "components")
    mark = _mark(pairs)
    for _ in range(rounds):
        if not mark[0]:
            break
        ends = F.array(F.struct(F.col("hi").alias("n"), F.col("lo").alias("m")), F.struct(F.col("lo").alias("n"), F.col("hi").alias("m")))
        both = held(pairs).select(F.explode(ends).alias("e")).select("e.*")
        least = both.groupBy("n").agg(F.min("m").alias("x")).select(F.col("n").alias("c"), F.least("n", "x").alias("root"))
        large = both.filter("m > n").join(least, F.col("n") == F.col("c")).select(F.col("m").alias("hi"), F.col("root").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "c")
        small = large.join(lowest, F.col("hi") == F.col("c")).select("lo", "root").filter("lo <> root").select(
            F.col("lo").alias("hi"), F.col("root").alias("lo")
        )
        last = pairs
        pairs = settle(held(small.unionByName(lowest.select(F.col("c").alias("hi"), F.col("root").alias("lo")))).distinct(), "components")
        discard(last)
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    linked = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = held(pairs).select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    alone = nodes_alone.distinct().join(linked.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("root"))
    return linked.unionByName(roots).unionByName(alone)
