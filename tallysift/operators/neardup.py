"""Near duplicates by Hamming distance of 64-bit hashes: joins, nearest neighbours, groups."""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysift.functions.scalar import hamming
from tallysift.operators import blocks
from tallysift.operators.components import connected_components
from tallysift.session import settle

#: Comparisons of two hashes in blocks that take as long as a pair that meets under an equal key.
MET_COST = 200
#: Rows from which a search for the nearest tries small distances first.
MANY = 1_000_000


#: Keys of a hash at most, when several bands must agree.
MOST_KEYS = 400


def bands(h: Column, count: int) -> list[Column]:
    """The hash cut into ``count`` bands of nearly the same width."""
    out, at = [], 0
    for i in range(count):
        width = 64 // count + (1 if i < 64 % count else 0)
        out.append(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
        at += width
    return out


def keys_met(distance: int, equal: int, rows: int) -> float:
    """Keys of a random hash and the hashes of ``rows`` others that it meets under them, if ``equal`` bands are to be equal."""
    return comb(distance + equal, equal) * (1 + rows / 2 ** (64 * equal / (distance + equal)))


def equal_bands(distance: int, rows: int) -> int:
    """How many of ``distance`` + that many bands are to be equal, so that the fewest pairs of ``rows`` random hashes meet."""
    return min((g for g in range(1, 5) if g == 1 or comb(distance + g, g) <= MOST_KEYS), key=lambda g: keys_met(distance, g, rows))


def spares(distance: int, rows: int) -> bool:
    """Whether equal bands take less time than comparing all ``rows`` hashes."""
    return keys_met(distance, equal_bands(distance, rows), rows) * MET_COST < rows


def band_keys(h: Column, distance: int, equal: int) -> Column:
    """Keys of all choices of ``equal`` bands of ``distance + equal``: of two hashes within the distance one key at least is the same."""
    parts = bands(h, distance + equal)
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(*[parts[k] for k in some]).alias("value")) for i, some in enumerate(combinations(range(distance + equal), equal))])


def id_type(rows: DataFrame, name: str = "id") -> str:
    return rows.schema[name].dataType.simpleString()


def hamming_pairs(left: DataFrame, right: DataFrame, distance: int, banded: bool | None = None) -> DataFrame:
    """(a, b, d) of rows (id, h) of left and right within ``distance`` bits, a < b if both are the same table.

    Hashes meet block by block (``blocks``), or only where a choice of bands is equal (``equal_bands``). The
    result is the same. ``banded=None`` decides by a count of both. Distances of a third of the bits and more are
    met by chance, so that equal bands spare nothing.
    """
    same = left is right
    n_left = left.count()
    n_right = n_left if same else right.count()
    rows = max(n_left, n_right)
    if banded is None:
        banded = spares(distance, rows)
    if not banded:
        x = blocks.cut(left, blocks.blocks_for(n_left))
        y = x if same else blocks.cut(right, blocks.blocks_for(n_right))
        found = blocks.against(x, y, partial(blocks.pairs_of, distance=distance), f"a {id_type(left)}, b {id_type(right)}, d int")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").filter("a < b") if same else found
    a = left.select(F.col("id").alias("a"), F.col("h").alias("ha"))
    b = right.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    near = hamming(F.col("ha"), F.col("hb")) <= distance
    order = F.col("a") < F.col("b") if same else F.lit(True)
    equal = equal_bands(distance, rows)
    x = a.withColumn("at", F.explode(band_keys(F.col("ha"), distance, equal)))
    y = b.withColumn("at", F.explode(band_keys(F.col("hb"), distance, equal)))
    pairs = x.join(y, (x["at"] == y["at"]) & near & order).drop("at").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("d"))


#: Distances that a search for the nearest tries before it compares what is left with all rows.
RADII = (4, 8, 12)


def nearest(left: DataFrame, right: DataFrame, distance: int = 64, banded: bool | None = None) -> DataFrame:
    """(id, nearest, d): for each row of left the nearest of right within ``distance``, of equals the least id.

    Rows meet block by block, of which each row hands on its nearest only. From ``MANY`` rows on the distance grows, as long as
    equal bands spare comparisons: rows whose nearest is found within a radius are done.
    """
    out, rest = None, left
    n_right = right.count()
    radii = [r for r in RADII if r < distance and spares(r, n_right)] if n_right >= MANY else []
    if banded is not None:
        radii = [r for r in RADII if r < distance] if banded else []

    def least(pairs: DataFrame) -> DataFrame:
        found = pairs.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("d", "b")).alias("m"))
        return found.select("id", F.col("m.b").alias("nearest"), F.col("m.d").alias("d"))

    for radius in radii:
        found = settle(least(hamming_pairs(rest, right, radius, True)), "nearest")
        out = found if out is None else out.unionByName(found)
        rest = settle(rest.join(found, "id", "left_anti"), "nearest-rest")
    x, y = blocks.cut(rest, blocks.blocks_for(rest.count())), blocks.cut(right, blocks.blocks_for(n_right))
    last = least(blocks.against(x, y, partial(blocks.nearest_of, distance=distance), f"a {id_type(left)}, b {id_type(right)}, d int"))
    return last if out is None else out.unionByName(last)


def within(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """The rows of left (id, h) that have any of right within ``distance``."""
    return left.join(nearest(left, right, distance).select("id"), "id", "left_semi")


def outside_largest(rows: DataFrame) -> DataFrame:
    """Rows of (root) that are not of the largest root."""
    top = rows.groupBy("root").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "root")).alias("top"))
    return rows.join(F.broadcast(top.select(F.col("top.root").alias("top"))), F.col("root") != F.col("top")).select(rows.columns)


def across(rows: DataFrame, run, schema: str) -> DataFrame:
    """``blocks.against`` over rows (id, h, root), tagged by root, but for pairs of rows of the largest root."""
    n = rows.count()
    every = blocks.cut(rows, blocks.blocks_for(n), "root")
    rest = settle(outside_largest(rows), "outside")
    n_rest = rest.count()
    # pairs of two rows outside come twice, so that most of the rows are better compared with each other
    return blocks.against(every if 2 * n_rest > n else blocks.cut(rest, blocks.blocks_for(n_rest), "root"), every, run, schema)


def near_groups(rows: DataFrame, distance: int) -> DataFrame:
    """(id, root) of every row (id, h), groups by links within ``distance``; root is the least id of its component.

    The same as ``groups`` of ``hamming_pairs``, without the pairs: a task hands on links enough to join what its
    pairs join. Of more than one block, all rows meet the first one, and then rows outside the largest group meet all others, so
    that only pairs that are joined already are left out.
    """
    some = rows.filter("id is not null and h is not null").select("id", "h")
    n = some.count()
    count = blocks.blocks_for(n)
    every = blocks.cut(some, count)
    kind = id_type(rows)
    links = partial(blocks.links_of, distance=distance)
    edges = f"src {kind}, dst {kind}"
    if n < blocks.FEW_ROWS:
        return _rooted(rows, settle(blocks.against(every, every, links, edges), "near-links"))
    first = settle(blocks.against(every.filter("block = 0"), every, links, edges), "near-links")
    rooted = settle(_rooted(rows, first), "near-roots")
    placed = some.join(rooted.dropDuplicates(["id"]), "id")
    more = settle(across(placed, links, edges), "near-links")
    if more.isEmpty():
        return rooted
    comps = connected_components(more).withColumnRenamed("root", "least")
    return rooted.join(comps, F.col("root") == F.col("node"), "left").select("id", F.coalesce("least", "root").alias("root"))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    comps = connected_components(links)
    return rows.select("id").join(comps.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def closest_groups(members: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """(x, y, d): the groups of (id, root) that are nearest to each other by pairs (a, b, d); a report of ``most`` rows."""
    of = lambda side, name: members.select(F.col("id").alias(side), F.col("root").alias(name))
    linked = pairs.join(of("a", "ra"), "a").join(of("b", "rb"), "b").filter("ra <> rb")
    best = linked.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min("d").alias("d"))
    return best.orderBy("d", "x", "y").limit(most)


def closest_near_groups(rows: DataFrame, distance: int, most: int = 8) -> DataFrame:
    """The same for groups of (id, h, root) by all pairs within ``distance``. What is among the first of all is among the first of its two blocks."""
    kind = id_type(rows, "root")
    found = across(rows.filter("root is not null"), partial(blocks.closest_of, distance=distance, most=most), f"x {kind}, y {kind}, d int")
    return found.groupBy("x", "y").agg(F.min("d").alias("d")).orderBy("d", "x", "y").limit(most)


def groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root) of every node; root is the least id of its component."""
    comps = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return nodes.join(comps.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def majority_regroup(members: DataFrame) -> DataFrame:
    """(id, root, side, new_side) of rows (id, root, side): a group goes where most of its members are; a tie
    goes to the side of its least member. side is 'val' or 'train'."""
    votes = members.groupBy("root").agg(
        F.count_if(F.col("side") == "val").alias("v"), F.count_if(F.col("side") == "train").alias("t"), F.min_by("side", "id").alias("first_side")
    )
    target = F.when(F.col("v") > F.col("t"), "val").when(F.col("v") == F.col("t"), F.col("first_side")).otherwise("train")
    return members.join(votes.select("root", target.alias("new_side")), "root").select("id", "root", "side", "new_side")


def quarantine(rows: DataFrame, distance: int) -> DataFrame:
    """(id): val rows of (id, h, side) whose nearest train row is within ``distance``, and those train rows."""
    val, train = rows.filter("side = 'val'").select("id", "h"), rows.filter("side = 'train'").select("id", "h")
    close = settle(nearest(val, train, distance), "quarantine")
    return close.select("id").unionByName(close.select(F.col("nearest").alias("id"))).distinct()


def greedy_until(clusters: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Clusters (root, n, pos, neg) taken whole, largest first, then by root, until every floor is met.

    Clusters of a size are summed first; only those of the size at which the floors are met are ordered.
    """
    sums = clusters.groupBy("n").agg(*[F.sum(c).alias(f"s_{c}") for c in floors if c != "n"], F.sum("n").alias("s_n"))
    before = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("n").alias("size"), *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in floors])
    within = Window.partitionBy("n").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    held = clusters.join(sums, F.col("n") == F.col("size")).select(
        *clusters.columns, *[(F.col(f"b_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"h_{c}") for c in floors]
    )
    met = F.lit(True)
    for c, floor in floors.items():
        met = met & (F.col(f"h_{c}") >= floor)
    return held.filter(~met).select(*clusters.columns)


def three_way(rows: DataFrame, distance: int, floors: dict[str, int]) -> DataFrame:
    """(id, root, part) of rows (id, h, root, side, label): holdout, calibration, train or quarantine.

    Val rows are the holdout, but for those within ``distance`` of a train row, which are in quarantine with it. Groups all
    in train and without a row in quarantine are taken whole, largest first, until the floors n, pos and neg are met: the
    calibration part. The rest is train.
    """
    held = quarantine(rows.select("id", "h", "side"), distance).withColumn("held", F.lit(True))
    marked = settle(rows.join(held, "id", "left").select("id", "root", "side", "label", F.coalesce("held", F.lit(False)).alias("held")), "three-way")
    clusters = marked.groupBy("root").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.bool_and((F.col("side") == "train") & ~F.col("held")).alias("free")
    )
    taken = greedy_until(clusters.filter("free").drop("free"), floors).select("root", F.lit(True).alias("taken"))
    part = F.when(F.col("held"), "quarantine").when(F.col("side") == "val", "holdout").when(F.col("taken"), "calibration").otherwise("train")
    return marked.join(taken, "root", "left").select("id", "root", part.alias("part"))


def _reached(parts: DataFrame, floors: dict[str, dict[str, int]]) -> DataFrame:
    counts = parts.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    wanted = counts.sparkSession.createDataFrame([(p, c, v) for p, f in floors.items() for c, v in f.items()], "part string, what string, floor long")
    long_ = counts.select("part", F.explode(F.create_map(*[x for c in ("n", "pos", "neg") for x in (F.lit(c), F.col(c))])).alias("what", "value"))
    return wanted.join(long_, ["part", "what"], "left").select(
        F.concat_ws("_", "part", "what").alias("gate"), F.coalesce("value", F.lit(0)).cast("long").alias("value"), "floor", (F.coalesce("value", F.lit(0)) >= F.col("floor")).alias("ok")
    )


def gates(parts: DataFrame, pairs: DataFrame, floors: dict[str, dict[str, int]]) -> DataFrame:
    """(gate, value, floor, ok) of rows (id, part, label) and pairs (a, b): rows, positives and negatives of a part reach
    their floors, and no pair links the holdout with train or calibration."""
    reached = _reached(parts, floors)
    of = lambda side, name: parts.select(F.col("id").alias(side), F.col("part").alias(name))
    both = pairs.join(of("a", "pa"), "a").join(of("b", "pb"), "b")
    hold, rest = F.lit("holdout"), ("train", "calibration")
    crossing = ((F.col("pa") == hold) & F.col("pb").isin(*rest)) | ((F.col("pb") == hold) & F.col("pa").isin(*rest))
    return reached.unionByName(_no_links(both.agg(F.count_if(crossing).alias("value"))))


def near_gates(parts: DataFrame, distance: int, floors: dict[str, dict[str, int]]) -> DataFrame:
    """``gates`` of rows (id, h, part, label), where all pairs within ``distance`` are links."""
    held, rest = parts.filter("part = 'holdout'"), parts.filter("part in ('train', 'calibration')")
    x, y = (blocks.cut(t, blocks.blocks_for(t.count())) for t in (held, rest))
    crossing = blocks.against(x, y, partial(blocks.count_of, distance=distance), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))
    return _reached(parts, floors).unionByName(_no_links(crossing))


def _no_links(crossing: DataFrame) -> DataFrame:
    return crossing.select(F.lit("cross_links").alias("gate"), "value", F.lit(0).cast("long").alias("floor"), (F.col("value") == 0).alias("ok"))


def require_gates(found: DataFrame) -> None:
    """Fails with the gates that do not hold."""
    wrong = found.filter("not ok").orderBy("gate").collect()
    if wrong:
        raise ValueError("; ".join(f"{r['gate']}: {r['value']}, floor {r['floor']}" for r in wrong))
