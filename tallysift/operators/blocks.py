"""Hamming distances of all pairs of 64-bit hashes, a block of one table against a block of another.

A distance of a third of the bits is met by chance, so no keys spare much there; every pair is compared, but pairs are
neither rows nor shuffled. A task takes the hashes of two blocks as arrays and hands on what the caller needs of their
pairs: the pairs within a distance, the nearest of each row, links enough to join what they join, or a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.session import settle

#: Rows of a block, least and most; in between a table has ``FEW`` blocks, or ``BLOCKS`` from ``FEW_ROWS`` rows on.
LEAST, MOST, FEW, BLOCKS, FEW_ROWS = 1024, 1 << 16, 8, 24, 50_000
#: Rows of both sides whose distances are held at once: they stay in a core's cache.
TILE = (16, 4096)
#: Pairs of a batch that leaves a task, and unions after which labels are brought up to date.
BATCH, STALE = 1 << 16, 64


class Block:
    """The ids (Arrow), hashes and tags (Arrow) of rows, in the order of the ids."""

    def __init__(self, ids: pa.Array, hashes: pa.Array, tags: pa.Array):
        self.ids, self.tags = ids, tags
        self.h = hashes.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def tiles(x: Block, y: Block, own: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of x, first row of y, distances); of a block with itself only tiles that hold pairs of a row and a later one."""
    for s in range(0, len(x.h), TILE[0]):
        for t in range(s if own else 0, len(y.h), TILE[1]):
            yield s, t, np.bitwise_count(x.h[s : s + TILE[0], None] ^ y.h[None, t : t + TILE[1]])


def hits(x: Block, y: Block, own: bool, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of the pairs of each tile within the distance."""
    for s, t, d in tiles(x, y, own):
        at = np.flatnonzero(d <= distance)
        if len(at):
            r, c = np.divmod(at, d.shape[1])
            a, b, near = r + s, c + t, d.ravel()[at]
            if own:
                later = a < b
                a, b, near = a[later], b[later], near[later]
            yield a, b, near


def pairs_of(x: Block, y: Block, own: bool, distance: int) -> Iterator[list[pa.Array]]:
    """a, b, d of all pairs within the distance."""
    some, held = [], 0

    def out() -> list[pa.Array]:
        a, b, d = (np.concatenate(p) for p in zip(*some, strict=True))
        return [x.ids.take(pa.array(a)), y.ids.take(pa.array(b)), pa.array(d.astype(np.int32))]

    for found in hits(x, y, own, distance):
        some.append(found)
        held += len(found[0])
        if held >= BATCH:
            yield out()
            some, held = [], 0
    if some:
        yield out()


def nearest_of(x: Block, y: Block, own: bool, distance: int) -> Iterator[list[pa.Array]]:
    """a, b, d: of each row of x the nearest of y within the distance, of equals the one with the least id."""
    best, at = np.full(len(x.h), 255, np.uint8), np.zeros(len(x.h), np.int64)
    for s, t, d in tiles(x, y, False):
        place = d.argmin(axis=1)
        value = d[np.arange(len(d)), place]
        better = np.flatnonzero(value < best[s : s + len(d)])
        best[s + better], at[s + better] = value[better], place[better] + t
    some = np.flatnonzero(best <= distance)
    yield [x.ids.take(pa.array(some)), y.ids.take(pa.array(at[some])), pa.array(best[some].astype(np.int32))]


def tag_codes(x: Block, y: Block) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the tags of both, and the tags by code; those of x come first."""
    named = pa.concat_arrays([x.tags, y.tags]).dictionary_encode()
    codes = named.indices.to_numpy(zero_copy_only=False)
    return codes[: len(x.h)], codes[len(x.h) :], named.dictionary


def links_of(x: Block, y: Block, own: bool, distance: int) -> Iterator[list[pa.Array]]:
    """src, dst of tags: the links of all pairs within the distance join the same tags as these do."""
    cx, cy, tags = tag_codes(x, y)
    up = list(range(len(tags)))
    label, stale = np.arange(len(tags)), 0

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, b, _ in hits(x, y, own, distance):
        p, q = label[cx[a]], label[cy[b]]
        new = p != q
        for i, j in set(zip(p[new].tolist(), q[new].tolist(), strict=True)):
            i, j = root(i), root(j)
            if i != j:
                up[max(i, j)] = min(i, j)
                stale += 1
        if stale >= STALE:
            label, stale = _flat(up), 0
    label = _flat(up)
    some = np.flatnonzero(label != np.arange(len(tags)))
    yield [tags.take(pa.array(some)), tags.take(pa.array(label[some]))]


def _flat(up: list[int]) -> np.ndarray:
    label = np.array(up, np.int64)
    while True:
        further = label[label]
        if (further == label).all():
            return label
        label = further


def closest_of(x: Block, y: Block, own: bool, distance: int, most: int) -> Iterator[list[pa.Array]]:
    """x, y, d: the ``most`` pairs of different tags with the least distances, then tags; of a pair its least distance."""
    cx, cy, tags = tag_codes(x, y)
    values = tags.to_pylist()
    place = np.zeros(len(values), np.int64)
    place[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    px, py, n = place[cx], place[cy], len(values)
    by_place = np.argsort(place)
    d_of, key_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b, d in hits(x, y, own, distance):
        p, q = px[a], py[b]
        new = p != q
        if len(d_of) == most:
            new &= d <= d_of[-1]
        if new.any():
            p, q = p[new], q[new]
            d_of = np.concatenate([d_of, d[new].astype(np.int64)])
            key_of = np.concatenate([key_of, np.minimum(p, q) * n + np.maximum(p, q)])
            order = np.lexsort((key_of, d_of))
            d_of, key_of = d_of[order], key_of[order]
            first = np.sort(np.unique(key_of, return_index=True)[1])[:most]
            d_of, key_of = d_of[first], key_of[first]
    low, high = np.divmod(key_of, max(n, 1))
    yield [tags.take(pa.array(by_place[low])), tags.take(pa.array(by_place[high])), pa.array(d_of.astype(np.int32))]


def count_of(x: Block, y: Block, own: bool, distance: int) -> Iterator[list[pa.Array]]:
    """n: pairs within the distance."""
    yield [pa.array([sum(len(a) for a, _, _ in hits(x, y, own, distance))], pa.int64())]


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // MOST), min(FEW if rows < FEW_ROWS else BLOCKS, rows // LEAST))


def cut(rows: DataFrame, count: int, tag: str = "id") -> DataFrame:
    """(block, id, h, tag) of rows (id, h), settled: arrays in the order of the ids. Rows without hash are left out."""
    block = F.pmod(F.xxhash64("id", "h"), F.lit(count)).cast("int").alias("block")
    rows = rows.filter("h is not null").select(block, F.struct("id", "h", F.col(tag).alias("tag")).alias("row"))
    held = rows.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return settle(held.select("block", F.col("rows.id").alias("id"), F.col("rows.h").alias("h"), F.col("rows.tag").alias("tag")), "hash-blocks")


def against(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """What ``run(x, y, own)`` gives of all pairs of blocks of ``cut``; if both are one table, of each two blocks once."""
    spark, same = left.sparkSession, left is right
    n_left, n_right = (t.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0] for t in (left, right))
    names = [f.split()[0] for f in schema.split(", ")]
    if not n_left or not n_right:
        return spark.createDataFrame([], schema)
    parts = min(n_left * n_right, 16 * spark.sparkContext.defaultParallelism)
    to = F.sequence(F.col("i") if same else F.lit(0), F.lit(n_right - 1))
    back = F.sequence(F.lit(0), F.col("j") if same else F.lit(n_left - 1))
    x = left.withColumnRenamed("block", "i").select("i", F.explode(to).alias("j"), *[F.col(c).alias("x" + c) for c in ("id", "h", "tag")])
    y = right.withColumnRenamed("block", "j").select("j", F.explode(back).alias("i"), *[F.col(c).alias("y" + c) for c in ("id", "h", "tag")])
    met = x.repartition(parts, "i", "j").join(y.repartition(parts, "i", "j"), ["i", "j"])
    met = met.select("i", "j", "xid", "xh", "xtag", "yid", "yh", "ytag")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                sides = [batch.column(c)[k].values for c in range(2, 8)]
                for found in run(Block(*sides[:3]), Block(*sides[3:]), same and i == j):
                    yield pa.RecordBatch.from_arrays(found, names)

    return met.mapInArrow(each, schema)
