"""Exact Jaccard self-join of documents' shingle sets with signature trees.

A document's set holds 64-bit hashes of its distinct word shingles. Equal sets are one class.

Candidates (exact), by parts: two sets with Jaccard similarity of at least ``num / den`` differ in at most
``(den - num) / (den + num)`` of their sizes' sum. Tokens are dealt by hash into one part more than
that difference can have at a size, so such sets agree in at least one whole part. Sizes are banded
so that both sets of a pair are dealt the same way. Only part hashes are shuffled.

Candidates (exact), by prefixes: where parts would hold fewer than ``PART_TOKENS`` tokens, they would often agree by
chance, and the tokens themselves are shuffled instead. In any one order of all tokens, linked sets share m
among the first ``size - ceil(size * num / den) + m`` of each. Only these are shuffled, in the order of the hashes, with m a tenth
or so of the size. Of these in turn, all but m - 1 must share one in any order. That order puts tokens of a single set first, so
a set takes part only if m of them occur elsewhere, and then rare ones, so that common ones seldom bring sets together.

Rows that share a key within a task's batch leave it as one row of that key, so that a key of a third of all rows
is spread.

Verification: classes that share a key form candidate groups. A group is cut into blocks of bounded
size; in each block a signature tree is built, whose nodes hold the OR of their sets' token bitmaps,
the range of sizes, and the largest number of tokens that share a bit with another token of their set.
A dual traversal drops node pairs whose largest possible overlap is below what their sizes need, and
pairs whose sets are in one component already; pairs of sets are verified on the sets themselves.
For groups of several blocks, one member of each component of each block is joined next, and then
members outside the group's largest component against the blocks of their own size class and its
neighbours, so that no link between components is lost and no block meets all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysift.llm.bitset import MAYBE, OWN, bitset, maybe_in
from tallysift.llm.textcodes import SYMBOL, UNBASE, flat, mixed, powers, span_hashes, sums, word_spans
from tallysift.operators.components import connected_components
from tallysift.session import discard, settle, table

#: Bytes of text turned into arrays at once; a longer text is taken alone.
BATCH_BYTES = 2 << 20
#: Tokens of the sets of a block, and bytes of the texts they are made from.
BLOCK_TOKENS, BLOCK_BYTES = 1 << 20, 4 << 20
#: Bytes of the bitmaps of a block's sets.
BITMAP_BYTES = 16 << 20
#: Tokens that a part must hold on average; else prefixes of tokens are the candidates' keys.
PART_TOKENS = 6
#: Of so many tokens that linked sets share, one more than must be is in the prefixes that are shuffled.
SPARE = 8
#: Children of a tree node.
FANOUT = 8
#: Fixed odd multipliers of a shingle's words, by place.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A to Z lower-cased."""
    raw, ends = flat([(t or "").encode() for t in texts])
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, stops, owner = word_spans(raw, ends)
    words = span_hashes(sums(SYMBOL[raw]), starts, stops, powers(UNBASE, len(raw) + 1))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for place in range(width):
        runs += words[place : place + n] * np.uint64(PLACES[place])
    runs = mixed(runs)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            few = words[a:b] * np.array(PLACES[: b - a], np.uint64)
            out.append(mixed(np.array([few.sum(dtype=np.uint64)]) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sized(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Lists of texts of bounded size."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text or "")
        if held >= BATCH_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    start = 0
    for some in _sized(x.as_py() for x in batch.column(column)):
        yield start, some
        start += len(some)


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        a = mixed(np.array([tokens.sum(dtype=np.uint64)])) ^ np.uint64(len(tokens))
        b = mixed(np.array([mixed(tokens ^ np.uint64(PLACES[0])).sum(dtype=np.uint64)]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


class Bands:
    """Size bands: two sets that link are in one band or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]
        self.known: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            s = self.starts[-1]
            self.starts.append(max(s + 1, -(-s * self.den // self.num)))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Parts that sets of this band and the one below are dealt into, and the most tokens in which two may differ.

        There are enough parts for more of them to have tokens than two sets can differ in, at nearly all sets.
        """
        if band not in self.known:
            while len(self.starts) < band + 2:
                self.of(self.starts[-1])
            most = 2 * (self.starts[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            least, n = self.starts[max(band - 1, 0)], most + 1
            while n < 2 * most + 1:
                empty = n * float(np.exp(-least / n))
                if n - empty - 3 * empty**0.5 > most:
                    break
                n += 1
            self.known[band] = (n, most)
        return self.known[band]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Part hashes of a set under the dealings of its band and of the next.

        Of two sets that link, at most ``most`` parts differ. If a set has tokens in more parts than that, one of these
        is equal in the other, and its empty parts need no key; else its empty parts have keys too.
        """
        band, out = self.of(len(tokens)), []
        for scheme in (band, band + 1):
            n, most = self.parts(scheme)
            part = (tokens >> np.uint64(20)) % np.uint64(n)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(n + 1))
            run = np.zeros(len(tokens) + 1, np.uint64)
            np.cumsum(mixed(tokens[order]), out=run[1:])
            total, size = run[at[1:]] - run[at[:-1]], np.diff(at)
            key = mixed(total + mixed(np.arange(n, dtype=np.uint64) + np.uint64(scheme << 32)) + size.astype(np.uint64))
            out.append(key[size > 0] if (size > 0).sum() > most else key)
        return np.concatenate(out).view(np.int64)


def bitmap_bits(*sides: list[np.ndarray]) -> int:
    """Bits of the bitmaps of trees that are traversed together: of one width, whatever the sizes and numbers of their sets."""
    largest, most = max((len(s) for side in sides for s in side), default=1), max(map(len, sides))
    bits = 1 << max(9, int(4 * largest - 1).bit_length())
    return min(bits, 1 << 15, 1 << max(9, (8 * BITMAP_BYTES // max(1, most)).bit_length() - 1))


class Tree:
    """Signature tree over sets, in the order given by size and least token."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort(([int(s[0]) for s in sets], sizes)) if len(sets) else np.zeros(0, np.int64)
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            place = (s >> np.uint64(40)) % np.uint64(bits)
            np.bitwise_or.at(maps[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        slack = self.sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: From leaves up: bitmaps, least and largest size, slack, first set and the set after the last.
        at = np.arange(len(sets))
        self.levels = [(maps, self.sizes, self.sizes, slack, at, at + 1)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, s, a, b = self.levels[-1]
            cut = np.arange(0, len(m), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(s, cut), a[cut], np.maximum.reduceat(b, cut))
            )


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether any set below node i of level x and any below node j of level y can link."""
    fits = (x[2][i] * den >= y[1][j] * num) & (y[2][j] * den >= x[1][i] * num)
    overlap = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][i], y[3][j])
    # |A & B| * (num + den) >= num * (|A| + |B|)
    return fits & (overlap * (num + den) >= num * (x[1][i] + y[1][j]))


def tree_links(left: Tree, right: Tree | None, label_left: np.ndarray, label_right: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of two trees (or of one) that join components; labels are changed in place.

    A pair is (place in left.sets, place in right.sets). Labels of both sides come from one numbering.
    """
    own = right is None
    right, label_right = (left, label_left) if own else (right, label_right)
    if not left.sets or not right.sets:
        return []
    found: list[tuple[int, int]] = []

    members: dict[int, list[tuple[np.ndarray, int]]] = {}
    for labels in (label_left,) if own else (label_left, label_right):
        for i, x in enumerate(labels.tolist()):
            members.setdefault(x, []).append((labels, i))

    def joined(a: int, b: int) -> None:
        keep, gone = int(label_left[a]), int(label_right[b])
        if keep == gone:
            return
        if len(members[keep]) < len(members[gone]):
            keep, gone = gone, keep
        for labels, i in members[gone]:
            labels[i] = keep
        members[keep] += members.pop(gone)

    def visit(level: int, other: int, i: int, j: int) -> None:
        x, y = left.levels[level], right.levels[other]
        lx, ly = label_left[x[4][i] : x[5][i]], label_right[y[4][j] : y[5][j]]
        if lx[0] == ly[0] and (lx == lx[0]).all() and (ly == lx[0]).all():
            return
        if level == 0 and other == 0:
            a, b = left.sets[i], right.sets[j]
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common * den >= num * (len(a) + len(b) - common):
                found.append((i, j))
                joined(i, j)
            return
        # the higher node is opened
        down = level >= other
        kids = np.arange((i if down else j) * FANOUT, min(((i if down else j) + 1) * FANOUT, len((left if down else right).levels[(level if down else other) - 1][0])))
        if own and level == other:
            again = np.arange(j * FANOUT, min((j + 1) * FANOUT, len(right.levels[other - 1][0])))
            p, q = (g.ravel() for g in np.meshgrid(kids, again, indexing="ij"))
            if i == j:
                p, q = p[p <= q], q[p <= q]
            level, other = level - 1, other - 1
            if level == 0:
                p, q = p[p != q], q[p != q]
        else:
            p = kids if down else np.full(len(kids), i)
            q = np.full(len(kids), j) if down else kids
            level, other = (level - 1, other) if down else (level, other - 1)
        good = possible(left.levels[level], p, right.levels[other], q, num, den)
        if own and level > 0:
            good |= p == q
        for a, b in zip(p[good].tolist(), q[good].tolist(), strict=True):
            visit(level, other, a, b)

    visit(len(left.levels) - 1, len(right.levels) - 1, 0, 0)
    return found


def _links_in(rows: pa.Table, width: int, num: int, den: int) -> pa.Table:
    """Links of a block: rows (id, side, comp, text); sides 0 and 1 are joined if both occur, else the one with itself."""
    first: dict[tuple[int, int], int] = {}
    for i, at in enumerate(zip(rows.column("side").to_pylist(), rows.column("id").to_pylist(), strict=True)):
        first.setdefault(at, i)
    comps, texts = rows.column("comp").to_pylist(), rows.column("text")
    numbers: dict[int, int] = {}
    dealt, sides = [], []
    for side in (0, 1):
        keys, at = [k for s, k in first if s == side], [i for (s, _), i in first.items() if s == side]
        sets = [x for some in _sized(texts[i].as_py() for i in at) for x in shingle_sets(some, width)]
        dealt.append((keys, at, sets))
    bits = bitmap_bits(*(sets for _, _, sets in dealt))
    for keys, at, sets in dealt:
        tree = Tree(sets, bits)
        labels = np.array([numbers.setdefault(comps[i], len(numbers)) for i in at], np.int64)[tree.order] if keys else np.zeros(0, np.int64)
        sides.append(([keys[i] for i in tree.order], tree, labels))
    (ka, ta, la), (kb, tb, lb) = sides
    if kb and ka:
        pairs = [(ka[i], kb[j]) for i, j in tree_links(ta, tb, la, lb, num, den)]
    else:
        keys, tree, labels = sides[0] if ka else sides[1]
        pairs = [(keys[i], keys[j]) for i, j in tree_links(tree, None, labels, None, num, den)]
    return pa.table({"src": pa.array([a for a, _ in pairs], pa.int64()), "dst": pa.array([b for _, b in pairs], pa.int64())})


def _dealt(texts: DataFrame, width: int, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, id, n): the keys of each set, once for each batch of a task.

    Where several sets of a batch have a key, the first one has a row with their number n; the others have rows of n = 0
    with the exclusive or of key and id as key, which deals them at random.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for _, some in _chunks(batch, 2):
                keys, names = [], []
                if len(done) > 1 << 20:
                    done.clear()  # copies are dealt once a task as a saving, not as a condition
                for tokens in shingle_sets(some, width):
                    if not len(tokens) or (name := identity(tokens)) in done:
                        continue
                    done.add(name)
                    keys.append(keys_of(tokens))
                    names.append(np.full(len(keys[-1]), name[0], np.int64))
                if not keys:
                    continue
                key, name = np.concatenate(keys), np.concatenate(names)
                order = np.argsort(key)
                key, name = key[order], name[order]
                head = np.concatenate([[True], key[1:] != key[:-1]])
                n = np.zeros(len(key), np.int32)
                n[head] = np.diff(np.append(np.flatnonzero(head), len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(head, key, key ^ name)), pa.array(name), pa.array(n)], ["key", "id", "n"])

    return texts.mapInArrow(deal, "key long, id long, n int")


def _shared(dealt: DataFrame, count: bool = False) -> DataFrame:
    """(key, id) of keys of several ids, settled; a row may repeat. ``count``: with df, some number of rows that is the same in all rows of a key, else null."""
    by_key = Window.partitionBy("key")
    found = dealt.withColumn("shared", (F.max("n").over(by_key) > 1) | (F.min("id").over(by_key) != F.max("id").over(by_key)))
    key = F.when(F.col("n") == 0, F.col("key").bitwiseXOR(F.col("id"))).otherwise(F.col("key"))
    df = []
    if count:
        found, df = found.withColumn("df", F.sum("n").over(by_key)), [F.when(F.col("n") > 0, F.col("df")).alias("df")]
    return settle(found.filter("n = 0 or shared").select(key.alias("key"), "id", *df), "jaccard-shared")


def _stars(shared: DataFrame) -> DataFrame:
    """Edges from the least id of each key to its others."""
    least = shared.groupBy("key").agg(F.min("id").alias("src"))
    return shared.join(least, "key").filter(F.col("id") != F.col("src")).select("src", F.col("id").alias("dst")).distinct()


def _share_part(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Edges between classes that agree in a part."""
    bands = Bands(num, den)
    return _stars(_shared(_dealt(texts, width, bands.keys)))


def in_prefixes(size: int | Column, num: int, den: int):
    """Tokens that sets of this size or larger, if linked, share in their prefixes; never less for larger sizes."""
    if isinstance(size, Column):
        return F.greatest(F.lit(1), F.floor(size * num / (SPARE * den)))
    return max(1, size * num // (SPARE * den))


def prefix(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of a set by hash: two sets that link share ``in_prefixes`` of the smaller one's size in these."""
    n = len(tokens)
    return tokens[: n - -(-n * num // den) + in_prefixes(n, num, den)]


def _share_prefix(texts: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Edges between classes whose prefixes share a token."""
    shared = _shared(_dealt(texts, width, lambda tokens: prefix(tokens, num, den).view(np.int64)), count=True)
    # rows that were dealt at random do not know how often their key is
    counts = shared.filter("df is not null").groupBy("key").agg(F.max("df").alias("often"))
    of_set = Window.partitionBy("id")
    ranked = (
        shared.select("key", "id")
        .join(counts, "key")
        .join(classes.select(F.col("node").alias("id"), "n"), "id")
        .withColumn("rank", F.dense_rank().over(of_set.orderBy("often", "key")))
        .withColumn("known", F.max("rank").over(of_set))
        # a set of this size may link with one as small as that; tokens of this set alone come before those
        .withColumn("first", F.col("known") - in_prefixes(F.ceil(F.col("n") * num / den), num, den) + 1)
    )
    return _stars(settle(ranked.filter("rank <= first").select("key", "id").distinct(), "jaccard-prefixes"))


LINKS = "src long, dst long"


def jaccard_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, t, n_shingles, component, component_id) of every row of (doc_id, text).

    component_id is the least doc_id reachable by links of Jaccard similarity >= num / den, the row's
    own included; null ids come last. Texts without words (null, empty, blank) have 0 shingles and their own
    doc_id. Rows that repeat are rows of one class. t is a hash of the text.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _chunks(batch, 2):
                sets = shingle_sets(some, width)
                names = [identity(s) for s in sets]
                part = batch.slice(start, len(some))
                numbers = [[len(s) for s in sets], [len(t or "") for t in some], [a for a, _ in names], [b for _, b in names]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in numbers)], ["doc_id", "t", "n_shingles", "chars", "set_a", "set_b"])

    rows = settle(texts.mapInArrow(describe, "doc_id long, t long, n_shingles long, chars long, set_a long, set_b long"), "jaccard-sets")
    # of each class one row stands for it
    classes = rows.filter("n_shingles > 0").groupBy(F.col("set_a").alias("node")).agg(
        F.min(F.struct("doc_id", "t", "chars")).alias("home"), F.max("n_shingles").alias("n")
    )
    if den + num >= 2 * PART_TOKENS * (den - num):
        met = _share_part(texts, width, num, den)
    else:
        met = _share_prefix(texts, classes, width, num, den)
    met = settle(met, "jaccard-met")
    groups = settle(connected_components(met), "jaccard-groups")

    # the text of each class in a candidate group, from one row, and its block; sets are made where they meet
    members = groups.join(classes, "node").select(
        F.col("node").alias("id"), "root", F.struct("home.doc_id", "home.t").alias("home"), "n", F.col("home.chars").alias("chars")
    )
    members = settle(members, "jaccard-members")
    sizes = members.groupBy("root").agg(_bounded().alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    loose, members = members, settle(members.join(sizes, "root").select("id", "root", "home", "n", "chars", "blocks", block), "jaccard-blocks")
    discard(met, groups, loose)
    home = F.struct("doc_id", "t")
    some = maybe_in(texts.select("text", home.alias("at")), F.col("at"), bitset(members, "home")).filter(MAYBE)
    placed = some.join(members, F.col("at").eqNullSafe(F.col("home"))).select("id", "text", "n", "chars", "root", "blocks", "block")

    def links(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).applyInArrow(lambda t: _links_in(t, width, num, den), LINKS)

    alone = placed.select("id", "text", "root", "block", F.lit(0).alias("side"), F.col("id").alias("comp"))
    found = settle(links(alone, "root", "block"), "jaccard-links")
    if not members.filter("blocks > 1").isEmpty():
        found = _across(settle(placed.filter("blocks > 1"), "jaccard-placed"), found, links, den / num)
    comps = connected_components(found)
    named = rows.filter("n_shingles > 0").select("doc_id", "t", "n_shingles", "set_a", "set_b")
    linked = named.join(comps.select(F.col("node").alias("set_a"), "root"), "set_a", "left").withColumn("root", F.coalesce("root", "set_a"))
    linked = settle(linked, "jaccard-roots")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", "t", "n_shingles", "component", "component_id"]
    empty = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    return linked.join(least, "root").withColumnRenamed("root", "component").select(columns).unionByName(empty.select(columns))


def _bounded() -> Column:
    """The number of blocks that hold the rows of an aggregate."""
    return (F.greatest(F.floor(F.sum("n") / BLOCK_TOKENS), F.floor(F.sum("chars") / BLOCK_BYTES)) + 1).cast("int")


def _across(wide: DataFrame, found: DataFrame, links, ratio: float) -> DataFrame:
    """Links between the blocks of groups that have several; no set that links is more than ratio times the other."""
    # a little wider than the ratio, so that rounding never puts sets that link further apart than in neighbours
    wide = wide.withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.01 * ratio))).cast("int"))
    at = ["root", "class"]

    def comps_now() -> DataFrame:
        comps = settle(connected_components(found), "jaccard-comps")
        return settle(
            wide.join(comps.select(F.col("node").alias("id"), F.col("root").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c"),
            "jaccard-wide",
        )

    now = comps_now()
    # one member of each component of each block, in blocks again, by size
    firsts = now.groupBy("root", "block", "comp").agg(F.min_by("id", F.xxhash64("id")).alias("id")).select("id")
    reps = now.dropDuplicates(["id"]).join(firsts, "id", "left_semi")
    reps = reps.drop("blocks").join(reps.groupBy(at).agg(_bounded().alias("blocks")), at)
    reps = reps.select(*at, F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "id", "text", F.lit(0).alias("side"), "comp")
    found = settle(found.unionByName(links(reps, *at, "block")), "jaccard-links")
    now = comps_now()
    # members outside the largest component of their group against all of their size class and its neighbours
    sizes = now.groupBy("root", "comp").agg(F.count("*").alias("m"))
    tops = sizes.groupBy("root").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    open_ = settle(now.drop("block", "blocks").join(tops.select("root", F.col("top.comp").alias("top")), "root"), "jaccard-open")
    small = open_.filter("comp <> top").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    totals = settle(open_.groupBy(at).agg(_bounded().alias("blocks")).join(small.groupBy(at).agg(_bounded().alias("chunks")), at), "jaccard-totals")
    part = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = small.join(totals, at).withColumn("chunk", part(2, "chunks")).withColumn("block", each("blocks")).withColumn("side", F.lit(0))
    right = open_.join(totals, at).withColumn("block", part(3, "blocks")).withColumn("chunk", each("chunks")).withColumn("side", F.lit(1))
    columns = [*at, "block", "chunk", "id", "text", "side", "comp"]
    return settle(found.unionByName(links(left.select(columns).unionByName(right.select(columns)), *at, "block", "chunk")), "jaccard-links")


def keep_first(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """docs, all columns, with one row of each group of ``jaccard_components``: the first by doc_id and a hash of the text.

    Texts without words are in no group and stay. Rows that agree in doc_id and text are one document, of
    which one row stays if it has words. Only rows of groups of several rows are shuffled.
    """
    rows = jaccard_components(docs.select("doc_id", "text"), width, num, den)
    rows = rows.filter("n_shingles > 0").select(F.struct("doc_id", "t").alias("row"), "component")
    groups = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1")
    wide = settle(rows.distinct().join(groups, "component").select("row", (F.col("row").eqNullSafe(F.col("first"))).alias("stays")), "near-groups")
    row = F.struct(F.col("doc_id"), F.xxhash64("text").alias("t"))
    split = maybe_in(docs, row, bitset(wide, "row"))
    names = docs.columns
    marks = wide.select(F.col("row").alias(OWN + "of"), F.col("stays").alias(OWN + "stays"))
    touched = split.filter(MAYBE).withColumn(OWN + "row", row).join(marks, F.col(OWN + "row").eqNullSafe(F.col(OWN + "of")), "left")
    # maps have no order, but their text has
    order = [F.col(c).cast("string") if "map<" in kind else F.col(c) for c, kind in docs.dtypes if c != "text"]
    same = Window.partitionBy(OWN + "row").orderBy(*order)
    touched = touched.withColumn(OWN + "n", F.row_number().over(same)).filter(f"{OWN}stays is null or ({OWN}stays and {OWN}n = 1)")
    return split.filter(~F.col(MAYBE)).select(names).unionByName(touched.select(names))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
