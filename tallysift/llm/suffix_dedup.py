"""Exact removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms.

A window of ``least`` bytes is removed if an equal window starts earlier; every byte under a removed
window goes. The work is divided so that equal windows meet, without the corpus in one index:

1. Each window is assigned to the least-hashed k-gram in it (the leftmost of equals), which depends on the
   window's bytes only. Neighbouring windows share theirs: a run. Only the k-gram hashes are shuffled;
   a run whose k-gram is nowhere else is done.
2. The runs left are cut out of their texts with their bytes and dealt by k-gram hash. Equal runs are copies
   and count once; the first stands for all.
3. Batches of runs are indexed: suffixes sorted, Burrows-Wheeler transform, and breadth-first backward
   extension from the empty string. Each level sets the common-prefix values of its length at the
   boundaries it finds, in increasing order, and stops at ``least``: what lies between set boundaries are
   the classes of equal windows. All but the first of a class are removed.

Copies meet within a task first (a hot k-gram or run leaves a task once), k-grams of very many
places are dealt by the bytes beside them too, and texts travel only for documents with candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysift.llm.bitset import MAYBE, bitset, maybe_in
from tallysift.llm.textcodes import SYMBOL, UNBASE, flat, mixed, powers, span_hashes, sums
from tallysift.session import settle, table

LEAST = 100
#: Bytes of the k-grams that windows are assigned to.
GRAM = 32
#: Bytes of text turned into arrays at once; a longer text is taken alone.
BATCH_BYTES = 2 << 20
#: Bytes of runs of whole groups that are indexed at once; a larger group is taken alone.
INDEX_BYTES = 1 << 20
#: A k-gram is hot if it has so many places, and more than this share of all candidates' places; its runs
#: are dealt by neighbouring bytes too. There can be no more hot k-grams than the inverse of the share.
HOT, HOT_SHARE = 10_000, 1 / 4096
#: Where a null doc_id stands: after all others.
LAST = np.iinfo(np.int64).max


class Runs:
    """Runs of windows of some texts: text, first and last window, k-gram place and hash; byte hashes."""

    def __init__(self, texts: list[bytes], least: int = LEAST, gram: int = GRAM):
        self.raw, self.ends = flat(texts)
        n, w = len(self.raw), least - gram + 1
        none = np.zeros(0, np.int64)
        self.text = self.low = self.high = self.place = none
        self.gram = none.astype(np.uint64)
        self.prefix = self.inverse = None
        if n < least:
            return
        self.prefix, self.inverse = sums(SYMBOL[self.raw]), powers(UNBASE, n + 1)
        value = mixed((self.prefix[gram:] - self.prefix[: n - gram + 1]) * self.inverse[: n - gram + 1])
        # the least of the hashes' upper halves, the leftmost of equals: the lower half is the place
        least_of = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
        span = 1
        while span < w:
            step = min(span, w - span)
            least_of = np.minimum(least_of[:-step], least_of[step:])
            span += step
        # windows that do not cross the end of their text
        inside = np.ones(n - least + 1, bool)
        for e in self.ends[1:-1].tolist():
            inside[max(0, e - least + 1) : e] = False
        starts = np.flatnonzero(inside)
        if not len(starts):
            return
        at = (least_of[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.ends))[starts].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
        self.low, self.high = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        self.text, self.place = text[new], at[new]
        self.gram = value[self.place]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hashes(self.prefix, start, end, self.inverse)


def intervals(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining ranges of the same text, in order, as one."""
    if not len(text):
        return text, low, high
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] > high[:-1] + 1)]))
    return text[new], low[new], high[np.append(new[1:], len(text)) - 1]


def _chunks(rows: list[tuple]) -> Iterator[list[tuple]]:
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[0])
        if held >= BATCH_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a text of symbols below 512, ordered by their first ``depth`` symbols at least.

    Seven symbols of nine bits are a key; the length that is sorted by doubles from there. The order of suffixes
    that agree so far does not matter.
    """
    n = len(text)
    wide = np.zeros(n + 6, np.uint64)
    wide[:n] = text
    key = wide[:n].copy()
    for i in range(1, 7):
        key = (key << np.uint64(9)) | wide[i : n + i]
    length = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        step = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
        if length >= depth or step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        length *= 2


def common_prefix_classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a text and the class of each suffix in it: equal for equal first ``least`` symbols.

    Breadth-first backward extension: the intervals of level l are those of strings of l symbols.
    Extending one by a symbol c to the left gives the interval of the suffixes that the transform maps
    c's occurrences in it to; if its right boundary has no value yet, the value is l and the interval
    goes on to the next level. The text ends in a symbol that is less than all others.
    """
    n = len(text)
    order = suffix_order(text, least)
    transform = text[order - 1]  # of suffix 0: the last symbol
    by_symbol = np.argsort(transform, kind="stable")
    mapped = np.empty(n, np.int64)
    mapped[by_symbol] = np.arange(n)
    # the next and the last place with the same symbol
    symbols = transform[by_symbol]
    same = symbols[1:] == symbols[:-1]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    value = np.full(n + 1, -1, np.int32)
    value[0] = value[n] = 0
    low, high = np.array([0]), np.array([n])
    for level in range(least):
        sizes = high - low
        many = int(sizes.sum())
        if not many:
            break
        base = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        at = np.arange(many) + base
        first = previous[at] < np.repeat(low, sizes)
        last = following[at] >= np.repeat(high, sizes)
        # intervals of different strings of a length are disjoint: in order, starts and ends pair up
        start, end = np.sort(mapped[at[first]]), np.sort(mapped[at[last]]) + 1
        new = value[end] < 0
        value[end[new]] = level
        low, high = start[new], end[new]
    return order, np.cumsum(value[:n] >= 0)


class Batch:
    """Whole groups of runs, sorted by group, bytes and place, to be indexed together."""

    def __init__(self, least: int):
        self.least, self.rows, self.size = least, [], 0

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        self.size += sum(len(r[5]) for r in rows)

    def removed(self) -> list[tuple]:
        """(doc_id, t, first window, last window) removed; rows are (key, doc, t, low, windows, bytes), distinct."""
        rows, self.rows, self.size = self.rows, [], 0
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        lengths = np.array([len(r[5]) for r in rows], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(int(begin[-1]), np.uint16)
        for b, r in zip(begin.tolist(), rows, strict=False):
            text[b : b + len(r[5])] = np.frombuffer(r[5], np.uint8)
        inside = np.ones(len(text), bool)
        inside[begin[1:] - 1] = False
        text[inside] += 1
        order, classes = common_prefix_classes(text, self.least)
        windows = np.array([r[4] for r in rows], np.int64)
        owner = np.searchsorted(begin, order, side="right") - 1
        real = order - begin[owner] < windows[owner]
        at, kind = order[real], classes[real]
        # rows are in order of doc_id and place, and so are positions in the text: the least is the first
        by = np.lexsort((at, kind))
        at, kind = at[by], kind[by]
        again = np.sort(at[1:][kind[1:] == kind[:-1]])
        owner = np.searchsorted(begin, again, side="right") - 1
        text_of, low, high = intervals(owner, again, again)
        return [(rows[o][1], rows[o][2], rows[o][3] + a - int(begin[o]), rows[o][3] + b - int(begin[o])) for o, a, b in zip(text_of.tolist(), low.tolist(), high.tolist(), strict=True)]


GONE = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
CUT = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("low", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())])


def candidates(texts: DataFrame, least: int) -> DataFrame:
    """(gram, rid, low, high, n, all): window ranges of rows whose k-grams occur elsewhere too.

    n is the number of places that the row stands for, 0 for those that another row counts.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t.encode(), r) for t, r in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if t]
            for some in _chunks(rows):
                runs = Runs([t for t, _ in some], least)
                if not len(runs.low):
                    continue
                rid = np.array([r for _, r in some], np.int64)
                order = np.argsort(runs.gram)
                sorted_ = runs.gram[order]
                new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
                size = np.diff(np.append(np.flatnonzero(new), len(new)))
                many = np.zeros(len(order), bool)
                many[order] = np.repeat(size > 1, size)
                head = order[new]
                base = runs.ends[runs.text]
                # k-grams once each, with the place of those that are alone here
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.gram[head].view(np.int64)), pa.array(rid[runs.text[head]]), pa.array((runs.low - base)[head]), pa.array((runs.high - base)[head]), pa.array(size.astype(np.int32))],
                    ["gram", "rid", "low", "high", "n"],
                )
                # and what is repeated here already
                of, low, high = intervals(runs.text[many], runs.low[many], runs.high[many])
                if len(of):
                    base = runs.ends[of]
                    spread = mixed((rid[of] ^ low).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(spread), pa.array(rid[of]), pa.array(low - base), pa.array(high - base), pa.array(np.zeros(len(of), np.int32))], ["gram", "rid", "low", "high", "n"]
                    )

    found = texts.select("rid", "text").mapInArrow(grams, "gram long, rid long, low long, high long, n int")
    by = Window.partitionBy("gram")
    return found.withColumn("all", F.sum("n").over(by)).filter("n = 0 or all > 1")


def hot_grams(found: DataFrame) -> np.ndarray:
    """At most ``1 / HOT_SHARE`` hashes of hot k-grams."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.filter(F.col("all") >= max(HOT, int(total * HOT_SHARE) + 1)).select("gram").distinct()
    return np.array([g for (g,) in hot.collect()], np.int64).view(np.uint64)


def cut_runs(texts: DataFrame, least: int, hot: np.ndarray) -> DataFrame:
    """Rows of ``CUT`` for the candidate runs of (doc_id, t, text, ranges), and of removed copies (key null)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            rows = [(t.encode(), LAST if d is None else d, h, r) for d, h, t, r in zip(*columns, strict=True)]
            rows = list({(d, h): (t, d, h, r) for t, d, h, r in rows}.values())
            for some in _chunks(rows):
                yield from _cut([r[0] for r in some], some, least, hot)

    return texts.select("doc_id", "t", "text", "ranges").mapInArrow(cut, "key long, same long, doc long, t long, low long, windows int, bytes binary")


def _cut(texts: list[bytes], rows: list[tuple], least: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    runs = Runs(texts, least)
    wanted = np.zeros(len(runs.raw) + 1, np.int8)
    for base, (_, _, _, ranges) in zip(runs.ends.tolist(), rows, strict=False):
        for r in ranges:
            wanted[base + r["low"] : base + r["high"] + 1] = 1
    at = np.flatnonzero(wanted[runs.low])
    text, low, high, place, key = runs.text[at], runs.low[at], runs.high[at], runs.place[at], runs.gram[at]
    burning = np.isin(key, hot)
    if burning.any():
        # a window has at least half of the other bytes after its k-gram, or more than half before
        half = (least - GRAM) // 2
        cold = ~burning
        t, lo, hi, p, g = text[burning], low[burning], high[burning], place[burning], key[burning]
        split = np.clip(p - half, lo, hi + 1)
        behind, before = split <= hi, split > lo
        first = mixed(g[behind] ^ runs.hashes(p[behind] + GRAM, np.minimum(p[behind] + GRAM + half, len(runs.raw))))
        second = mixed(g[before] ^ ~runs.hashes(np.maximum(p[before] - half, 0), p[before]))
        text = np.concatenate([text[cold], t[behind], t[before]])
        low = np.concatenate([low[cold], split[behind], lo[before]])
        high = np.concatenate([high[cold], hi[behind], split[before] - 1])
        key = np.concatenate([key[cold], first, second])
    if not len(low):
        return
    doc = np.array([r[1] for r in rows], np.int64)
    t = np.array([r[2] for r in rows], np.int64)
    same = runs.hashes(low, high + least)
    # of equal runs here, the first by doc_id, t and place is dealt; the others are copies of it
    order = np.lexsort((low - runs.ends[text], t[text], doc[text], same, key))
    k, s = key[order], same[order]
    first = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    later, dealt = np.sort(order[~first]), order[first]
    raw = runs.raw.tobytes()
    base = runs.ends[text]
    for some in range(0, len(dealt), 8192):
        d = dealt[some : some + 8192]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[d].view(np.int64)), pa.array(same[d].view(np.int64)), pa.array(doc[text[d]]), pa.array(t[text[d]]), pa.array((low - base)[d]), pa.array((high - low + 1)[d].astype(np.int32))]
            + [pa.array([raw[a:b] for a, b in zip(low[d].tolist(), (high[d] + least).tolist(), strict=True)], pa.binary())],
            schema=CUT,
        )
    later = later[np.lexsort((low[later], text[later]))]
    of, a, b = intervals(text[later], low[later], high[later])
    if len(of):
        none = pa.nulls(len(of), pa.int64())
        base = runs.ends[of]
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.array(doc[of]), pa.array(t[of]), pa.array(a - base), pa.array((b - a + 1).astype(np.int32)), pa.nulls(len(of), pa.binary())], schema=CUT
        )


def index_runs(cut: DataFrame, least: int) -> DataFrame:
    """Removed window ranges of rows of ``CUT`` that are sorted by key, same, doc, t and low within partitions."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, group, out = Batch(least), [], []
        last = None

        def send(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=GONE)

        for batch in batches:
            for key, same, doc, t, low, windows, raw in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if key is None:
                    out.append((doc, t, low, low + windows - 1))
                    continue
                if last is not None and key == last[0] and same == last[1] and raw == last[5]:
                    if (doc, t, low) != last[2:5]:  # a copy of the run before it
                        out.append((doc, t, low, low + windows - 1))
                    continue
                if last is not None and key != last[0]:
                    if len(group) > 1:  # a run alone holds no window twice: its k-gram has one place in it
                        whole.add(group)
                    group = []
                    if whole.size >= INDEX_BYTES:
                        out += whole.removed()
                last = (key, same, doc, t, low, raw)
                group.append((key, doc, t, low, windows, raw))
                while len(out) >= 8192:
                    yield send(out[:8192])
                    out = out[8192:]
        if len(group) > 1:
            whole.add(group)
        if whole.rows:
            out += whole.removed()
        if out:
            yield send(out)

    return cut.mapInArrow(index, "doc_id long, t long, low long, high long")


def removed_windows(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, t, low, high): ranges of windows of rows of (doc_id, t, text) that start earlier elsewhere; null ids are ``LAST``."""
    keyed = texts.withColumn("rid", F.xxhash64("doc_id", "t"))
    found = settle(candidates(keyed, least), "suffix-grams")
    hot = hot_grams(found)
    ranges = settle(found.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "suffix-candidates")
    some = maybe_in(keyed, F.col("rid"), bitset(ranges, "rid")).filter(MAYBE).join(ranges, "rid")
    # rows without a key are results already, and dealt at random
    deal = F.coalesce("key", F.xxhash64("doc", "t", "low"))
    dealt = cut_runs(some, least, hot).withColumn("deal", deal)
    parts = dealt.repartition("deal").sortWithinPartitions("key", "same", "doc", "t", "low").drop("deal")
    return settle(index_runs(parts, least), "suffix-removed")


def spans(ranges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows of ranges of first bytes."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + least))
        else:
            out.append((low, high + least))
    return out


def dedup_substrings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of (doc_id, text); kept is binary.

    Null texts are empty. Earlier is: smaller doc_id, null last; rows that share a doc_id come in the order
    of a hash of their texts; rows that agree in both are one document and get the same result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    gone = removed_windows(texts, least)
    per = settle(
        gone.groupBy("doc_id", "t").agg(F.collect_list(F.struct("low", "high")).alias("ranges")).select(F.struct("doc_id", "t").alias("row"), "ranges"),
        "suffix-ranges",
    )
    row = F.struct(F.coalesce("doc_id", F.lit(int(LAST))).alias("doc_id"), F.col("t"))
    split = maybe_in(texts, row, bitset(per, "row"))
    touched = split.filter(MAYBE).withColumn("row", row).join(per, "row", "left")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows = []
                for doc, text, ranges in zip(*(whole.slice(start, 256).column(k).to_pylist() for k in range(3)), strict=True):
                    raw = text.encode()
                    cut = spans([(r["low"], r["high"]) for r in ranges or ()], least)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(raw)], strict=True))
                    rows.append((doc, len(raw), len(raw) - len(kept), len(cut), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    whole = split.filter(~F.col(MAYBE)).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    return whole.unionByName(touched.select("doc_id", "text", "ranges").mapInArrow(strip, columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
