"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Texts are compared in a normal form: lower case, every run of characters other than letters and digits
one space. Items are cut into overlapping segments of so many characters, one every sixth of that, so that a passage of
``segment * 7 / 6`` characters of an item contains a whole segment. The query and the pipeline use ``SHORT_SEGMENT``. A segment of length L that occurs
with at most k edits shares at least ``L + 1 - q - k * q`` q-grams with its place, all on k + 1
neighbouring diagonals: they lie in two adjacent bands of k + 1 diagonals. Band pairs that reach the
bound are verified by alignment within the band.

The benchmark is read in blocks of bounded size; each is sent to all tasks, which read the documents
once a block, whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallysift.session import settle, table

Q = 10
#: Edits allowed a character of a segment.
RATE = 0.08
SEGMENT, SHORT_SEGMENT = 100, 72
#: Characters of benchmark items sent to the tasks at once; a longer item is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of documents turned into arrays at once; a longer document is taken alone.
BATCH_CHARS = 1 << 20
#: Places of q-grams in segments that are counted at once.
SLICE_PLACES = 1 << 21
#: Bits of the table that tells most q-grams apart from those of the benchmark.
FILTER_BITS = 23


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Lower-case form of each code point, 32 for what is neither letter nor digit."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if not c.isalnum():
            out[i] = 32
        elif len(low := c.lower()) == 1:
            out[i] = ord(low)
    return out


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts, their places in the joined texts, and the ends of each in them."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = folded()[raw]
    blank = codes == 32
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    keep = ~blank
    if len(raw):
        keep |= blank & ~np.concatenate([[True], blank[:-1]]) & ~first[:-1]
    places = np.flatnonzero(keep)
    return codes[places], places, np.searchsorted(places, ends)


#: Base of the q-gram hash, a fixed odd number.
BASE = 0x9E3779B97F4A7C15


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram that starts at each position but the last q - 1, by doubling its length."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, length = codes.astype(np.uint64), 1
    out, done = None, 0
    while True:
        if q & length:
            if out is None:
                out = power
            else:
                out = out[: len(power) - done] + power[done:] * np.uint64(pow(BASE, done, 1 << 64))
            done += length
        if done == q:
            return out[:n] * np.uint64(BASE | 1)
        power = power[: len(power) - length] + power[length:] * np.uint64(pow(BASE, length, 1 << 64))
        length *= 2


class Block:
    """Index of the segments of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], segment: int = SEGMENT):
        self.segment = segment
        self.ids, self.texts, self.budget, self.least = [], [], [], []
        grams, where = [], []
        for item, text in items:
            codes, _, _ = normal([text or ""])
            while len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) < Q:
                continue
            starts = sorted({*range(0, max(1, len(codes) - segment + 1), max(1, segment // 6)), max(0, len(codes) - segment)})
            for start in starts:
                part = codes[start : start + segment]
                k = int(RATE * len(part))
                while k and len(part) + 1 - Q - k * Q < 2:
                    k -= 1
                hashes = gram_hashes(part)
                grams.append(hashes)
                where.append(np.stack([np.full(len(hashes), len(self.ids)), np.arange(len(hashes))], 1))
                self.ids.append(item)
                self.texts.append(part)
                self.budget.append(k)
                self.least.append(len(part) + 1 - Q - k * Q)
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        where = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(grams, kind="stable")
        self.keys, self.first, self.counts = np.unique(grams[order], return_index=True, return_counts=True)
        self.where = where[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.width = max(self.budget, default=0) + 1
        self.budget, self.least = np.array(self.budget, np.int64), np.array(self.least, np.int64)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, segment, start, end, edits) of all verified places, offsets in the text as given."""
        codes, places, ends = normal(texts)
        if not len(self.keys) or len(codes) < Q:
            return []
        hashes = gram_hashes(codes)
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        key = np.searchsorted(self.keys, hashes[at])
        key[key == len(self.keys)] = 0
        real = self.keys[key] == hashes[at]
        at, key = at[real], key[real]
        owner = np.searchsorted(ends, at, side="right") - 1
        inside = at + Q <= ends[owner + 1]  # q-grams do not cross texts
        at, key, owner = at[inside], key[inside], owner[inside]
        n = self.counts[key]
        if not n.sum():
            return []
        # texts are set apart, so that a diagonal belongs to one of them
        apart = at + owner * 4 * self.segment + 2 * self.segment
        top = int(apart.max()) // self.width + 2
        bands, counts = self.counted(apart, key, n, top)
        both = counts + np.where(np.append(bands[1:], -1) == bands + 1, np.append(counts[1:], 0), 0)
        good = both >= self.least[bands // top]
        segment, low = bands[good] // top, (bands[good] % top) * self.width - 2 * self.segment
        if not len(segment):
            return []
        # the text whose diagonals these are, and the first diagonal in its own numbering
        base = ends[:-1] + np.arange(len(texts)) * 4 * self.segment
        owner = np.clip(np.searchsorted(base, low + self.segment, side="right") - 1, 0, len(texts) - 1)
        low = low - owner * 4 * self.segment
        found = []
        for s in range(0, len(segment), 2048):
            part = slice(s, s + 2048)
            edits, start, end = self.align(codes, ends, segment[part], owner[part], low[part])
            for i in np.flatnonzero(edits <= self.budget[segment[part]]):
                t = int(owner[part][i])
                found.append((t, int(segment[part][i]), int(places[start[i]] - self._offset(texts, t)), int(places[end[i] - 1] + 1 - self._offset(texts, t)), int(edits[i])))
        return found

    def counted(self, apart: np.ndarray, key: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Bands, as segment * top + band, that hold shared q-grams, and their numbers.

        A q-gram of a text meets all its places in all segments. They are taken in slices of ``SLICE_PLACES`` rows, whose
        counts are added up, so that a q-gram that repeats in texts and items costs time but no memory.
        """
        ends = np.cumsum(n)
        bands, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low in range(0, int(ends[-1]), SLICE_PLACES):
            row = np.arange(low, min(low + SLICE_PLACES, int(ends[-1])))
            of = np.searchsorted(ends, row, side="right")
            entry = self.where[self.first[key[of]] + row - (ends[of] - n[of])]
            band = (apart[of] - entry[:, 1]) // self.width
            new, c = np.unique(entry[:, 0] * top + band, return_counts=True)
            if len(bands):
                new, at = np.unique(np.concatenate([bands, new]), return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([counts, c])).astype(np.int64)
            bands, counts = new, c
        return bands, counts

    def _offset(self, texts: list[str], t: int) -> int:
        if getattr(self, "_of", None) is not texts:
            self._of, self._offsets = texts, np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        return int(self._offsets[t])

    def align(self, codes, ends, segment, owner, low) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each segment against its text on the diagonals of the band and ``width`` more on
        either side, with free ends in the text; and where that alignment starts and ends."""
        span = 4 * self.width + 1
        offsets = np.arange(span)
        first = low - self.width
        lengths = np.array([len(self.texts[s]) for s in segment])
        whole = np.zeros((len(segment), max(lengths, default=0)), np.uint32)
        for i, s in enumerate(segment):
            whole[i, : len(self.texts[s])] = self.texts[s]
        begin, stop = ends[owner][:, None], ends[owner + 1][:, None]
        # a state is edits * 2 ** 32 + the offset in row 0 that its alignment starts from
        one, far = np.int64(1 << 32), np.int64(1 << 50)
        text_at = first[:, None] + offsets
        state = np.where((text_at >= begin) & (text_at <= stop), offsets, far)
        slope = offsets * one
        best = np.full(len(segment), 1 << 20, np.int64)
        best_start, best_end = np.zeros(len(segment), np.int64), np.ones(len(segment), np.int64)
        for row in range(whole.shape[1] + 1):
            rows = np.flatnonzero(lengths == row)
            if len(rows):
                j = np.argmin(state[rows], axis=1)
                final = state[rows, j]
                best[rows] = final >> 32
                best_start[rows] = np.clip(first[rows] + (final & (one - 1)), 0, len(codes) - 1)
                best_end[rows] = np.clip(first[rows] + row + j, best_start[rows] + 1, len(codes))
            if row == whole.shape[1]:
                break
            # the diagonal step reads this text position
            position = text_at + row
            same = codes[np.clip(position, 0, len(codes) - 1)] == whole[:, row][:, None]
            new = np.where((position >= begin) & (position < stop), state + ~same * one, far)
            # a segment character without a partner: from the next diagonal of the row before
            np.minimum(new[:, :-1], state[:, 1:] + one, out=new[:, :-1])
            # text characters without a partner: along the row
            new = np.minimum.accumulate(new - slope, axis=1) + slope
            new[(position >= stop)] = far
            state = new
        return best, best_start, best_end


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Items of (item_id, text) in blocks; the driver holds one block."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        if held and size + len(text or "") > chars:
            yield held
            held, size = [], 0
        held.append((item, text or ""))
        size += len(text or "")
    if held:
        yield held


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, some, held = 0, [], 0
    for text in texts:
        some.append(text or "")
        held += len(some[-1])
        if held >= BATCH_CHARS:
            yield start, some
            start, some, held = start + len(some), [], 0
    if some:
        yield start, some


_blocks: dict = {}


def _block(items, segment: int) -> Block:
    """The index of a broadcast block, built once a worker."""
    if items.value is not _blocks.get("items") or _blocks["segment"] != segment:
        _blocks["items"], _blocks["segment"], _blocks["index"] = items.value, segment, Block(items.value, segment)
    return _blocks["index"]


MATCH = "doc_id long, item_id long, start_char long, end_char long, edits int, segments int"


def find(docs: DataFrame, benchmark: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Matches of items in rows of (doc_id, text): a row for each document row and item.

    start_char and end_char bound the matched segments in the text; edits is the largest number of
    a segment. Null and empty texts match nothing; items with fewer than ``Q`` characters in normal
    form are no evidence and match nothing. Repeated rows are reported each.
    """
    spark, out = docs.sparkSession, None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("edits", pa.int32()), ("segments", pa.int32())])
            index = _block(sent, segment)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for start, some in _chunks(batch.column(1).to_pylist()):
                    merged: dict = {}
                    for t, place, a, b, edits in index.matches(some):
                        old = merged.setdefault((start + t, index.ids[place]), [a, b, 0, set()])
                        old[0], old[1], old[2] = min(old[0], a), max(old[1], b), max(old[2], edits)
                        old[3].add(place)
                    if merged:
                        rows = [dict(zip(schema.names, (ids[t], i, a, b, e, len(s)), strict=True)) for (t, i), (a, b, e, s) in merged.items()]
                        yield pa.RecordBatch.from_pylist(rows, schema)

        part = docs.select("doc_id", "text").mapInArrow(run, MATCH)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark passage."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _block(sent, segment)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for start, some in _chunks(batch.column(at).to_pylist()):
                    for t, *_ in index.matches(some):
                        keep[start + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), SHORT_SEGMENT), "leaks")
