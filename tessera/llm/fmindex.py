"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of consecutive rows of a partition with about ``SHARD_WORDS``
words.  Its word sequence (a separator of its own after each text) gets a full
suffix order, a Burrows-Wheeler transform in a wavelet matrix, and suffix
positions sampled every ``SAMPLE`` words of text.  Benchmark phrases are found
by backward search over wavelet ranks, located by walking back to a sampled
position, and merged into spans of words.  Longer texts are indexed in pieces
that overlap by one word less than a window, so memory is bounded by the
shard.  The benchmark is the query set: its windows are sent as word hashes in
blocks of ``BLOCK_WINDOWS``, each a broadcast of its own.  The driver makes one
block at a time, and a task holds one at a time where there are several; a
larger benchmark costs more blocks on executors' disks, not more memory.
There is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .storage import drop_columns_clashing
from .textkit import LOWER_ALNUM, Words, slices, spans

SHARD_WORDS = 250_000
SAMPLE = 8
BLOCK_WINDOWS = 500_000
U = np.uint64


class FMIndex:
    """An FM-index of a sequence of symbols from 1 to ``symbols`` (each 0 < x <= symbols)."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        order = suffix_order(text, symbols)
        before = text[order - 1]
        self.length = n
        self.first = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.first[1:])
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        level = before.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            one = (level >> bit) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            one = one.astype(bool)
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[~one], level[one]])
        sampled = order % sample == 0
        self.sampled = np.zeros(n + 1, np.int32)
        np.cumsum(sampled, out=self.sampled[1:])
        self.samples = order[sampled].astype(np.int32)

    def _down(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        at = list(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            for i, x in enumerate(at):
                r = ones[x]
                at[i] = np.where(one, zeros + r, x - r)
        return at

    def _symbol_and_rank(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, at, low = np.zeros(len(row), np.int64), row, np.zeros(len(row), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            r, s = ones[at], ones[low]
            one = ones[at + 1] > r
            symbol = symbol * 2 + one
            at, low = np.where(one, zeros + r, at - r), np.where(one, zeros + s, low - s)
        return symbol, at - low

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of each phrase (rows of equal length, symbol 0 or less: not in the text)."""
        known = (phrases > 0).all(axis=1)
        low, high = np.zeros(len(phrases), np.int64), np.where(known, self.length, 0)
        live = np.flatnonzero(known)
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = phrases[live, k]
            a, b, zero = self._down(c, low[live], high[live], np.zeros(len(live), np.int64))
            low[live], high[live] = self.first[c] + a - zero, self.first[c] + b - zero
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        place, steps = np.full(len(row), -1, np.int64), 0
        live, at = np.arange(len(row)), row.astype(np.int64)
        while len(live):
            got = self.sampled[at + 1] > self.sampled[at]
            place[live[got]] = self.samples[self.sampled[at[got]]] + steps
            live, at = live[~got], at[~got]
            symbol, rank = self._symbol_and_rank(at)
            at, steps = self.first[symbol] + rank, steps + 1
        return place


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Sorted suffixes by prefix doubling; only suffixes still tied are sorted again."""
    n, base = len(text), symbols + 1
    padded = np.append(text, [0, 0, 0])
    depth = 3 if base**3 < 2**62 else 2
    key = text.astype(np.int64)
    for k in range(1, depth):
        key = key * base + padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    begin = np.flatnonzero(fresh)
    head = np.repeat(begin, np.diff(np.append(begin, n)))
    rank = np.empty(n, np.int64)
    rank[order] = head
    alone = fresh & np.append(fresh[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 2) + after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.append(True, key[1:] != key[:-1])
        begin = np.flatnonzero(fresh)
        rank[at] = np.repeat(slots[begin], np.diff(np.append(begin, len(slots))))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


def _window_blocks(items: Iterator[tuple], window: int, most: int) -> Iterator[dict[int, tuple[np.ndarray, list[list]]]]:
    """Blocks of about ``most`` windows, distinct inside a block: for each length their word hashes and the items of each."""
    now, held = defaultdict(lambda: defaultdict(set)), 0

    def packed(block):
        return {size: (np.frombuffer(b"".join(of), U).reshape(-1, size), [list(x) for x in of.values()]) for size, of in block.items()}

    for item, text in items:
        h = Words([(text or "").encode()], LOWER_ALNUM).hash
        size = min(window, len(h))
        for k in range(len(h) - size + 1) if size else ():
            now[size][h[k : k + size].tobytes()].add(item)
            held += 1
            if held >= most:
                yield packed(now)
                now, held = defaultdict(lambda: defaultdict(set)), 0
    if held:
        yield packed(now)


class _Blocks:
    """Broadcast blocks in turn; with more than one, each is let go before the next is read."""

    def __init__(self, blocks: list):
        self.blocks = blocks

    def __iter__(self):
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1 and hasattr(block, "_value"):
                del block._value


def _pieces(count: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Shards: lists of (text, first word, end word), long texts cut with overlaps."""
    shard, held = [], 0
    for i, n in enumerate(count):
        begin = 0
        while n:
            end = min(int(n), begin + SHARD_WORDS)
            if held and held + end - begin > SHARD_WORDS:
                yield shard
                shard, held = [], 0
            shard.append((i, begin, end))
            held += end - begin
            if end == n:
                break
            begin = end - (window - 1)
    if shard:
        yield shard


def _mark(w: Words, blocks, window: int) -> tuple[np.ndarray, list[set]]:
    """Which words are hit, and the items found in each text."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    found: list[set] = [set() for _ in w.counts]
    for shard in _pieces(w.counts, window):
        begin = np.array([w.first[i] + a for i, a, _ in shard])
        size = np.array([b - a for _, a, b in shard])
        place = spans(begin, size)
        vocabulary, symbol = np.unique(w.hash[place], return_inverse=True)
        starts = np.cumsum(size + 1) - size - 1
        text = np.zeros(int(size.sum()) + len(shard), np.int64)
        origin = np.full(len(text), -1, np.int64)
        at = spans(starts, size)
        text[at], origin[at] = symbol + 1, place
        text[starts + size] = len(vocabulary) + 1 + np.arange(len(shard))
        index = FMIndex(text, len(vocabulary) + len(shard))
        text_of = np.array([i for i, _, _ in shard])
        for block in blocks:
            for length, (phrases, items) in block.items():
                at = np.minimum(np.searchsorted(vocabulary, phrases), len(vocabulary) - 1)
                ids = np.where(vocabulary[at] == phrases, at + 1, 0)
                low, high = index.find(ids)
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                many = high[hit] - low[hit]
                where = index.locate(spans(low[hit], many))
                which = np.repeat(hit, many)
                word = origin[where]
                np.add.at(edge, word, 1)
                np.add.at(edge, word + length, -1)
                of = text_of[np.searchsorted(starts, where, "right") - 1]
                for t, p in np.unique(np.stack([of, which], axis=1), axis=0):
                    found[t].update(items[p])
    return np.cumsum(edge[:-1]) > 0, found


def merged_spans(hit: np.ndarray) -> list[list[int]]:
    """Maximal runs of hit words, as [first, end) pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


FOUND = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("n_items", LongType()),
    StructField("items_sha256", StringType()),
    StructField("contaminated", BooleanType()),
    StructField("removal_spans", ArrayType(ArrayType(LongType()))),
]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, num: int = 1, den: int = 20, keep: list[str] | None = None, only_clean: bool = False, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``docs`` with what a benchmark leaves in each text.

    Adds n_words, n_hit (words inside any occurrence of a window), n_items,
    items_sha256, contaminated (n_hit > 0 and n_hit/n_words >= num/den) and
    removal_spans (merged runs of hit words, [first, end) from 0).  ``keep``
    names the columns to keep (all by default; columns with names of added
    ones give way).  ``only_clean`` returns the input columns of the rows that
    are not contaminated.  Null and empty texts have no words and are clean;
    equal rows are judged alike; an item without words has no window; items
    with a null id count by the text "null".  An empty benchmark finds nothing.
    """
    context = docs.sparkSession.sparkContext
    items = ((r[0], r[1]) for r in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(item_text_col)).toLocalIterator())
    blocks = [context.broadcast(block) for block in _window_blocks(items, window, block_windows)]
    kept = docs if only_clean else drop_columns_clashing(docs.select(*keep) if keep else docs, *[f.name for f in FOUND])
    names = kept.columns
    given = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Blocks(blocks)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) < 7 * SHARD_WORDS):
                    size += len(texts[end])
                    end += 1
                yield judge(batch.slice(begin, end - begin), texts[begin:end], known)
                begin = end

    def judge(batch: pa.RecordBatch, texts: list[bytes], known) -> pa.RecordBatch:
        w = Words(texts, LOWER_ALNUM)
        hit, found = _mark(w, known, window)
        total = np.append(0, np.cumsum(hit))
        n_hit = total[w.first[1:]] - total[w.first[:-1]]
        bad = (n_hit > 0) & (den * n_hit >= num * w.counts)
        if only_clean:
            return batch.select(list(range(len(names)))).filter(pa.array(~bad))
        columns = [batch.column(i) for i in range(len(names))]
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found]
        run_of = [merged_spans(hit[a:b]) if n else [] for a, b, n in zip(w.first[:-1], w.first[1:], n_hit, strict=True)]
        columns += [pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()), pa.array(digest), pa.array(bad), pa.array(run_of, pa.list_(pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, names=[*(f"_{i}" for i in range(len(names))), *(f.name for f in FOUND)])

    fields = [StructField(f"_{i}", kept.schema[i].dataType) for i in range(len(names))]
    out = given.mapInArrow(run, StructType(fields + ([] if only_clean else FOUND)))
    return out.withColumnsRenamed({f"_{i}": c for i, c in enumerate(names)})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return find_contamination(docs, benchmark, only_clean=True, **how)
