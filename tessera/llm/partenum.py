"""Exact Jaccard join of documents on word n-grams, by PartEnum signatures.

*Sets.*  A document's set holds its distinct runs of ``n`` words (a shorter
text is one run; a text without words has the empty set).  Elements are 52-bit
hashes of the runs.

*Signatures.*  Sets are put in size bands.  In a band the domain is split into
``G`` first-level partitions and each of these into three second-level ones;
the signatures of a first-level partition are the contents of the three
two-element subsets of its second-level partitions (n2 = 3, k2 = 1).  Two sets
of sizes r and s with Jaccard similarity t or more differ in at most
``d = (r + s)(1 - t)/(1 + t)`` elements.  Spoiling every subset of a partition
takes one differing element if a single second-level partition is filled, else
two; this is its cost.  A set emits its partitions in order while the costs
before are at most d.  The first partition not spoiled in a similar pair is
therefore emitted by both, and gives them an equal signature.  A set whose
costs do not exceed d (a few tiny sets) also emits one signature that all such
sets of its band share, so that no pair is lost.  A band spans a factor of
two; a set whose larger partner may lie in the next band emits there as well.

*Frequent elements.*  Passages that many documents share would give equal
signatures to documents that are otherwise different.  Elements found in more
than a set share of the documents are marked in a bit map of fixed size and
partitioned apart, after all others in the order of emission.  The marking is
one function for all documents, so it changes the cost and never the result.

*Scale.*  Signatures are sent packed, by ranges of their value, and beyond
``COARSE`` ranges in two steps, so that packed rows stay long.  Beyond
``A_ROUND`` ranges they go in up to ``MOST_ROUNDS`` rounds by their remainder;
a round hashes all texts anew, and its shuffle files are gone when the next
one begins, so that disk holds the signatures of one round.  The sets that
share a signature make a bucket.  A small bucket gives all its pairs, and a
pair goes on only if the odd sketches of its two sets (parities of element
counts by hash) differ in no more places than d, which no similar pair does.
A large bucket gives links to its least set; inside a task it is merged into
these before the shuffle, so that a group with a third of all rows sends one
entry a task.  Pairs and links give candidate components; only documents in
one of these have their set read again, once, for the exact comparison.  The
larger the table, the more runs of common words are in more than ``SMALL``
documents by chance, and the links of their buckets chain what is not similar.
A candidate component beyond ``limit`` is therefore cut first: its sets are
matched again on their prefixes, the elements of least count that a similar
set must share one of, in an order from counts by hash in a map of bounded
size.  One still beyond ``limit`` is resolved by pivots (all its members are
compared with one of them in parallel, and by the triangle inequality of the
Jaccard distance members that can have no partner among the rest are finished)
and what is left after ``ROUNDS`` pivots by pairs of blocks, one block against
the others at a time.  No row is dropped or capped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .storage import Scope, scope, written
from .textkit import LOWER, Words, chunks, grams, mix, slices, spans

ROUNDS = 6
#: Elements (8 bytes each) and documents of a candidate component that one task resolves.
LIMIT_ELEMENTS, LIMIT_SETS = 6_000_000, 20_000
#: Document ids, 8 bytes each, up to which the candidates are broadcast as a filter.
BROADCAST_IDS = 4_000_000
_LEAST_BAND = 5
_FLUSH = 500_000
#: Bytes of text hashed at once.
_CHUNK = 700_000
#: Elements in at least this share of the documents are frequent; looked for in runs of so many documents.
FREQUENT, _RUN = 0.0003, 16_000
#: Sets up to which a bucket gives all pairs.
SMALL = 16
#: Bits of the map of frequent elements.
_MAP = 2**24
#: Bits of the number of slots in which elements of large candidate components are counted, at most.
_SLOT_BITS = 26
#: Ranges of signatures up to which they are dealt at once; beyond, in two steps, so that packed rows stay long.
COARSE = 2_048
#: Ranges of signatures dealt in one round, and rounds at most.
A_ROUND, MOST_ROUNDS = 200, 4
#: A set with more copies than this share of all rows (and this many) is joined by broadcast: at most HOT such sets.
HOT, LEAST_HOT = 10_000, 64
U = np.uint64


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct elements of each text's set, concatenated, and their counts."""
    w = Words(texts, LOWER)
    count = w.counts
    full = count >= n
    run = grams(w.hash, n)
    at = spans(w.first[:-1][full], count[full] - n + 1)
    owner = np.repeat(np.flatnonzero(full), count[full] - n + 1)
    h = run[at] if len(at) else np.empty(0, U)
    for i in np.flatnonzero((count > 0) & ~full):
        part = w.hash[w.first[i] : w.first[i + 1]]
        one = grams(part, len(part)) ^ U(len(part))
        h, owner = np.append(h, mix(one)), np.append(owner, i)
    key = np.sort((owner.astype(U) << U(52)) | (h >> U(12)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    owner = (key >> U(52)).astype(np.int64)
    return key & U(2**52 - 1), np.bincount(owner, minlength=len(texts))


def digests(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set (0 for an empty one)."""
    total = np.append(U(0), np.cumsum(mix(elements), dtype=U))
    end = np.cumsum(sizes)
    return np.where(sizes > 0, mix((total[end] - total[end - sizes]) ^ mix(sizes.astype(U))), U(0)).view(np.int64)


def band(size: np.ndarray) -> np.ndarray:
    return np.maximum(_LEAST_BAND, np.ceil(np.log2(np.maximum(size, 1) / 4))).astype(np.int64)


def differing(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most elements in which a set of this size differs from a partner (similarity num/den)."""
    return (size + size * den // num) * (den - num) // (den + num)


def _in_band(elements: np.ndarray, sizes: np.ndarray, j: np.ndarray, d: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of non-empty sets in the bands j, and the index of each one's set.

    Partitions of frequent elements follow those of all others.
    """
    rare = np.left_shift(1, j)
    groups = 2 * rare
    cell0 = np.cumsum(3 * groups) - 3 * groups
    u = mix(elements ^ U(0x51ED270B7A2F4D13))
    of = np.repeat(np.arange(len(sizes)), sizes)
    g = (u & (rare[of] - 1).astype(U)).astype(np.int64) + frequent * rare[of]
    cell = cell0[of] + 3 * g + ((u >> U(40)) % U(3)).astype(np.int64)
    cells = int(3 * groups.sum())
    v = mix(elements ^ U(0x2545F4914F6CDD1D)) >> U(12)
    low = np.bincount(cell, (v & U(2**26 - 1)).astype(np.float64), cells).astype(U)
    high = np.bincount(cell, (v >> U(26)).astype(np.float64), cells).astype(U)
    content = ((high << U(26)) + low).reshape(-1, 3)
    filled = np.bincount(cell, minlength=cells).reshape(-1, 3) > 0
    cost = np.minimum(filled.sum(axis=1), 2)
    owner = np.repeat(np.arange(len(sizes)), groups)
    before = np.cumsum(cost) - cost
    first = np.cumsum(groups) - groups
    before -= np.repeat(before[first], groups)
    row = np.flatnonzero((cost > 0) & (before <= d[owner]))
    c, f, own = content[row], filled[row], owner[row]
    place = mix((j[own].astype(U) << U(48)) ^ ((row - first[own]).astype(U) << U(3)))
    sig, by = [], []
    for k, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        some = f[:, x] | f[:, y]
        key = c[:, x] * U(0x9E3779B97F4A7C15) + c[:, y] * U(0xC2B2AE3D27D4EB4F)
        sig.append(mix(key ^ (place + U(k)))[some])
        by.append(own[some])
    spent = np.bincount(owner, cost, len(sizes))
    few = np.flatnonzero(spent <= d)
    sig.append(mix((j[few].astype(U) << U(48)) + U(7)))
    by.append(few)
    return np.concatenate(sig), np.concatenate(by)


def signatures(elements: np.ndarray, sizes: np.ndarray, num: int, den: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of some sets, and the index of each one's set.

    ``frequent`` is the map of frequent elements, one flag for each remainder.
    """
    often = np.zeros(len(elements), np.int64) if frequent is None else frequent[elements & U(len(frequent) - 1)].astype(np.int64)
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return np.empty(0, U), np.empty(0, np.int64)
    s = sizes[some]
    own, d = band(s), differing(s, num, den)
    sig, by = _in_band(elements, s, own, d, often)
    next_band = band(s * den // num)
    up = np.flatnonzero(next_band > own)
    if len(up):
        begin = (np.cumsum(s) - s)[up]
        at = spans(begin, s[up])
        sig2, by2 = _in_band(elements[at], s[up], next_band[up], d[up], often[at])
        sig, by = np.append(sig, sig2), np.append(by, up[by2])
    return sig, some[by]


def _slot(elements: np.ndarray, slots: int) -> np.ndarray:
    return mix(elements ^ U(0x3C79AC492BA7B653)) & U(slots - 1)


def prefixes(elements: np.ndarray, sizes: np.ndarray, num: int, den: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set's prefix, its rarest elements of which a similar set has one in its own, and the index of each one's set.

    ``rarity`` has four bits for each slot, its class of count.  Any order of
    the elements is right that is the same for all sets; this one keeps what
    many sets have out of the prefixes.
    """
    slot = _slot(elements, 2 * len(rarity))
    count = (rarity[slot >> U(1)] >> ((slot & U(1)) << U(2)).astype(np.uint8)) & 15
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((elements, count, of))
    length = np.where(sizes > 0, sizes - -(-sizes * num // den) + 1, 0)
    at = order[spans(np.cumsum(sizes) - sizes, length)]
    return mix(elements[at] ^ U(0x1B03738712FAD5C9)), of[at]


def _buckets(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by signature and node without repeats; where each bucket begins and its size."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])) if len(sig) else np.empty(0, bool)
    sig, node = sig[fresh], node[fresh]
    begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
    return sig, node, begin, np.diff(np.append(begin, len(sig)))


def _to_least(node: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Links (least, other) of buckets."""
    at = spans(begin, size)
    pairs = np.stack([np.repeat(node[begin], size), node[at]], axis=1) if len(at) else np.empty((0, 2), np.int64)
    return _stars(pairs[pairs[:, 0] != pairs[:, 1]])


def _all_pairs(node: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct pairs of small buckets."""
    out = []
    for m in np.unique(size[size > 1]):
        rows = node[begin[size == m][:, None] + np.arange(m)]
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
        i, j = np.triu_indices(m, 1)
        out.append(_distinct(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], axis=1)))
    return _distinct(np.concatenate(out)) if out else np.empty((0, 2), np.int64)


def odd_sketches(elements: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the parities of its element counts by hash, about one bit an element (a power of two, 64 at least)."""
    bits = np.maximum(64, np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)))
    at = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(sizes)), sizes)
    h = mix(elements ^ U(0x7F4A7C15F39CC060))
    place = at[of] + (h & (bits[of] - 1).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little")
    return [odd[a // 8 : (a + n) // 8].tobytes() for a, n in zip(at.tolist(), bits.tolist(), strict=True)]


def sketch_distance(x: bytes, y: bytes) -> int:
    """In how many places two sketches differ, the longer one folded; at most the sets' number of differing elements."""
    p, q = (np.frombuffer(z, np.uint8) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _distinct(pairs: np.ndarray) -> np.ndarray:
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _frequent(n: int):
    """mapInArrow function: elements that are often met in runs of documents, with their counts."""

    def counted(held):
        key = np.sort(np.concatenate(held))
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        many = np.diff(np.append(begin, len(key)))
        some = many >= 3
        return pa.RecordBatch.from_arrays([pa.array(key[begin[some]].astype(np.int64)), pa.array(many[some])], names=["element", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts, _CHUNK):
                held.append(shingle_sets(texts[a:b], n)[0])
                docs += b - a
                if docs >= _RUN or sum(map(len, held)) > 6 * _FLUSH:
                    yield counted(held)
                    held, docs = [], 0
        if held:
            yield counted(held)

    return run


def frequent_map(rows: DataFrame, n: int, share: float = FREQUENT) -> np.ndarray:
    """Flags, by remainder, of elements in at least ``share`` of the documents (an estimate that only steers cost)."""
    total = rows.count()
    met = rows.select("text").mapInArrow(_frequent(n), "element long, many long").groupBy("element").agg(F.sum("many").alias("many"))
    often = met.where(F.col("many") >= max(6, share * total)).select(F.expr(f"element & {_MAP - 1}").alias("r"))
    # Flags are or-ed into words of 32 in Spark: at most _MAP / 32 rows reach the driver, however many elements are frequent.
    words = often.groupBy(F.expr("r div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(r % 32 as int)))").alias("bits")).toArrow()
    flags = np.zeros(_MAP // 32, np.uint32)
    flags[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return np.packbits(np.unpackbits(flags.view(np.uint8), bitorder="little"))


def _slots(n: int, bits: int):
    """mapInArrow function: the slots of all elements, as packed rows by ranges of 2**16."""

    def packed(held):
        slot = np.sort(np.concatenate(held))
        p = (slot >> U(16)).astype(np.int32)
        begin = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, np.int64)
        parts = np.split(slot.astype(np.uint16), begin[1:]) if len(p) else []
        return pa.RecordBatch.from_arrays([pa.array(p[begin]), pa.array([x.tobytes() for x in parts], pa.binary())], names=["p", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts, _CHUNK):
                held.append(_slot(shingle_sets(texts[a:b], n)[0], 2**bits))
                if sum(map(len, held)) >= 4 * _FLUSH:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return run


def _classes(table: pa.Table) -> pa.Table:
    """applyInArrow function for one range of slots: their classes of count (the power of two that holds it, 15 at most), two in a byte."""
    met = np.zeros(2**16, np.int64)
    for x in table.column("slots").to_pylist():
        met += np.bincount(np.frombuffer(x, np.uint16), minlength=2**16)
    c = np.minimum(np.ceil(np.log2(np.maximum(met, 1))), 15).astype(np.uint8)
    return pa.table({"p": table.column("p").slice(0, 1), "classes": pa.array([(c[0::2] | (c[1::2] << 4)).tobytes()], pa.binary())})


def rarity_map(texts: DataFrame, n: int, elements: int) -> np.ndarray:
    """Classes of count by slot for about so many elements; it only steers cost.  At most 2**_SLOT_BITS half bytes reach the driver."""
    bits = max(16, min(_SLOT_BITS, (4 * elements).bit_length()))
    ranges = written(texts.select("text").mapInArrow(_slots(n, bits), "p int, slots binary").groupBy("p").applyInArrow(_classes, "p int, classes binary")).toArrow()
    out = np.zeros(2 ** (bits - 1), np.uint8)
    for p, classes in zip(ranges["p"].to_pylist(), ranges["classes"].to_pylist(), strict=True):
        out[p << 15 : (p + 1) << 15] = np.frombuffer(classes, np.uint8)
    return out


_PACKED = "p int, kind int, x binary, y binary, z binary, sketches array<binary>"
_DOC, _SIG, _MERGED, _LINK = 0, 1, 2, 3


def _packed(n: int, num: int, den: int, parts: int, frequent, turn_of: int = 0, rounds: int = 1, rarity=None):
    """mapInArrow function: packed documents (in the first round only), signatures of a round (48 bits within their range, and which node), merged ones and links.

    With ``rarity`` the signatures are those of prefixes, and documents are left out.
    """
    schema = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("sketches", pa.list_(pa.binary()))])
    edges = ((np.arange(1, parts, dtype=U) << U(32)) + U(parts - 1)) // U(parts)

    def entries(kind, sig, node):
        bounds = np.searchsorted(sig >> U(32), edges)
        for p, (s, d) in enumerate(zip(np.split(sig, bounds), np.split(node, bounds), strict=True)):
            if len(s):
                table, which = np.unique(d, return_inverse=True)
                yield p, kind, _six(s), which.astype(np.uint16 if len(table) < 2**16 else np.uint32).tobytes(), table.tobytes(), []

    def flush(sigs, nodes, turn):
        sig, node, begin, size = _buckets(np.concatenate(sigs), np.concatenate(nodes))
        big = size > SMALL
        rest = np.repeat(~big, size)
        rows = [*entries(_SIG, sig[rest], node[rest]), *entries(_MERGED, sig[begin[big]], node[begin[big]])]
        pairs = _to_least(node, begin[big], size[big])
        if len(pairs):
            rows.append((turn % parts, _LINK, pairs.tobytes(), b"", b"", []))
        return rows

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = None if rarity else np.unpackbits(frequent.value).astype(bool)
        sigs, nodes, held, turn = [], [], 0, 0
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column(0)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for a, b in chunks(texts, _CHUNK):
                elements, sizes = shingle_sets(texts[a:b], n)
                node = digests(elements, sizes)
                sig, by = prefixes(elements, sizes, num, den, rarity.value) if rarity else signatures(elements, sizes, num, den, often)
                if rounds > 1:
                    own = sig % U(rounds) == U(turn_of)
                    sig, by = sig[own], by[own]
                sigs.append(sig)
                nodes.append(node[by])
                held += len(sig)
                part = ids.slice(a, b - a)
                known = np.array(part.is_valid().to_numpy(zero_copy_only=False), bool)
                value = np.array(part.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                turn += 1
                if not turn_of and not rarity:
                    rows.append((int(node[0] % parts), _DOC, np.stack([value, known.astype(np.int64)]).tobytes(), sizes.astype(np.int64).tobytes(), node.tobytes(), odd_sketches(elements, sizes)))
                if held >= _FLUSH:
                    rows += flush(sigs, nodes, turn)
                    sigs, nodes, held = [], [], 0
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of(flush(sigs, nodes, turn + 1))

    return run


def _split(fine: int):
    """mapInArrow function: packed rows with each range cut into ``fine`` ones by the upper 32 of a signature's 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size, turn = 0, 0

        def flushed(schema):
            rows = []
            for (p, kind), parts in held.items():
                sig, node = (np.concatenate(x) for x in zip(*parts, strict=True))
                to = ((sig >> U(16)) * U(fine)) >> U(32)
                order = np.argsort(to, kind="stable")
                sig, node, to = sig[order], node[order], to[order]
                begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                for a, b in zip(begin, np.append(begin[1:], len(to)), strict=True):
                    table, which = np.unique(node[a:b], return_inverse=True)
                    rows.append((p * fine + int(to[a]), kind, _six(sig[a:b]), which.astype(np.uint16 if len(table) < 2**16 else np.uint32).tobytes(), table.tobytes(), []))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            schema, kinds, rest = batch.schema, batch.column(1).to_pylist(), []
            for i, kind in enumerate(kinds):
                p = batch.column(0)[i].as_py()
                if kind in (_SIG, _MERGED):
                    x, y, z = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                    sig = _from_six(x)
                    held.setdefault((p, kind), []).append((sig, np.frombuffer(z, np.int64)[np.frombuffer(y, np.uint16 if 3 * len(y) == len(x) else np.uint32)]))
                    size += len(sig)
                    if size >= _FLUSH:
                        yield flushed(schema)
                        size = 0
                else:
                    turn += 1
                    rest.append((i, p * fine + turn % fine))
            if rest:
                at = pa.array([i for i, _ in rest], pa.int64())
                part = batch.take(at)
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in rest], pa.int32()), *part.columns[1:]], schema=schema)
        if size:
            yield flushed(schema)

    return run


def _stars(pairs: np.ndarray) -> np.ndarray:
    """The components of some links as stars: (least node, other)."""
    if not len(pairs):
        return pairs
    names, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[at[:, 0]], low)
        np.minimum.at(new, root[at[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[root[other]], names[other]], axis=1)


_FOUND = "kind int, a long, b long, size long, sketch binary"
_LINKED, _PAIR = 1, 2


def _matched(table: pa.Table) -> pa.Table:
    """applyInArrow function for one range of signatures: documents (a id, b node, size, sketch), links and pairs."""
    kinds = table.column("kind").to_pylist()
    cols = [table.column(c).to_pylist() for c in ("x", "y", "z", "sketches")]
    sigs, nodes, marks, links, docs = [], [], [], [], []
    for kind, x, y, z, sketches in zip(kinds, *cols, strict=True):
        if kind in (_SIG, _MERGED):
            sigs.append(_from_six(x))
            which = np.frombuffer(y, np.uint16 if 3 * len(y) == len(x) else np.uint32)
            nodes.append(np.frombuffer(z, np.int64)[which])
            if kind == _MERGED:
                marks.append(sigs[-1])
        elif kind == _LINK:
            links.append(np.frombuffer(x, np.int64).reshape(-1, 2))
        else:
            docs.append((np.frombuffer(x, np.int64).reshape(2, -1), np.frombuffer(y, np.int64), np.frombuffer(z, np.int64), sketches))
    pairs = np.empty((0, 2), np.int64)
    if sigs:
        sig, node, begin, size = _buckets(np.concatenate(sigs), np.concatenate(nodes))
        big = size > SMALL
        if marks:
            big |= np.isin(sig[begin], np.concatenate(marks))
        links.append(_to_least(node, begin[big], size[big]))
        pairs = _all_pairs(node, begin[~big], size[~big])
    link = _stars(np.concatenate(links)) if links else np.empty((0, 2), np.int64)
    ids = np.concatenate([d[0][0] for d in docs]) if docs else np.empty(0, np.int64)
    known = np.concatenate([d[0][1] for d in docs]).astype(bool) if docs else np.empty(0, bool)
    size = np.concatenate([d[1] for d in docs]) if docs else np.empty(0, np.int64)
    node = np.concatenate([d[2] for d in docs]) if docs else np.empty(0, np.int64)
    more = len(link) + len(pairs)
    return pa.table(
        {
            "kind": pa.array(np.repeat([_DOC, _LINKED, _PAIR], [len(ids), len(link), len(pairs)]).astype(np.int32)),
            "a": pa.array(np.concatenate([ids, link[:, 0], pairs[:, 0]]), mask=np.append(~known, np.zeros(more, bool))),
            "b": pa.array(np.concatenate([node, link[:, 1], pairs[:, 1]])),
            "size": pa.array(np.append(size, np.zeros(more, np.int64))),
            "sketch": pa.array([x for d in docs for x in d[3]] + [None] * more, pa.binary()),
        }
    )


def _near(num: int, den: int):
    """mapInArrow function: the pairs (a, b) of (a, b, size, size, sketch, sketch) that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, s = (batch.column(c).to_numpy() for c in (2, 3))
            fits = np.minimum(r, s) * den >= np.maximum(r, s) * num
            d = (r + s) * (den - num) // (den + num)
            x, y = batch.column(4), batch.column(5)
            keep = [i for i in np.flatnonzero(fits).tolist() if sketch_distance(x[i].as_py(), y[i].as_py()) <= d[i]]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _sets(n: int):
    """mapInArrow function: (doc_id, text, node, comp) to (comp, node, size, elements), where the text has that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            want, comp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in chunks(texts, _CHUNK):
                elements, sizes = shingle_sets(texts[a:b], n)
                right = np.flatnonzero(digests(elements, sizes) == want[a:b])
                end = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(comp[a:b][right]), pa.array(want[a:b][right]), pa.array(sizes[right].astype(np.int64)), pa.array([_six(elements[end[i] - sizes[i] : end[i]] >> U(4)) for i in right], pa.binary())],
                    names=["comp", "node", "size", "elements"],
                )

    return run


def linked_groups(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Exact components among a few sets: for each the index of its group's first member.

    A search from each set: it is compared with all sets not reached yet at
    once.  A set reached from a seed can have a partner only among those whose
    distance from the seed is at most its own plus the join distance.
    """
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, bool)
    far = 1 - num / den + 1e-9

    def shared(i: int, rest: np.ndarray) -> np.ndarray:
        own = flat[begin[i] : begin[i] + size[i]]
        mark[own] = True
        if len(rest) * 2 > m:
            out = np.add.reduceat(mark[flat].view(np.int8), begin, dtype=np.int64)[rest]
        else:
            out = np.add.reduceat(mark[flat[spans(begin[rest], size[rest])]].view(np.int8), np.cumsum(size[rest]) - size[rest], dtype=np.int64)
        mark[own] = False
        return out

    rest = np.arange(m)
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        queue, away = deque([(seed, 0.0)]), None
        while queue and len(rest):
            i, near = queue.popleft()
            near_enough = np.arange(len(rest)) if away is None else np.flatnonzero(away <= near + far)
            if not len(near_enough):
                continue
            some = rest[near_enough]
            common = shared(i, some)
            union = size[i] + size[some] - common
            hit = den * common >= num * union
            if away is None:
                away = 1 - common / union
            for k, dist in zip(some[hit], away[near_enough][hit], strict=True):
                root[k] = seed
                queue.append((k, dist))
            keep = np.ones(len(rest), bool)
            keep[near_enough[hit]] = False
            rest, away = rest[keep], away[keep]
    return root


def _resolved(num: int, den: int, key: int):
    """mapInArrow function over rows sorted by their first ``key`` columns: links (a, b) of each group."""

    def links(nodes, blobs):
        root = linked_groups([_from_six(x) for x in blobs], num, den)
        return [(nodes[r], nodes[i]) for i, r in enumerate(root) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, blobs = None, [], []
        for batch in batches:
            out = []
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(key)], strict=True))
            for k, node, blob in zip(keys, batch.column(key).to_pylist(), batch.column(key + 1).to_pylist(), strict=True):
                if k != group:
                    out += links(nodes, blobs)
                    group, nodes, blobs = k, [], []
                nodes.append(node)
                blobs.append(blob)
            yield _pairs(out)
        yield _pairs(links(nodes, blobs))

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (comp, node, elements, pivot, pivot_elements) to the number of common elements."""
    for batch in batches:
        common = [len(np.intersect1d(_from_six(x), _from_six(y), True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 3)), pa.array(common, pa.int64())], names=["comp", "node", "pivot", "common"])


def _links_of_large(sets: DataFrame, num: int, den: int, limit: tuple[int, int]) -> list[DataFrame]:
    """Links inside candidate components beyond the limit; what a round leaves takes the place of what the round before left."""
    spark, found, left, earlier = sets.sparkSession, [], sets, None
    for _ in range(ROUNDS):
        with scope(spark) as made:
            pivots = left.groupBy("comp").agg(F.min_by(F.struct(F.col("node").alias("pivot"), F.col("elements").alias("pivot_elements"), F.col("size").alias("pivot_size")), F.struct(F.xxhash64("node"), "node")).alias("p")).select("comp", "p.*")
            pairs = left.select("comp", "node", "elements").join(pivots.select("comp", "pivot", "pivot_elements"), "comp").where("node != pivot")
            common = pairs.select("comp", "node", "elements", "pivot", "pivot_elements").mapInArrow(_distances, "comp long, node long, pivot long, common long")
            near = written(
                common.join(left.select("comp", "node", "size"), ["comp", "node"]).join(pivots.select("comp", "pivot_size"), "comp")
                .withColumn("u", F.expr("size + pivot_size - common")).withColumn("link", F.expr(f"{den} * common >= {num} * u")).withColumn("dist", F.expr("1 - common / u"))
            )
            links = near.where("link").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
            nearest = near.where("not link").groupBy("comp").agg(F.min("dist").alias("nearest"))
            stay = near.join(nearest, "comp").where(f"not link or dist >= nearest - {1 - num / den + 1e-9}").select("comp", "node")
            some = written(left.join(stay, ["comp", "node"], "left_semi"))
            large = _beyond(some, limit)
            found.append(written(links.union(_links_of_small(some.join(large, "comp", "left_anti"), num, den))))
            left = written(some.join(large, "comp", "left_semi"))
            made.remove(but=2)
            if earlier:
                earlier.remove()
            earlier = Scope(spark)
            earlier.paths = made.paths[-1:]
        if left.isEmpty():
            return found
    parts = written(left.groupBy("comp").agg(F.greatest(F.ceil(F.sum("size") * 2 / limit[0]), F.ceil(F.count("*") * 2 / limit[1])).alias("blocks")))
    blocks = left.join(F.broadcast(parts), "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # Block i goes to each of the blocks from i on, so a step holds the sets twice at most.
    for i in range(parts.agg(F.max("blocks")).first()[0]):
        others = F.when(F.col("block") == i, F.sequence(F.lit(i).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
        keyed = blocks.where(F.col("block") >= i).withColumn("j", F.explode(others)).select("comp", "j", "node", "elements")
        found.append(written(keyed.repartition("comp", "j").sortWithinPartitions("comp", "j", "node").mapInArrow(_resolved(num, den, 2), "a long, b long")))
    return found


def _beyond(sets: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """``comp``: the candidate components beyond the limit, of which there are few."""
    size = sets.groupBy("comp").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    return size.where((F.col("n") > limit[0]) | (F.col("m") > limit[1])).select("comp")


def _links_of_small(sets: DataFrame, num: int, den: int) -> DataFrame:
    return sets.select("comp", "node", "elements").repartition("comp").sortWithinPartitions("comp", "node").mapInArrow(_resolved(num, den, 1), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100, **how) -> DataFrame:
    """Components of documents joined at Jaccard similarity ``num/den``.

    Returns ``(doc_id, n_shingles, component_id)``, one row for each row of
    ``docs``; component_id is the smallest id reachable by links.  Null and
    empty texts have no shingles and are linked with nothing.  A null id is
    allowed: it never becomes a component id unless all ids of its component
    are null.  Rows with equal ids are judged each by its own text.  An empty
    table gives an empty one.  Other columns are ignored.
    """
    return _components(docs, id_col, text_col, n, num, den, **how).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, n: int = 5, num: int = 75, den: int = 100, limit: tuple[int, int] = (LIMIT_ELEMENTS, LIMIT_SETS), broadcast_ids: int = BROADCAST_IDS, coarse: int = COARSE, a_round: int = A_ROUND) -> DataFrame:
    """``jaccard_components`` with the digest of each row's set (node) and of its component (root)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About 0.11 signatures a byte; a range of a million takes some 50 MB in its task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(size * 0.11 / 1_000_000), 1)
    often = spark.sparkContext.broadcast(frequent_map(rows, n))
    rounds = min(-(-parts // a_round), MOST_ROUNDS)
    found = _matches(rows, parts, rounds, coarse, lambda *turn: _packed(n, num, den, turn[0], often, *turn[1:]))
    members = found.where(f"kind = {_DOC}").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("size").alias("n_shingles"), "sketch")
    nodes = written(members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies")))
    members, sketches = members.drop("sketch"), nodes.select("node", "size", "sketch")
    candidates = _candidates(found, sketches, num, den, rounds)
    nodes = nodes.drop("sketch")

    # The exact comparison reads the set of one document a node.
    wanted = written(candidates.join(nodes, "node").select(F.col("least").alias("doc_id"), "node", "comp", "size"))
    large = written(_beyond(wanted, limit))

    def texts_of(some):
        filtered = F.broadcast(some) if some.count() <= broadcast_ids else some
        return rows.join(filtered.withColumnRenamed("doc_id", "_id"), rows.doc_id.eqNullSafe(F.col("_id")), "inner")

    before = None
    while not large.isEmpty():
        of_large = written(wanted.join(large, "comp", "left_semi"))
        elements = of_large.agg(F.sum("size")).first()[0]
        if before is not None and 2 * elements > before:
            break
        before = elements
        texts = texts_of(of_large).select("doc_id", "text")
        rarity = spark.sparkContext.broadcast(rarity_map(texts, n, elements))
        cuts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(elements * (den - num) / den / 1_000_000))
        turns = min(-(-cuts // a_round), MOST_ROUNDS)
        again = _matches(texts, cuts, turns, coarse, lambda *turn: _packed(n, num, den, turn[0], None, *turn[1:], rarity=rarity))  # noqa: B023
        cut = _candidates(again, sketches, num, den, turns)
        wanted = written(wanted.join(large, "comp", "left_anti").unionByName(of_large.drop("comp").join(cut, "node")))
        large = written(_beyond(wanted, limit))

    def sets_of(some):
        sets = texts_of(some).select("text", "node", "comp").mapInArrow(_sets(n), "comp long, node long, size long, elements binary")
        return sets.dropDuplicates(["comp", "node"]) if repeats else sets

    repeats = _repeats(members)
    if large.isEmpty():
        links = _links_of_small(sets_of(wanted), num, den)
        groups = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        groups = written(groups.union(groups.select(F.col("root").alias("node"), "root").distinct()))
    else:
        links = written(_links_of_small(sets_of(wanted.join(large, "comp", "left_anti")), num, den))
        for more in _links_of_large(written(sets_of(wanted.join(large, "comp", "left_semi"))), num, den, limit):
            links = links.union(more)
        groups = written(connected_components(links))
    least = groups.join(nodes, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = groups.join(least, "root").select("node", "root", "component_id")
    found_of = written(nodes.join(of_node, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    # Sets with very many copies would each be one task of a shuffled join; there are at most HOT of them.
    most = max(LEAST_HOT, (found_of.agg(F.sum("copies")).first()[0] or 0) // HOT)
    hot = F.broadcast(found_of.where(F.col("copies") > most).select("node", F.lit(True).alias("hot"), "root", "component_id"))
    marked = members.join(hot, "node", "left")
    rest = marked.where("hot is null").drop("hot", "root", "component_id").join(found_of.where(F.col("copies") <= most).drop("copies"), "node", "left")
    columns = ["doc_id", "node", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    return marked.where("hot").select(*columns).union(rest.select(*columns))


def _matches(rows: DataFrame, parts: int, rounds: int, coarse: int, pack) -> DataFrame:
    """What ``_matched`` finds in so many ranges of signatures, in rounds; ``pack(ranges, round, rounds)`` makes the packed rows."""
    parts, found = -(-parts // rounds), None
    for k in range(rounds):
        with scope(rows.sparkSession) as made:
            packed = rows.mapInArrow(pack(min(parts, coarse), k, rounds), _PACKED)
            if parts > coarse:
                packed = written(packed.repartition(coarse, "p")).mapInArrow(_split(-(-parts // coarse)), _PACKED)
            part = written(packed.groupBy("p").applyInArrow(_matched, _FOUND))
            made.remove(but=1)
        found = part if found is None else found.union(part)
    return found


def _candidates(found: DataFrame, sketches: DataFrame, num: int, den: int, rounds: int) -> DataFrame:
    """``node, comp``: components by links and by the pairs that may be similar, which meet their sketches in rounds."""
    links = found.where(f"kind = {_LINKED}").select("a", "b")
    for k in range(rounds):
        pairs = found.where(f"kind = {_PAIR} and pmod(xxhash64(a), {rounds}) = {k}").select("a", "b").distinct()
        for end in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
        links = links.union(written(pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_near(num, den), "a long, b long")))
    return connected_components(links).select("node", F.col("root").alias("comp"))


def _repeats(members: DataFrame) -> bool:
    """Whether some id is on several rows."""
    return not members.groupBy("doc_id").count().where("count > 1").isEmpty()


def _with_node(n: int, fields: int):
    """mapInArrow function: rows whose last column is the text, with the digest of its set in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or b"" for t in batch.column(fields).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts, _CHUNK):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:fields], pa.array(digests(*shingle_sets(texts[a:b], n)))], names=[*part.schema.names[:fields], "_node"])

    return run


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, n: int = 5, **how) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Documents without words stay.  Null ids count as greater than all others.
    Of rows with one id only that whose text is in the component goes with it;
    of several rows of the smallest id in a component, and of rows in a
    component without any id, one with the smallest digest of its set stays.
    """
    groups = written(_components(docs, id_col, text_col, n=n, **how))
    some = groups.where("n_shingles > 0")
    side = lambda ids: F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    odd = written(groups.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_odd")))
    of_id = F.col(f"`{id_col}`").cast("long")
    gone = written(some.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct())
    if odd.isEmpty():
        return docs.join(side(gone), of_id == F.col("_gone"), "left_anti")
    odd = side(odd)
    plain = docs.join(odd, of_id.eqNullSafe(F.col("_odd")), "left_anti")
    plain = plain.join(side(gone), of_id == F.col("_gone"), "left_anti")
    # Rows with a null or repeated id are told apart by their sets.
    names = docs.columns
    rows = docs.join(odd, of_id.eqNullSafe(F.col("_odd")), "left_semi").select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    schema = StructType([*(StructField(f"_{i}", docs.schema[i].dataType) for i in range(len(names))), StructField("_node", LongType())])
    rows = rows.mapInArrow(_with_node(n, len(names)), schema).withColumn("_id", F.col(f"_{names.index(id_col)}").cast("long"))
    keepers = some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")).select("k.doc_id", "k.node")
    empty = rows.where("_node = 0")
    kept = rows.where("_node != 0").join(keepers, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node")), "left_semi").dropDuplicates(["_id", "_node"])
    return plain.union(empty.union(kept).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)]))
