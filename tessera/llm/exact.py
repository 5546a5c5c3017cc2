"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Each row gets the SHA-256 of its text with white space squeezed; the rows are
written once.  Then, over narrow columns only:

1. A task takes a fingerprint, the first bits of the digest, of each of its
   rows, sorts the distinct ones and sends each owner its range of values as
   the gaps between them in a Golomb code (with a power of two as divisor).
2. An owner decodes what it got and answers every sender by a bitmap: which of
   its fingerprints another sender has too.  A fingerprint comes once from a
   sender, so that a hot text is no hot key.
3. Rows under such a fingerprint, and those that a sender has twice itself,
   are suspects.  Only their texts are shuffled and compared byte by byte: they
   are grouped by the text, after a partial aggregation that sends a text once
   from each task.

Owners hold 50,000 to 4 million fingerprints.  The suspects of one partition of
rows are one bitmap; the bitmaps are broadcast in blocks of a checked size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import joined_with_hot
from .storage import drop_columns_clashing, written

#: Rows whose fingerprints a sender sorts at once.
SENDER_ROWS = 4_000_000
#: Fingerprints of an owner, least and most; there are 256 owners between the two.
OWNER_LEAST, OWNER_MOST = 50_000, 4_000_000
#: Bits of a fingerprint beyond those that number the rows: one in 2**10 rows is a suspect by chance.
MORE_BITS = 10
#: Bytes of bitmaps that are broadcast at once.
BROADCAST_BYTES = 64_000_000
#: Rows of one partition are numbered below this.
_PART = 33


def squeezed(text: Column) -> Column:
    """A text with each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def golomb_encoded(values: np.ndarray, divisor_bits: int) -> bytes:
    """Sorted distinct numbers below 2**63 as gaps: quotients in unary, then remainders of ``divisor_bits`` bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.int64(0))
    quotient = gaps >> divisor_bits
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(divisor_bits - 1, -1, -1, dtype=np.int64)
    rest = ((gaps[:, None] >> shifts) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decoded(code: bytes, n: int, divisor_bits: int) -> np.ndarray:
    """The ``n`` numbers of ``golomb_encoded``."""
    if not n:
        return np.empty(0, np.int64)
    tail = (n * divisor_bits + 7) // 8
    unary, rest = np.frombuffer(code, np.uint8, len(code) - tail), np.frombuffer(code, np.uint8, tail, len(code) - tail)
    ends = np.flatnonzero(np.unpackbits(unary))[:n]
    gaps = np.diff(ends, prepend=-1) - 1 << divisor_bits
    if divisor_bits:
        bits = np.unpackbits(rest)[: n * divisor_bits].reshape(n, divisor_bits).astype(np.int64)
        gaps = gaps + bits @ (np.int64(1) << np.arange(divisor_bits - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps)


def divisor_bits(span: int, n: int) -> int:
    """Bits of the divisor that suits ``n`` numbers below ``span``: near the mean gap times ln 2."""
    return max(0, int(math.log2(max(1.0, span / max(n, 1) * math.log(2)))))


class _Ranges:
    """The values of each owner: ``bits`` of a fingerprint, cut into equal ranges."""

    def __init__(self, rows: int):
        self.bits = min(52, max(24, rows.bit_length() + MORE_BITS))
        self.owners = max(1, -(-rows // min(OWNER_MOST, max(OWNER_LEAST, rows // 256))))
        self.width = -(-(1 << self.bits) // self.owners)


def _messages(held: DataFrame, ranges: _Ranges) -> DataFrame:
    """What each sender sends to each owner, and what it keeps at home: a row of each fingerprint, and the rows under one that it has several times."""
    bits, width = ranges.bits, ranges.width

    def sent(prints: np.ndarray, rows: np.ndarray, turn: int) -> pa.RecordBatch:
        order = np.argsort(prints, kind="stable")
        prints, rows = prints[order], rows[order]
        first = np.append(True, prints[1:] != prints[:-1])
        twice = ~first | np.append(~first[1:], False)
        sender = TaskContext.get().partitionId() << 20 | turn
        owner = prints // width
        cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = prints[a:b][first[a:b]] - owner[a] * width
            out.append((sender, int(owner[a]), len(own), golomb_encoded(own, divisor_bits(width, len(own))), rows[a:b][first[a:b]].tobytes(), rows[a:b][twice[a:b]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["sender", "owner", "n", "code", "rows", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, rows, many, turn = [], [], 0, 0
        for batch in batches:
            rows.append(batch.column(0).to_numpy())
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8")
            prints.append((raw >> np.uint64(64 - bits)).astype(np.int64))
            many += batch.num_rows
            if many >= SENDER_ROWS:
                yield sent(np.concatenate(prints), np.concatenate(rows), turn)
                prints, rows, many, turn = [], [], 0, turn + 1
        if many:
            yield sent(np.concatenate(prints), np.concatenate(rows), turn)

    return held.select("row", F.substring("sha", 1, 8).alias("head")).mapInArrow(run, "sender long, owner long, n int, code binary, rows binary, twice binary")


def _answers(messages: DataFrame, ranges: _Ranges) -> DataFrame:
    """``(sender, owner, bitmap)``: which of a message's fingerprints another sender has too; none of which it has is no row."""
    width = ranges.width

    def answer(table: pa.Table) -> pa.Table:
        counts = table["n"].to_numpy()
        prints = np.concatenate([golomb_decoded(c.as_py(), n, divisor_bits(width, n)) for c, n in zip(table["code"], counts.tolist(), strict=True)])
        order = np.argsort(prints, kind="stable")
        again = prints[order][1:] == prints[order][:-1]
        common = np.zeros(len(prints), bool)
        common[order] = np.append(False, again) | np.append(again, False)
        ends = np.cumsum(counts)
        bitmaps = [np.packbits(common[e - n : e]).tobytes() if common[e - n : e].any() else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        out = pa.table({"sender": table["sender"], "owner": table["owner"], "bitmap": pa.array(bitmaps, pa.binary())})
        return out.filter(out["bitmap"].is_valid())

    return messages.select("sender", "owner", "n", "code").groupBy("owner").applyInArrow(answer, "sender long, owner long, bitmap binary")


def _suspects(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """``(part, bits)``: for each partition of the rows a bit for each suspect, 64 in a long."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows, twice, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(twice, np.int64)
                if bitmap is not None:
                    found = np.union1d(found, np.frombuffer(rows, np.int64)[np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found >> _PART), pa.array(found & ((1 << _PART) - 1))], names=["part", "place"])

    def gathered(table: pa.Table) -> pa.Table:
        places = table["place"].to_numpy()
        bits = np.zeros((int(places.max()) // 64 + 1) * 64, np.uint8)
        bits[places] = 1
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").view("<i8")], pa.list_(pa.int64()))})

    rows = messages.select("sender", "owner", "n", "rows", "twice").join(answers, ["sender", "owner"], "left").where("bitmap is not null or octet_length(twice) > 0")
    return rows.select("n", "rows", "twice", "bitmap").mapInArrow(marked, "part long, place long").groupBy("part").applyInArrow(gathered, "part long, bits array<long>")


def _only_suspects(held: DataFrame, bitmaps: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``held`` whose bit is set; a range of partitions at a time, so that its bitmaps fit a broadcast."""
    last, total = bitmaps.agg(F.max("part"), F.sum(F.size("bits") * 8)).first()
    if last is None:
        return held.limit(0)
    blocks = -(-total // most)
    while True:
        width = last // blocks + 1
        largest = bitmaps.groupBy(F.floor(F.col("part") / width)).agg(F.sum(F.size("bits") * 8).alias("bytes")).agg(F.max("bytes")).first()[0]
        if largest <= most or width == 1:
            break
        blocks *= 2
    place = F.col("row").bitwiseAND((1 << _PART) - 1)
    found = []
    for at in range(0, last + 1, width):
        own = bitmaps.where((F.col("part") >= at) & (F.col("part") < at + width))
        own = F.broadcast(own) if largest <= most else own
        rows = held.where((F.col("row") >= at << _PART) & (F.col("row") < (at + width) << _PART)).withColumn("part", F.shiftright("row", _PART))
        bit = F.getbit(F.get("bits", F.floor(place / 64).cast("int")), (place % 64).cast("int"))
        found.append(rows.join(own, "part").where(F.coalesce(bit, F.lit(0)) == 1).drop("part", "bits"))
    return reduce(DataFrame.union, found)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal if they are so with each run of white space as one space;
    null counts as the empty text.  Of equal texts the row with the smallest id
    stays; a null id counts as greater than all others, and of rows with equal
    id and text one stays.  keep_id is the id of the row that stays.  ``keep``
    names the columns to keep; ``only_kept`` returns the input columns of the
    rows that stay.  Columns with added names give way; others may have any
    name.  An empty table gives an empty one.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    names = docs.columns if only_kept else drop_columns_clashing(docs.select(*keep) if keep else docs, *added).columns
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]
    text = f"_{names.index(text_col)}" if text_col in names else "_text"
    rows = docs.select(*own, F.col(f"`{id_col}`").alias("id"), *([] if text in [f"_{i}" for i in range(len(names))] else [F.col(f"`{text_col}`").alias(text)]))
    held = written(rows.withColumn("sha", F.unhex(F.sha2(squeezed(F.col(text)), 256))).withColumn("row", F.monotonically_increasing_id()))
    total = held.count()
    ranges = _Ranges(total)
    messages = written(_messages(held, ranges))
    bitmaps = written(_suspects(messages, _answers(messages, ranges)))

    suspects = _only_suspects(held.select("id", "sha", "row", F.col(text).alias("text")), bitmaps)
    first = F.coalesce(F.min_by("row", "id"), F.min("row"))
    classes = suspects.select("id", "sha", "row", squeezed(F.col("text")).alias("text")).groupBy("sha", "text").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"), first.alias("first"))
    # Bytes were compared; two texts of one digest would be two rows here.
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long")).otherwise(F.max("n"))
    classes = written(classes.groupBy("sha").agg(one.alias("n"), F.max("keep_id").alias("keep_id"), F.max("first").alias("first")).where("n > 1"))

    judged = joined_with_hot(held.drop("_text") if text == "_text" else held, classes, "sha", total)
    kept = F.col("n").isNull() | (F.col("row") == F.col("first"))
    given = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
    if only_kept:
        return judged.where(kept).select(*given)
    return judged.select(*given, F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(kept, F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t
"""
