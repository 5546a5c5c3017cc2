"""An inverted index of folded texts: lexical search that reads the postings of its words, not the texts.

An index is a folder of Parquet tables.  ``documents`` holds ``block, slot, id,
folded``; a block is a run of at most 1,024 documents, so that no list of an
index grows with the corpus.  ``postings`` holds ``term, block, slots`` in
directories by a hash of the term.  ``terms`` is the vocabulary.  Each addition
is a segment with tables of its own; a segment counts once it is listed in
``segments`` (with its number of documents and the type of its ids), so that
one whose writer died is never read.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text
from .graph import saved, sized
from .search import query_words

#: Documents of a block, as a power of two; places of documents are 64 bits, 33 of them within a task.
BLOCK_BITS, TASK_BITS = 10, 33
#: Directories of postings and of documents.
BUCKETS, SPANS = 64, 1_024
#: Bytes of text whose words are listed at once.
AT_ONCE = 16_000_000
#: Places in a bucket over which the postings of one term are dealt.
SALT = 8
PLACE = ["segment", "block", "slot"]
#: Schemas of the tables; all but ``segments`` also have their directories' columns.
SEGMENTS = "segment string, documents long, id_type string"
TABLES = {
    "documents": "block long, slot int, id {id_type}, folded string, segment string, span int",
    "postings": "term string, block long, slots array<int>, segment string, bucket int",
    "terms": "term string, documents long, segment string",
}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _span(place: Column) -> Column:
    return F.pmod(F.shiftright(place, TASK_BITS), F.lit(SPANS)).cast("int")


def _lists():
    """mapInArrow function of ``block, slot, folded``: ``term, block, slots`` of runs, a row for each term of a run.

    A run lies in one block and has one text or at most AT_ONCE bytes.  A block
    that several tasks read has several rows for a term.
    """

    def run(batches):
        for batch in batches:
            block, slot, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            at = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) // AT_ONCE
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (at[1:] != at[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                words = pc.split_pattern_regex(texts.slice(a, b - a), pattern="[^a-z0-9]+")
                coded = words.flatten().dictionary_encode()
                of = np.repeat(slot[a:b], np.asarray(pc.list_value_length(words))).astype(np.int64)
                pairs = np.unique((coded.indices.to_numpy().astype(np.int64) << 32) | of)
                code, of = pairs >> 32, (pairs & (2**32 - 1)).astype(np.int32)
                first = np.flatnonzero(np.diff(code, prepend=-1))
                terms = coded.dictionary.take(pa.array(code[first]))
                slots = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(of))
                rows = pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(first), block[a])), slots], names=["term", "block", "slots"])
                yield rows.filter(pc.greater_equal(pc.binary_length(terms), 2))

    return run


def add(items: DataFrame, folder: str, id_col: str = "id", text_col: str = "text", block_bits: int = BLOCK_BITS) -> None:
    """Write ``items`` to the index at ``folder`` as one more segment; the first addition makes the index.

    Rows with a null text are left out, as no query finds them.  Repeated ids
    are rows of their own.  Additions have ids of one type.
    """
    spark, segment, id_type = items.sparkSession, uuid.uuid4().hex, items.schema[id_col].dataType.simpleString()
    numbered = items.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), fold(F.col(text_col)).alias("folded"))
    # A block is named by its first place.
    slot = F.col("n").bitwiseAND(2**block_bits - 1)
    at = f"{folder}/documents/segment={segment}"
    numbered.select(_span(F.col("n")).alias("span"), (F.col("n") - slot).alias("block"), slot.cast("int").alias("slot"), "id", "folded").write.partitionBy("span").parquet(at)
    documents = spark.read.schema(TABLES["documents"].format(id_type=id_type).replace(", segment string", "")).parquet(at)
    lists = documents.select("block", "slot", "folded").mapInArrow(_lists(), "term string, block long, slots array<int>")
    # A word of every document has one row a block or few, as any other, so no directory is much larger than the rest.
    dealt = lists.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SALT)))
    dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings/segment={segment}")
    read = spark.read.schema("term string, slots array<int>").parquet(f"{folder}/postings/segment={segment}")
    read.groupBy("term").agg(F.sum(F.size("slots")).cast("long").alias("documents")).write.parquet(f"{folder}/terms/segment={segment}")
    spark.createDataFrame([(segment, documents.count(), id_type)], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{folder}/segments")


class TextIndex:
    """An index as it is when opened; later additions are seen by opening it again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        listed = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").collect()  # a row for each addition
        self.segments = sorted(r.segment for r in listed if r.documents)
        self.id_type = listed[0].id_type

    def table(self, name: str) -> DataFrame:
        """One of the index's tables over all listed segments."""
        paths = [f"{self.folder}/{name}/segment={s}" for s in self.segments]
        return self.spark.read.schema(TABLES[name].format(id_type=self.id_type)).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def matched(self, query: str) -> DataFrame:
        """``term, word, points, bucket``: terms that are (3) or contain (1) a word of the query, saved.

        A word consists of the characters of terms, so it occurs in a text just
        where it occurs in one of the text's terms.
        """
        words = sorted(set(query_words(query)))
        found = [F.when(F.contains("term", F.lit(w)), F.struct(F.lit(w).alias("word"), F.when(F.col("term") == w, 3).otherwise(1).alias("points"))) for w in words]
        if not found:
            return self.spark.createDataFrame([], "term string, word string, points int, bucket int")
        terms = self.table("terms").select("term").where(reduce(Column.__or__, [F.contains("term", F.lit(w)) for w in words])).distinct()
        return saved(terms.select("term", F.explode(F.array_compact(F.array(*found))).alias("m")).select("term", "m.word", "m.points", _bucket(F.col("term")).alias("bucket")))

    def _hits(self, matched: DataFrame) -> DataFrame:
        """Postings of the matched terms, ``segment, block, word, points, slots``, from their buckets only."""
        buckets = [r.bucket for r in matched.select("bucket").distinct().collect()]  # at most BUCKETS
        return self.table("postings").where(F.col("bucket").isin(buckets)).drop("bucket").join(sized(matched.drop("bucket")), "term").drop("term")

    def _points(self, query: str, rows: DataFrame, by: list[str]) -> DataFrame:
        """``by, points, whole``: the words' points, and whether every word occurs, from ``by, word, points``."""
        words = query_words(query)
        each = {w: f"_w{k}" for k, w in enumerate(sorted(set(words)))}
        best = rows.groupBy(*by).agg(*[F.max(F.when(F.col("word") == w, F.col("points"))).alias(c) for w, c in each.items()])
        total = reduce(Column.__add__, [F.coalesce(F.col(each[w]), F.lit(0)) for w in words])
        return best.select(*by, total.cast("long").alias("points"), reduce(Column.__and__, [F.col(c).isNotNull() for c in each.values()]).alias("whole"))

    def _with_phrase(self, query: str, scored: DataFrame | None) -> DataFrame:
        """``segment, block, slot, id, lexical`` of all ``scored`` places (saved; none: of the whole index), with the points of the whole phrase.

        Only directories with a place that has every word are read for it, and
        of these only places that hold it leave the scan.
        """
        folded, documents = fold_text(query), self.table("documents")
        has = F.contains("folded", F.lit(folded))
        if scored is None:
            return documents.where(has if len(folded) > 3 else F.lit(False)).select(*PLACE, "id", F.lit(5).cast("long").alias("lexical"))
        spans = [[r.span for r in rows.select(_span(F.col("block")).alias("span")).distinct().collect()] for rows in (scored, scored.where("whole"))]  # at most SPANS
        out = documents.where(F.col("span").isin(spans[0])).select(*PLACE, "id").join(sized(scored), PLACE)
        if len(folded) <= 3:
            return out.select(*PLACE, "id", F.col("points").alias("lexical"))
        holds = saved(documents.where(F.col("span").isin(spans[1]) & has).select(*PLACE, F.lit(5).alias("phrase")))
        return out.join(sized(holds), PLACE, "left").select(*PLACE, "id", (F.col("points") + F.coalesce("phrase", F.lit(0))).alias("lexical"))

    def _scored(self, query: str, hits: DataFrame) -> DataFrame:
        places = hits.select("segment", "block", F.explode("slots").alias("slot"), "word", "points")
        return saved(self._points(query, places, PLACE))

    def scores(self, query: str) -> DataFrame:
        """``id, lexical`` of every document with points, as ``lexical_search`` counts them.

        A query without a word of two letters or more has only its phrase, for
        which all texts are read.
        """
        if not self.segments or not query_words(query):
            return self._empty() if not self.segments else self._with_phrase(query, None).select("id", "lexical")
        return self._with_phrase(query, self._scored(query, self._hits(self.matched(query)))).select("id", "lexical")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"id {self.id_type}, lexical long")

    def bounds(self, query: str, matched: DataFrame) -> DataFrame:
        """``segment, block, bound``: the most points that a document of a block can have; no list of documents is read."""
        best = self._points(query, self._hits(matched).select("segment", "block", "word", "points"), ["segment", "block"])
        more = F.when(F.col("whole"), 5).otherwise(0) if len(fold_text(query)) > 3 else F.lit(0)
        return best.select("segment", "block", (F.col("points") + more).alias("bound"))

    def top(self, query: str, k: int) -> DataFrame:
        """The ``k`` documents with most points, ``id, lexical``; ties go to the smaller id.

        The ``k`` blocks with the greatest bounds hold ``k`` documents with
        points or more.  The k-th best of these is a floor: only blocks whose
        bound reaches it can hold one of the result, and only these are scored.
        """
        order = [F.desc("lexical"), F.asc("id")]
        if not self.segments or not query_words(query):
            return self.scores(query).orderBy(*order).limit(k)
        matched = self.matched(query)
        bounds = saved(self.bounds(query, matched))
        hits = self._hits(matched)

        def of(blocks: DataFrame) -> DataFrame:
            return self._with_phrase(query, self._scored(query, hits.join(sized(blocks.select("segment", "block")), ["segment", "block"], "left_semi")))

        first = of(saved(bounds.orderBy(F.desc("bound"), "segment", "block").limit(k)))
        best = [r.lexical for r in first.select("lexical").orderBy(F.desc("lexical")).limit(k).collect()]  # k numbers
        floor = best[-1] if len(best) == k else 0
        return of(saved(bounds.where(F.col("bound") >= floor))).select("id", "lexical").orderBy(*order).limit(k)
