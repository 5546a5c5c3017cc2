"""Hybrid search and nearest-item matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, lexical_score
from ..functions.vectors import cosine, hint
from .graph import saved

#: Fixed value: the constant of reciprocal-rank fusion.
RRF = 60


def query_words(query: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", fold_text(query)) if len(w) >= 2]


def lexical_search(items: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """``items`` with ``lexical``, a whole number (null for a null text)."""
    # Columns of their own, so that a text is folded and split once.
    rows = items.withColumn("_folded", fold(F.col(text_col))).withColumn("_own", F.split("_folded", "[^a-z0-9]+"))
    return rows.withColumn("lexical", lexical_score(F.col("_folded"), F.col("_own"), fold_text(query), query_words(query)).cast("long")).drop("_folded", "_own")


#: Scores on more rows than one of this share of all are joined by broadcast: at most so many scores.
HOT_SCORES = 10_000


def competition_rank(rows: DataFrame, score: str, name: str, parts: int = 64) -> DataFrame:
    """``rows``, a saved table, with competition ranks by descending score, without one sort of all rows.

    Ranks need only the number of rows with a greater score: counts of distinct
    scores are summed over ranges of scores, then inside each range.  Scores
    that many rows share are looked up by broadcast, the others by a join in
    which no key has many rows.
    """
    counts = saved(rows.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n")))
    edges = sorted(set(counts.approxQuantile("_s", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    bucket = F.lit(0)
    for b in edges:
        bucket = bucket + F.when(F.col("_s") < b, 1).otherwise(0)
    bucketed = counts.withColumn("_b", bucket)
    inside = Window.partitionBy("_b").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("_b").agg(F.sum("_n").alias("_t"))  # at most ``parts`` rows
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = bucketed.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(totals.select("_b", "_before")), "_b")
    ranked = saved(ranked.select(F.col("_s").alias("_key"), "_n", (F.col("_before") + F.col("_in") + 1).alias(name)))
    if ranked.count() <= HOT_SCORES:
        return rows.join(F.broadcast(ranked.drop("_n")), rows[score] == F.col("_key")).drop("_key")
    most = max(64, rows.count() // HOT_SCORES)
    marked = rows.join(F.broadcast(ranked.where(F.col("_n") > most).drop("_n")), rows[score] == F.col("_key"), "left").drop("_key")
    cold = marked.where(F.col(name).isNull()).drop(name).join(ranked.where(F.col("_n") <= most).drop("_n"), F.col(score) == F.col("_key")).drop("_key")
    return marked.where(F.col(name).isNotNull()).unionByName(cold)


def hybrid_search(items: DataFrame, query: str, vector: list[float] | None, k: int = 10, text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """The ``k`` best items ``id, score, lexical, cosine`` by reciprocal-rank fusion; ties go to the smaller id.

    An item without a vector has cosine -1 and ranks last.  Without a query
    vector the lexical score alone decides.
    """
    rows = lexical_search(items, query, text_col)
    if vector is None:
        scored = rows.where("lexical > 0").withColumn("cosine", F.lit(None).cast("double")).withColumn("score", F.col("lexical").cast("double"))
    else:
        q = F.array(*[F.lit(float(x)) for x in vector])
        rows = saved(rows.withColumn("cosine", F.coalesce(cosine(q, F.col(vector_col)), F.lit(-1.0))).select("id", "lexical", "cosine"))
        ranked = competition_rank(competition_rank(rows, "lexical", "by_text"), "cosine", "by_vector")
        scored = ranked.withColumn("score", 1.0 / (RRF + F.col("by_text")) + 1.0 / (RRF + F.col("by_vector")))
    return scored.orderBy(F.desc("score"), "id").limit(k).select("id", F.round("score", 6).alias("score"), "lexical", F.round("cosine", 4).alias("cosine"))


def ready_first(hits: DataFrame, states: DataFrame) -> DataFrame:
    """Hits whose dependencies are all mastered before the others, each by score."""
    return hits.join(states, "id", "left").withColumn("ready", F.col("state").isin("done", "ready")).orderBy(F.desc("ready"), F.desc("score"), "id")


#: Rows of the stated query set in a block, and of the other side compared with it at once.
BLOCK, AT_ONCE = 2_000, 1_000


def _blocks(rows: DataFrame, columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of a stated query set, a block at a time."""
    block = []
    for r in rows.select(*columns).toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _passes(blocks, items: DataFrame, run, schema: str) -> DataFrame:
    """``run(block)`` over all items, a pass for each block."""
    out = None
    for block in blocks:
        part = items.mapInArrow(run(items.sparkSession.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else items.sparkSession.createDataFrame([], schema)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Indices (k by columns) of the greatest scores of each column, the first of equal ones first."""
    return np.argsort(-score, axis=0, kind="stable")[:k]


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, and which rows have a vector of this width."""
    out, known = np.zeros((len(column), width)), np.zeros(len(column), bool)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    known[:] = size == width
    if width and known.any():
        out[known] = np.asarray(pc.list_flatten(column.filter(pa.array(known)))).astype(float).reshape(-1, width)
    return out, known


def _compare(block, k: int):
    """mapInArrow function of (id, words, concepts, vector): the k best items of a batch for each candidate."""

    def postings(lists):
        names: dict[str, list[int]] = {}
        for c, words in enumerate(lists):
            for w in words or ():
                names.setdefault(w, []).append(c)
        many = np.array([len(x) for x in names.values()], np.int64)
        return pa.array(list(names), pa.string()), np.array([c for x in names.values() for c in x], np.int64), np.cumsum(many) - many, many

    def common(column, index, m):
        vocabulary, of, begin, many = index
        n = len(column)
        size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        at = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(column), value_set=vocabulary), -1)).astype(np.int64)
        row = np.repeat(np.arange(n), size)[at >= 0]
        at = at[at >= 0]
        each = many[at]
        place = np.arange(int(each.sum())) + np.repeat(begin[at] - (np.cumsum(each) - each), each)
        return np.bincount(np.repeat(row, each) * m + of[place], minlength=n * m).reshape(n, m), size

    def run(batches):
        names, words, concepts, vectors = zip(*block.value, strict=True)
        m, width = len(names), max((len(v) for v in vectors if v is not None), default=0)
        q = np.array([v if v is not None and len(v) == width else [0.0] * width for v in vectors], float).reshape(m, width)
        asks = (q**2).sum(axis=1) > 0
        title, concept = postings(words), postings(concepts)
        n_words, n_concepts = (np.array([len(x or ()) for x in side], np.int64) for side in (words, concepts))
        for given in batches:
            for start in range(0, given.num_rows, AT_ONCE):
                batch = given.slice(start, AT_ONCE)
                batch = batch.take(pc.sort_indices(batch.column(0)))
                both, size = common(batch.column(2), concept, m)
                union = size[:, None] + n_concepts - both
                shared = np.where(union > 0, both / np.maximum(union, 1), 0.0)
                both, size = common(batch.column(1), title, m)
                least = np.minimum(size[:, None], n_words)
                overlap_ = np.where(least > 0, both / np.maximum(least, 1), 0.0)
                x, known = _vectors(batch.column(3), width)
                length = np.sqrt((x**2).sum(axis=1))[:, None]
                near = np.where(length > 0, (x @ q.T) / np.where(length > 0, length, 1), 0.0)
                has = known[:, None] & asks[None] & (width > 0)
                score = np.round(np.where(has, near, 0.0) + 0.5 * shared + 0.3 * overlap_, 9)
                best = _best(score, k)
                row, col = best.ravel(), np.tile(np.arange(m), len(best))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[c] for c in col], pa.string()), batch.column(0).take(pa.array(row)).cast(pa.string()), pa.array(score[row, col]), pa.array(near[row, col], mask=~has[row, col]), pa.array(shared[row, col]), pa.array(overlap_[row, col])],
                    names=["candidate", "id", "blend", "cosine", "shared", "title_overlap"],
                )

    return run


def match(candidates: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """For each candidate the ``k`` nearest items and a hint from the best: ``candidate, id, place, cosine, concepts, title_overlap, hint``.

    Both sides have ``id, words (title), concepts`` and ``vector`` (or null).
    Candidates are the stated query set: blocks of them are compared with all
    items, and a batch of items passes on its ``k`` best for each candidate.
    """
    columns = ["id", "words", "concepts", "vector"]
    found = _passes(_blocks(candidates, columns), items.select(*columns), lambda block: _compare(block, k), "candidate string, id string, blend double, cosine double, shared double, title_overlap double")
    place = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("blend"), "id"))
    top = saved(found.withColumn("place", place).where(F.col("place") <= k))
    best = top.where("place = 1").select("candidate", hint(F.col("cosine"), F.col("shared"), F.col("title_overlap")).alias("hint"))
    return top.join(best, "candidate").select("candidate", "id", "place", F.round("cosine", 4).alias("cosine"), F.round("shared", 6).alias("concepts"), F.round("title_overlap", 6).alias("title_overlap"), "hint")


def _nearest(block, k: int):
    def run(batches):
        names, vectors = zip(*block.value, strict=True)
        width = max((len(v) for v in vectors if v is not None), default=0)
        q = np.array([v if v is not None and len(v) == width else [0.0] * width for v in vectors], float).reshape(len(names), width)
        ids = np.array(names, np.int64)
        for given in batches:
            for start in range(0, given.num_rows, AT_ONCE):
                batch = given.slice(start, AT_ONCE)
                batch = batch.take(pc.sort_indices(batch.column(0)))
                x, known = _vectors(batch.column(1), width)
                own = batch.column(0).to_numpy()
                length = np.sqrt((x**2).sum(axis=1))[:, None]
                score = np.round(np.where(length > 0, (x @ q.T) / np.where(length > 0, length, 1), 0.0), 6)
                score[(own[:, None] == ids[None]) | ~known[:, None]] = -np.inf
                best = _best(score, k)
                row, col = best.ravel(), np.tile(np.arange(len(ids)), len(best))
                some = np.isfinite(score[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(ids[col[some]]), pa.array(own[row[some]]), pa.array(score[row[some], col[some]])], names=["query", "id", "cosine"])

    return run


def vector_topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``query, id, cosine, place``: for each of ``queries(id, vector)`` the ``k`` nearest of ``items(id, vector)`` with another id.

    Queries are the stated query set: blocks of them are multiplied with all
    items.  Ties go to the smaller id; items without a vector of the queries'
    width are left out.
    """
    found = _passes(_blocks(queries, ["id", "vector"]), items.select("id", "vector"), lambda block: _nearest(block, k), "query long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def match_lines(matches: DataFrame) -> DataFrame:
    """One JSON line for each candidate."""
    each = F.struct("place", "id", "cosine", "concepts", "title_overlap")
    rows = matches.groupBy("candidate", "hint").agg(F.array_sort(F.collect_list(each)).alias("matches"))
    return rows.select(F.to_json(F.struct("candidate", "hint", "matches")).alias("value"))
