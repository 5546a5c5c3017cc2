"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words.  Source targets share all words by weight; a target stops at
``cap`` times its source and the excess is shared again (water filling, in
closed form by windows over the small table of sources).  A source is taken in
whole epochs as often as its target allows; for the rest its documents stand
in the order of exponential keys -ln(u)/q, u from a digest of the id, q the
document's quality weight, and are taken while the prefix sum of sizes stays
within the budget; the document at the boundary gives the words still missing.

*Scale.*  Keys are put in buckets that keep their order.  Prefix sums of
buckets find the one bucket of a source where the budget ends; only its rows
are sorted, so a source with a third of all rows is never one sort.  Texts are
not shuffled.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop_columns_clashing, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Buckets of keys: this many at least, and one for so many rows.
LEAST_BUCKETS, BUCKET_ROWS = 1_024, 20_000
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 200_000


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.05 and 1: lower the more symbols there are for a word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, F.greatest(F.lit(0.05), 1 / (1 + 4 * symbols / size))).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``(no_source, source, source_size)`` with ``target``: weighted shares of all sizes, stopped at ``cap`` times a source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source")))
    turns = F.array(*[F.lit(float(w)) for w in weights])
    w = ranked.withColumn("weight", F.element_at(turns, (F.col("rank") - 1) % len(weights) + 1)).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    level = (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = w.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") <= F.col("level")).withColumn("place", F.row_number().over(order))
    final = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * final)).select("no_source", "source", "source_size", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", keep: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    Sources are ordered by code point, null last, and weigh in turns.  Empty
    and null texts have size 0 and give nothing.  A null id is drawn as the
    text "null"; repeated rows are drawn one by one, and ties of key are
    ordered by id and size (rows equal in these may change places).  ``weight``
    is a document's quality, above zero, such as the posterior of the quality
    rules; by default it is read off the text.  An empty table gives an empty
    one.  Columns with added names give way; ``keep`` names
    the columns to keep.
    """
    spark = docs.sparkSession
    given = drop_columns_clashing(docs.select(*keep) if keep else docs, "size", "source_size", "target", "taken")
    names = given.columns
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    sized = (
        docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").isNull().alias("no_source"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"), size.alias("size"), text.alias("text"), (F.lit(1.0) if weight is None else weight).alias("weight"))
        .withColumn("key", -F.log(u) / (quality_weight(F.col("text"), F.col("size")) if weight is None else F.col("weight"))).drop("text", "weight")
    )
    if text_col not in names:
        sized = written(sized)
        small = sized
    else:
        small = written(sized.select("id", "no_source", "source", "size", "key"))
    many = max(LEAST_BUCKETS, small.count() // BUCKET_ROWS)
    bucket = F.floor(F.col("key") / (1 + F.col("key")) * many)
    of = ["no_source", "source"]

    buckets = written(small.groupBy(*of, bucket.alias("bucket")).agg(F.sum("size").alias("words")))
    targets = source_targets(buckets.groupBy(*of).agg(F.sum("words").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    before = F.sum("words").over(Window.partitionBy(*of).orderBy("bucket")) - F.col("words")
    edge = buckets.withColumn("before", before).join(plan.select(*of, "rest"), of).where("before <= rest and rest < before + words").select(*of, F.col("bucket").alias("edge"), F.col("rest") - F.col("before"))
    edge = edge.toDF(*of, "edge", "left")
    plan = written(plan.join(edge, of, "left"))
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan

    rows = sized.withColumn("bucket", bucket).join(side, of)
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    earlier = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
    clear = rows.where(~at_edge).withColumn("more", F.when(earlier, F.col("size")).otherwise(F.lit(0)))
    ahead = F.sum("size").over(Window.partitionBy(*of).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    split = rows.where(at_edge).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - ahead)))
    both = clear.unionByName(split)
    return both.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("more")).cast("long").alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / CASE WHEN size > 0 THEN greatest(0.05, 1 / (1 + 4 * CAST(symbols AS DOUBLE) / size)) ELSE 1.0 END AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM keyed GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM sources),
levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY 3 * source_size / weight, rank) AS place FROM weighed),
planned AS (
  SELECT source, source_size, CAST(CASE WHEN 3 * source_size / weight <= level THEN 3 * source_size
         ELSE weight * (SELECT arg_min(level, place) FROM levelled WHERE 3 * source_size / weight > level) END AS DOUBLE) AS target FROM levelled),
ordered AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS ahead
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, floor(target - epochs * source_size) - ahead)) AS BIGINT) AS taken
FROM ordered
"""
