"""How filters of a corpus act together: every order of them from one count.

For each part of a corpus the documents that fail all filters of a set jointly
are counted for every set, as sums of products of flags.  All else follows
from these 2**k numbers by inclusion and exclusion:

* survivors of a set of filters: the alternating sum over its subsets;
* documents that fail one filter only: the Möbius inverse at that filter;
* redundancy of a step: its filter's failures less what it removes there;
* the Shapley value: the joint counts are, but for a sign, the Harsanyi
  dividends of the game "documents removed by a set", and a filter gets an
  equal share of each dividend that it has a part in.

Documents are read once and reduced to a digest, flags and labels.  Flag
patterns are counted with a partial aggregation, so a part with a third of all
documents is a few rows of a shuffle.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import joined_with_hot
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, fails, good, toxic)`` for each document; bit k of ``fails`` is filter k of A to E.

    A: under 200 words; B: 100 times the distinct words are less than 50 times
    the words; C: more than two of a hundred code points are A-Z; D: any of
    ``#$%&*|``; E: the whole text is that of a document with a smaller id.

    A null text is empty, a null part the empty string.  A null id counts as
    greater than all others and has no labels; repeated ids are no smaller
    ones.  A document is good or toxic if any of its labels says so.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    few, repeats = F.size("words") < 200, 100 * F.size(F.array_distinct("words")) < 50 * F.size("words")
    capitals, marks = 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")
    bits = reduce(Column.__add__, [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate((few, repeats, capitals, marks))])
    rows = written(words.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), bits.alias("bits")))

    copies = written(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"))
    rows = joined_with_hot(rows, copies, "sha", rows.count())
    later = F.col("n").isNotNull() & F.when(F.col("id").isNull(), F.col("least").isNotNull()).otherwise(F.col("id") > F.col("least"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flagged = rows.select("id", "part", (F.col("bits") + F.when(later, F.lit(16)).otherwise(F.lit(0))).alias("fails"))
    named = flagged.where("id is not null").join(said.withColumnRenamed("doc_id", "id"), "id", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return named.union(flagged.where("id is null").select("part", "fails", F.lit(False), F.lit(False)))


def joint_failures(fails: DataFrame, k: int) -> DataFrame:
    """``(part, all, good, toxic)``: arrays with, for each of the 2**k sets of filters, how many documents fail all of the set.

    First the documents of each pattern of flags are counted, then the
    patterns, at most 2**k a part, are summed with the products of their flags.
    """
    patterns = fails.groupBy("part", "fails").agg(F.count("*").alias("all"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    flag = [F.getbit("fails", F.lit(i)).cast("long") for i in range(k)]

    def together(of: str) -> Column:
        product = lambda s: reduce(Column.__mul__, [flag[i] for i in range(k) if s >> i & 1], F.col(of))
        return F.array(*[F.sum(product(s)) for s in range(1 << k)]).alias(of)

    return patterns.groupBy("part").agg(together("all"), together("good"), together("toxic"))


def _sign(s: Column) -> Column:
    return 1 - 2 * (F.bit_count(s) % 2)


def survivors(joint: Column, k: int) -> Column:
    """For each set of filters how many documents fail none of it, from the joint failures of all sets."""
    sets = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    of = lambda p: F.aggregate(sets, F.lit(0).cast("long"), lambda sum_, s: sum_ + F.when(s.bitwiseAND(p) == s, F.get(joint, s) * _sign(s)).otherwise(F.lit(0)))
    return F.transform(sets, of)


def only_failures(joint: Column, k: int) -> Column:
    """For each filter the documents that fail it and no other: Möbius inversion over the sets that hold it."""
    return F.array(*[reduce(Column.__add__, [joint[s] * (-1) ** (s.bit_count() - 1) for s in range(1 << k) if s >> i & 1]) for i in range(k)])


def shapley(joint: Column, k: int) -> Column:
    """For each filter its removals summed over all k! orders: its shares of the dividends (-1)**(n+1) * joint failures of n filters."""
    return F.array(*[reduce(Column.__add__, [joint[s] * ((-1) ** (s.bit_count() + 1) * (factorial(k) // s.bit_count())) for s in range(1 << k) if s >> i & 1]) for i in range(k)])


def audit_filters(fails: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Every order of some filters (a letter each, up to six) and step: what it removes, in each part.

    ``fails(part, fails, good, toxic)`` has a row for each document; bit k of
    ``fails`` is the k-th filter.  Returns part, filter_order, step and the
    counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (summed over all orders).  An empty table gives an empty one.
    """
    k = len(names)
    joint = joint_failures(fails, k)
    figures = joint.select("part", F.col("all").alias("joint"), only_failures(F.col("all"), k).alias("only"), shapley(F.col("all"), k).alias("shares"), *[survivors(F.col(c), k).alias(c) for c in ("all", "good", "toxic")])
    orders = F.lit(["".join(p) for p in permutations(names)])
    steps = figures.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = lambda letter: F.position(letter, F.lit(names)) - 1
    earlier = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i < F.col("step"), F.pow(F.lit(2), place(F.substr("filter_order", i, F.lit(1)))).cast("int")).otherwise(F.lit(0)))
    own = place(F.substr("filter_order", "step", F.lit(1)))
    steps = steps.withColumn("before", F.aggregate(earlier, F.lit(0), lambda a, b: a + b)).withColumn("own", own).withColumn("after", F.col("before") + F.pow(F.lit(2), F.col("own")).cast("int"))
    lost = lambda of: F.get(of, F.col("before")) - F.get(of, F.col("after"))
    failed = F.get("joint", F.pow(F.lit(2), F.col("own")).cast("int"))
    return steps.select(
        "part", "filter_order", "step", F.get("all", F.col("after")).alias("kept"), lost("all").alias("removed"), (failed - lost("all")).alias("redundant"),
        F.get("only", F.col("own")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("own")).alias("shapley"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN rank() OVER (PARTITION BY x ORDER BY d.doc_id NULLS LAST) > 1 THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
p AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM c a, c b, c, c d, c e
      WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c != e.c),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
t AS (
  SELECT p.*, s.*, contains(fails, own) AS here, length(translate(fails, before, '')) < length(fails) AS gone FROM p, s),
a AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM t GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a
"""
