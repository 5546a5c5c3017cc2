"""Connected components of an edge table, with DataFrame operations only.

Alternating large-star and small-star steps: every step replaces the edges of
a node by edges to the smallest node near it, so that each component ends as
one star.  Aggregates are partial before their shuffle.  The least neighbours
of centres with very many edges, of which there can be few, are broadcast, so
that no key of a shuffled join has many rows.  Each round is written to the
shared folder, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


#: A node with more than this share of all edge ends (and this many) is a hot centre: at most HOT of them.
HOT, LEAST_HOT = 10_000, 64


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows(a, b)`` with ``m`` of ``least(a, m, n)``, where n is how many of the ``total`` rows have that a."""
    most = max(LEAST_HOT, total // HOT)
    marked = rows.join(F.broadcast(least.where(F.col("n") > most).select("a", "m")), "a", "left")
    cold = marked.where("m is null").select("a", "b").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return marked.where("m is not null").select("a", "b", "m").union(cold.select("a", "b", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    return _with_least(both, least, 2 * edges.count()).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = _with_least(edges, least, edges.count()).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges(a, b)`` and the smallest node of their component.

    Returns ``(node, root)`` for every node that has an edge to another node.
    Edges to oneself, repeated edges, either direction and null ends are
    allowed (a null end drops the edge).  An empty table gives an empty one.
    """
    now = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        now = written(_small_star(written(_large_star(now).distinct())).distinct())
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
