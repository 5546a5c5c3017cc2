"""Iterative graph operators over edge tables ``(src, dst)``.

Loops run on the driver, rounds in Spark.  Each round's new rows are written to
the checkpoint folder, so that lineage stays short and a lost executor repeats
one round at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which one side of a round's join is broadcast.
BROADCAST_ROWS = 500_000


def shared_path(spark: SparkSession, name: str = "rounds") -> str:
    """A new path in the shared checkpoint folder (a local session may leave the folder unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a saved table, as a broadcast side if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _closed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs with a path, and the pairs met again by a path of two edges or more.

    New pairs of a round are joined with all known ones, so path lengths
    double, and a round writes only what it finds.
    """
    new = saved(edges.select("src", "dst").distinct())
    known, again = new, new.limit(0)
    while not new.isEmpty():
        longer = new.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        found = saved(longer.join(known.withColumn("old", F.lit(True)), ["src", "dst"], "left"))
        new, again = found.where("old is null").select("src", "dst"), again.union(found.where("old").select("src", "dst"))
        known = known.union(new)
    return known, again


def reachable(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) with a path of at least one edge; cycles are allowed."""
    return _closed(edges)[0]


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges u-v of an acyclic graph that no longer path from u to v replaces.

    A shortest detour falls into two halves that are no edges themselves, so
    the closure meets every edge that has one again.
    """
    edges = edges.select("src", "dst").distinct()
    return edges.join(_closed(edges)[1], ["src", "dst"], "left_anti")


def longest_path_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, depth``: 0 without predecessors, else the greatest depth of these plus one; nodes on or behind a cycle get null."""
    layers = peeled(nodes, edges)[1]
    return nodes.select("id").distinct().join(layers, "id", "left")


def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(core, layers)``: edges left when nodes without predecessors are taken away again and again, and the
    round in which each other node went (its longest-path depth).

    A round writes, for the nodes still there, how many predecessors they wait
    for; only the edges of the nodes that just went are counted.  Edges from a
    node that is not among ``nodes`` hold nobody back.
    """
    ids = saved(nodes.select("id").distinct())
    pairs = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    pairs = saved(pairs.distinct())
    waits = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    state = saved(ids.join(waits, "id", "left").select("id", F.coalesce("need", F.lit(0).cast("long")).alias("need")))
    # Every round's nodes go to one folder, so that the layers are one scan, however many rounds there were.
    spark, folder, k = ids.sparkSession, shared_path(ids.sparkSession, "layers"), 0
    free = state.where("need = 0").select("id")
    while (n := free.count()):
        free.select("id", F.lit(k).alias("depth")).coalesce(1 if n <= BROADCAST_ROWS else max(1, n // BROADCAST_ROWS)).write.mode("append").parquet(folder)
        gone = F.broadcast(free) if n <= BROADCAST_ROWS else free
        met = pairs.join(gone.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        state = saved(state.where("need > 0").join(met, "id", "left").select("id", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")))
        free, k = state.where("need = 0").select("id"), k + 1
    none = ids.select("id", F.lit(0).alias("depth")).limit(0)
    layers = spark.read.schema(none.schema).parquet(folder) if k else none
    left = state.where("need > 0")
    return pairs.join(left.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"), layers


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    return not peeled(nodes, edges)[0].isEmpty()


def first_cycle_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``place, id``: the first cycle that a search in depth meets, nodes and successors taken in code-unit order, as a path that ends where it began; no row in an acyclic graph.

    When nodes without successors are taken away again and again, every node
    left has a successor left, and from such a node the search cannot come
    back empty-handed.  It therefore walks from the smallest node left to its
    smallest successor left, and so on, until it meets its own path.  That walk
    is found by doubling: the places of a set of 2**k steps are shifted by a
    table of 2**k steps, until a node has two places.
    """
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    core = peeled(nodes, backwards)[0]
    step = saved(core.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("to")))
    root = step.agg(F.min("id")).first()[0]
    if root is None:
        return step.select(F.lit(0).cast("long").alias("place"), "id").limit(0)
    walk = saved(step.where(F.col("id") == root).select(F.lit(0).cast("long").alias("place"), "id"))
    reach, jump = 1, step
    while walk.count() == walk.select("id").distinct().count():
        later = jump.join(sized(walk), "id").select((F.col("place") + reach).alias("place"), F.col("to").alias("id"))
        walk = saved(walk.union(later))
        twice = jump.select("id", F.col("to").alias("mid")).join(jump.select(F.col("id").alias("mid"), "to"), "mid").select("id", "to")
        reach, jump = 2 * reach, saved(twice)
    # The walk goes round: a node's second place is the first one and the length of the cycle.
    first = walk.groupBy("id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    start = first.where("n > 1").agg(F.min("first")).first()[0]
    round_ = walk.join(first.where(F.col("first") == start).select("id"), "id", "left_semi").orderBy("place").limit(2).collect()
    end = round_[1].place
    return walk.where(F.col("place").between(start, end)).select((F.col("place") - start).alias("place"), "id")


def first_cycle(nodes: DataFrame, edges: DataFrame) -> list[str] | None:
    """``first_cycle_path`` as a list, for a message; none in an acyclic graph."""
    return [r.id for r in first_cycle_path(nodes, edges).orderBy("place").collect()] or None
