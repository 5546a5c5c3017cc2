"""The inverted index against the search that reads every text."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, textindex
from tessera.operators.graph import shared_path

ROWS = "id string, text string, extra string"
WORDS = ["mapa", "map", "skup", "skupovi", "čvor", "cvor", "ab", "a", "x1", "grupa", "podgrupa"]
QUERIES = ["map  skup", "map map", "Čvor ab", "podgrupa mapa x1", "a b", "zzz", "!!!!", "up, ma"]


def texts(seed, n):
    rng = random.Random(seed)
    rows = [(f"t{seed}-{k:04d}", rng.choice([" ", "  ", ", ", "-", "\n"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), "e") for k in range(n)]
    rows += [(f"t{seed}-same", "map skup", None)] * 2 + [(f"t{seed}-null", None, "e"), (f"t{seed}-empty", "", "e"), (f"t{seed}-long", "mapa " * 30_000 + "!!!!", "e"), (None, "map skup", "e")]
    return rows


@pytest.fixture(scope="module")
def both(spark):
    """Two segments of items, in an index with blocks of a few documents, and all items."""
    folder = shared_path(spark, "index")
    parts = [spark.createDataFrame(texts(seed, 150), ROWS).repartition(3) for seed in (1, 2)]
    for part in parts:
        textindex.add(part, folder, block_bits=3)
    yield textindex.TextIndex(spark, folder), parts[0].union(parts[1]).cache(), folder


def full(items, query):
    return search.lexical_search(items, query).where("lexical > 0").select("id", "lexical")


def listed(df):
    return sorted(((r.id or "", r.lexical) for r in df.collect()), key=str)


@pytest.mark.parametrize("query", QUERIES)
def test_scores(both, query):
    index, items, _ = both
    assert listed(index.scores(query)) == listed(full(items, query))


@pytest.mark.parametrize("query, k", [("map skup", 1), ("map map", 9), ("Čvor ab", 9), ("zzz", 9), ("!!!!", 9)])
def test_top(both, query, k):
    index, items, _ = both
    want = full(items, query).orderBy(F.desc("lexical"), "id").limit(k)
    assert [tuple(r) for r in index.top(query, k).collect()] == [tuple(r) for r in want.collect()]


def test_bounds_hold_and_leave_blocks_out(spark):
    """No document has more points than its block's bound, and a rare word rules most blocks out."""
    folder = shared_path(spark, "index")
    rows = [(str(k), "common word" + (" rare" if k == 7000 else ""), "") for k in range(8000)]
    textindex.add(spark.createDataFrame(rows, ROWS).repartition(2), folder)
    index = textindex.TextIndex(spark, folder)
    bounds = {r.block: r.bound for r in index.bounds("common rare", index.matched("common rare")).collect()}
    assert len(bounds) == 8 and sorted(bounds.values()) == [3] * 7 + [11]
    assert [tuple(r) for r in index.top("common rare", 1).collect()] == [("7000", 6)]


def test_only_buckets_of_the_words_are_read(both):
    index, _, _ = both
    plan = index._hits(index.matched("podgrupa"))._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    assert "bucket" in part[: part.index("]")] and index.matched("podgrupa").select("bucket").distinct().count() == 1


def test_unlisted_segments_are_not_read(both, spark):
    """Tables of an addition that died before its end change nothing, and an empty addition neither."""
    index, items, folder = both
    items.limit(5).select(F.lit(0).alias("span"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("slot"), "id", F.lit("map skup").alias("folded")).write.partitionBy("span").parquet(f"{folder}/documents/segment=dead")
    textindex.add(items.limit(0), folder)
    again = textindex.TextIndex(spark, folder)
    assert len(again.segments) == 2 and listed(again.scores("map skup")) == listed(full(items, "map skup"))
    alone = shared_path(spark, "index")
    textindex.add(items.limit(0), alone)
    assert textindex.TextIndex(spark, alone).top("map", 3).count() == 0
    textindex.add(spark.createDataFrame([("x", "", ""), ("y", "?!?!", "")], ROWS), alone)
    assert listed(textindex.TextIndex(spark, alone).scores("map")) == [] and listed(textindex.TextIndex(spark, alone).scores("?!?!")) == [("y", 5)]
