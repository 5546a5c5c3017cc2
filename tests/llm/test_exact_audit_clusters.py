"""Exact duplicates, filter interactions and centroid clusters against brute force and odd input."""

import hashlib
import os
import random
import re
import threading
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query over some tables, after comparing them with its SQL in DuckDB."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = Q.QUERIES[name](spark, str(folder))
    want = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert Counter(rows) == Counter(want.fetchall())
    return got.select(*names).collect()


# Exact duplicates

@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=300), st.integers(0, 45))
def test_golomb_round_trip(values, bits):
    from tessera.llm.exact import divisor_bits, golomb_decoded, golomb_encoded

    numbers = np.array(sorted(values), np.int64)
    fit = divisor_bits(2**40 + 1, len(numbers))
    for b in {fit, max(bits, fit)}:
        assert (golomb_decoded(golomb_encoded(numbers, b), len(numbers), b) == numbers).all()


def test_golomb_is_near_the_entropy():
    from tessera.llm.exact import divisor_bits, golomb_encoded

    rng = np.random.default_rng(3)
    numbers = np.unique(rng.integers(0, 2**40, 20_000))
    code = golomb_encoded(numbers, divisor_bits(2**40, len(numbers)))
    entropy = len(numbers) * (np.log2(2**40 / len(numbers)) + np.log2(np.e))
    assert 8 * len(code) < 1.03 * entropy


def test_exact_odd_rows(spark, tmp_path):
    long = "long  text " * 60_000
    rows = [
        (5, None, "a"), (6, "", "a"), (7, " ", "a"), (8, "\t\n", None), (None, "x y", "a"), (3, "x  y", "a"), (3, "x\ty", "b"), (3, "x y", "b"), (9, "x y ", "a"), (None, "null ids", "a"), (None, "null ids", "a"),
        (11, long, "a"), (12, long.replace("  ", "\n"), "a"), (13, long + "!", "a"), (-4, "ünï  cödé", "a"), (14, "ünï\x0bcödé", "a"), (15, "no break", "a"), (16, "no break", "a"),
    ]
    docs = documents(spark, rows)
    got = same_as_sql(spark, tmp_path, "op11_exact_dedup", documents=docs.repartition(5))
    assert Counter(r.kept for r in got)[True] == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows})
    assert [(r.keep_id, r.group_size) for r in got if r.doc_id == 12] == [(11, 2)]
    from tessera.llm.exact import exact_duplicates

    assert exact_duplicates(docs.limit(0)).count() == 0
    clash = docs.withColumn("Kept", F.lit("x")).withColumn("n", F.lit(1)).withColumn("sha", F.lit(2)).withColumn("row", F.lit(3)).withColumn("text_sha256", F.lit(4)).withColumn("a.b", F.lit(5))
    out = exact_duplicates(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "sha", "row", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter((r.doc_id, r.keep_id, r.kept) for r in out.collect()) == Counter((r.doc_id, r.keep_id, r.kept) for r in got)
    left = exact_duplicates(clash, only_kept=True)
    assert left.columns == clash.columns and Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_exact_by_blocks_and_shuffled_classes(spark, tmp_path, monkeypatch):
    """Many senders and owners, bitmaps in blocks, classes joined by shuffle but for hot ones: the same rows."""
    from tessera.llm import exact, joins

    for module, name, value in ((exact, "SENDER_ROWS", 40), (exact, "OWNER_LEAST", 50), (exact, "OWNER_MOST", 60), (exact, "MORE_BITS", -4), (joins, "BROADCAST_KEYS", 3), (joins, "LEAST_HOT", 100)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(exact, "joined_with_hot", lambda *a: joins.joined_with_hot(*a, broadcast_keys=3))
    monkeypatch.setattr(exact._only_suspects, "__defaults__", (64,))
    rng = random.Random(5)
    rows = [(i, "hot  copy" if i % 3 == 0 else f"text {rng.randrange(900)}", "s") for i in range(1_500)]
    rng.shuffle(rows)
    got = same_as_sql(spark, tmp_path, "op11_exact_dedup", documents=documents(spark, rows).repartition(9))
    assert max(r.group_size for r in got) == 500


# Filters

def brute_audit(rows, labels):
    """Every order run over every document."""
    least = {}
    for i, t, _ in rows:
        key = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", key), key)
    said = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            said[i][0] |= quality == 1
            said[i][1] |= toxic == 1
    docs = []
    for i, t, s in rows:
        x = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), bool(re.search("[#$%&*|]", x)), (i is None, i or 0) > least[x]]
        docs.append((s or "", "".join(c for c, f in zip("ABCDE", fails, strict=True) if f), *(said[i] if i is not None else (False, False))))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                here = [d for d in own if c in d[1]]
                removed = [d for d in here if not set(d[1]) & set(order[: step - 1])]
                kept = [d for d in own if not set(d[1]) & set(order[:step])]
                shares[part, c] += len(removed)
                out[part, order, step] = [len(kept), len(removed), len(here) - len(removed), sum(d[1] == c for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)]
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    make = lambda: " ".join(rng.choice(["word", "Word", "WORD", "w#d", f"w{rng.randrange(500)}"]) if rng.random() < 0.3 else f"v{rng.randrange(2000)}" for _ in range(rng.choice([3, 199, 200, 260])))
    texts = [None, "", "A", "# " * 300, "one " * 250, "Ünï " * 210, "very long " * 40_000, *(make() for _ in range(60))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b", "ß"])) for _ in range(400)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 1), (4, 1, 1), *((i, 1, i % 2) for i in range(5, 30))]
    got = same_as_sql(spark, tmp_path, "op12_filter_interactions", documents=documents(spark, rows).repartition(5), labels=spark.createDataFrame(labels, LABELS))
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_other_numbers_of_filters(spark):
    from tessera.llm.audit import audit_filters

    rng = random.Random(2)
    for names in ("A", "XYZ"):
        flags = [(rng.choice("pq"), rng.randrange(1 << len(names)), rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)]
        got = audit_filters(spark.createDataFrame(flags, "part string, fails int, good boolean, toxic boolean"), names).collect()
        for r in got:
            bit = lambda c: 1 << names.index(c)  # noqa: E731, B023
            before = sum(map(bit, r.filter_order[: r.step - 1]))
            own = [f for f in flags if f[0] == r.part]
            removed = [f for f in own if f[1] & bit(r.filter_order[r.step - 1]) and not f[1] & before]
            assert (r.removed, r.good_lost, r.toxic_lost) == (len(removed), sum(f[2] for f in removed), sum(f[3] for f in removed))
            assert r.shapley == sum(x.removed for x in got if x.part == r.part and x.filter_order[x.step - 1] == r.filter_order[r.step - 1])
    assert audit_filters(spark.createDataFrame([], "part string, fails int, good boolean, toxic boolean")).count() == 0


# Clusters

def lloyd(x, start, rounds):
    """Plain rounds over all distances, with Python integers."""
    c = [list(map(int, v)) for v in start]
    for turn in range(rounds + 1):
        exact = [[sum((a - b) ** 2 for a, b in zip(v, o, strict=True)) for o in c] for v in x]
        at = [min(range(len(c)), key=lambda j: (d[j], j)) for d in exact]  # noqa: B023
        if turn < rounds:
            for j in range(len(c)):
                own = [v for v, a in zip(x, at, strict=True) if a == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return at, [d[a] for d, a in zip(exact, at, strict=True)], c


@pytest.mark.parametrize("spread", [3, 40, 1 << 20, (1 << 27) - 1])
def test_bounds_equal_plain_rounds(spread):
    """Ties, equal vectors, far components: the same assignment as by all distances, with fewer computed."""
    from tessera.llm.drake import Bounds, squared_distances

    rng = np.random.default_rng(spread)
    middles = rng.integers(-spread, spread + 1, (9, 5))
    x = np.clip(middles[rng.integers(0, 9, 400)] + rng.integers(-2, 3, (400, 5)), -spread, spread)
    x[50:120] = x[3]
    start = x[rng.permutation(400)[:12]]
    at, far, _ = lloyd(x.tolist(), start.tolist(), 6)
    for listed in (1, 3, 11):
        c = start.astype(np.int64)
        state = Bounds.scanned(x, c, listed)
        for _ in range(6):
            own = state.near[:, 0]
            new = np.stack([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(12)])
            state.moved(np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + 1e-12))
            c = new
            state.assign(x, c)
        assert state.near[:, 0].tolist() == at
        assert squared_distances(x, c)[np.arange(400), at].tolist() == far
        assert (np.sort(state.near, axis=1)[:, 1:] > np.sort(state.near, axis=1)[:, :-1]).all()


def test_clusters_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(60)]
    rows = [(i, [v + rng.gauss(0, 0.05) for v in base[i % 60]], 0) for i in range(240)]
    rows += [(1000, None, 1), (1001, [0.5] * 63, 1), (1002, [0.5] * 65, 1), (1003, [None, *[0.5] * 63], 1), (1004, [float("nan"), *[0.5] * 63], 1), (1005, [float("-inf"), *[0.5] * 63], 1), (1006, [], 1), (None, base[0], None), (None, base[1], None), (7, base[2], 0), (7, base[2], 0)]
    rows += [(2000 + i, base[5], 0) for i in range(120)]
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = same_as_sql(spark, tmp_path, "op13_centroid_clustering", embeddings=table)
    assert len(got) == 240 + 4 + 120
    from tessera.llm.drake import cluster_vectors

    out = cluster_vectors(table.withColumn("Cluster", F.lit("x")).withColumn("_v", F.lit(1)).withColumn("_id", F.lit(2)))
    assert out.columns == ["vec_id", "embedding", "label", "_v", "_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter((r.vec_id, r.cluster, r.distance) for r in out.collect()) == Counter((r.vec_id, r.cluster, r.distance) for r in got)
    log = []  # without the many equal vectors, whose centroids tie for ever
    cluster_vectors(table.where("vec_id < 2000"), log=log).collect()
    assert len(log) == 6 and log[0]["asked"] == 242 * 40 and sum(x["asked"] for x in log[2:]) < 4 * 242 * 40 / 5
    for some in (table.limit(0), table.where("vec_id = 1001")):
        assert cluster_vectors(some).count() == 0
    few = cluster_vectors(table.where("vec_id < 3"), keep=["vec_id"]).collect()
    assert len({r.cluster for r in few}) == 3 and all(r.distance == 0 and r.inertia == 0 for r in few)
    with pytest.raises(Exception, match="not below"):
        cluster_vectors(spark.createDataFrame([(1, [1e7] * 64, 0)], VECTORS)).collect()


def test_clusters_of_the_table(spark, sf):
    rows = Q.op13_centroid_clustering(spark, sf).collect()
    kept = {r.vec_id: [int(np.floor(256 * float(x))) for x in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    start = sorted(kept, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:40]
    ids = sorted(kept)
    at, far, c = lloyd([kept[i] for i in ids], [kept[i] for i in start], 5)
    assert {r.vec_id: (r.cluster, r.distance, r.inertia) for r in rows} == {i: (a, d, sum(far)) for i, a, d in zip(ids, at, far, strict=True)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in rows)


# Scopes

def test_scopes_of_two_threads(spark, tmp_path):
    """A scope removes its own tables only, and nothing stays after it."""
    from tessera.llm.storage import scope, written

    wait, failed = threading.Barrier(2, timeout=60), []

    def work(n):
        try:
            with scope(spark) as made:
                mine = written(spark.range(n))
                wait.wait()
                with scope(spark) as inner:
                    written(spark.range(1))
                    last = written(spark.range(n + 1))
                    inner.remove(but=1)
                wait.wait()
                assert (mine.count(), last.count(), len(made.paths)) == (n, n + 1, 2)
                paths = [p.removeprefix("file:") for p in made.paths]
                made.remove()
                assert not any(os.path.exists(p) for p in paths)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (3, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
