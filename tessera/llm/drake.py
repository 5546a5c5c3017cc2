"""k-means over integer vectors with Drake's adaptive bounds.

A vector carries an upper bound of the distance to its centroid, lower bounds
of those to its next few nearest centroids, and one lower bound for all the
rest.  After a round the bounds move by how far the centroids did.  A vector
whose upper bound stays below all lower ones is certified to stay where it is.
Else its distances are computed exactly: to its own centroid, then to one
listed centroid after another until the nearest found lies below the bounds of
all that is left, and to every centroid only where the rest's bound cannot be
beaten.  Bounds are kept away from rounding errors and certify only what is
strictly nearer, so that results are exact, ties included.

A round is one pass: each task moves bounds, assigns, and adds one row for each
cluster with the sums of its vectors to the round's table.  Sums are gathered
from these rows, at most k for each task, and the driver gets k of them.  No
vector is shuffled, so that repeated vectors make no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, ArrayType, StructField, StructType

from .storage import drop_columns_clashing, scope, written

#: Components are integers below this in size, so that squared distances fit a long.
LARGEST = 1 << 27
#: Below this products and sums of 64-bit floats are exact.
_EXACT = 1 << 21
#: Relative slack of bounds against rounding.
_SLACK = 1e-12
_STATE = [("_v", BinaryType()), ("_near", BinaryType()), ("_bounds", BinaryType()), ("_cluster", IntegerType()), ("_distance", LongType()), ("_sums", ArrayType(LongType()))]


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c`` (integers)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(1, x.shape[1]) ** 0.5 < _EXACT * 8:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Bounds:
    """Nearest centroids and bounds of some vectors: column 0 is a vector's own centroid and its upper bound; the last bound is that of the rest."""

    def __init__(self, near: np.ndarray, bounds: np.ndarray):
        self.near, self.bounds = near, bounds
        #: Distances computed, and vectors compared with every centroid.
        self.asked = self.rescanned = 0

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, listed: int) -> Bounds:
        """From all distances; of equal ones the centroid with the smaller number is nearer."""
        exact = squared_distances(x, c)
        order = np.argsort(exact, axis=1, kind="stable")[:, : listed + 2]
        far = np.sqrt(np.take_along_axis(exact, order, 1).astype(np.float64))
        bounds = np.full((len(x), listed + 2), np.inf)
        bounds[:, : far.shape[1]] = far * (1 - _SLACK)
        bounds[:, 0] = far[:, 0] * (1 + _SLACK)
        out = cls(order[:, : listed + 1].astype(np.int32), bounds)
        out.asked, out.rescanned = exact.size, len(x)
        return out

    def moved(self, shift: np.ndarray) -> None:
        """Let each centroid have moved by up to ``shift``."""
        by = np.column_stack([shift[self.near], np.full(len(self.near), shift.max())])
        self.bounds[:, 1:] -= by[:, 1:] + _SLACK * (np.abs(self.bounds[:, 1:], where=np.isfinite(self.bounds[:, 1:]), out=np.zeros_like(by[:, 1:])) + by[:, 1:])
        self.bounds[:, 0] = (self.bounds[:, 0] + by[:, 0]) * (1 + _SLACK)

    def assign(self, x: np.ndarray, c: np.ndarray) -> None:
        """Make column 0 the nearest centroid of each vector."""
        todo = np.flatnonzero(self.bounds[:, 0] >= self.bounds[:, 1:].min(1))
        listed = self.near.shape[1] - 1
        exact = np.full((len(todo), listed + 1), -1, np.int64)
        for z in range(listed + 1):
            if not len(todo):
                break
            open_ = np.flatnonzero(todo >= 0)
            rows = todo[open_]
            exact[open_, z] = ((x[rows] - c[self.near[rows, z]]) ** 2).sum(1)
            self.asked += len(rows)
            best = np.sqrt(np.where(exact[open_, : z + 1] < 0, np.iinfo(np.int64).max, exact[open_, : z + 1]).min(1).astype(np.float64)) * (1 + _SLACK)
            sure = best < self.bounds[rows, z + 1 :].min(1)
            self._sorted(rows[sure], exact[open_[sure]])
            todo[open_[sure]] = -1
        if len(left := todo[todo >= 0]):
            new = Bounds.scanned(x[left], c, listed)
            self.near[left], self.bounds[left] = new.near, new.bounds
            self.asked, self.rescanned = self.asked + new.asked, self.rescanned + len(left)

    def _sorted(self, rows: np.ndarray, exact: np.ndarray) -> None:
        """Take the computed distances (others are -1) as bounds, and list the centroids by them; of equal ones the smaller number first."""
        known = exact >= 0
        low = np.where(known, np.sqrt(np.where(known, exact, 0).astype(np.float64)) * (1 - _SLACK), self.bounds[rows, :-1])
        near = self.near[rows]
        # The own centroid is the exact nearest; the others follow by their bounds.
        key = np.where(known, exact, np.iinfo(np.int64).max)
        least = key.min(1)
        own = np.where(key == least[:, None], near, np.iinfo(np.int32).max).min(1)
        low[near == own[:, None]] = -np.inf
        order = np.argsort(low, axis=1, kind="stable")
        self.near[rows] = np.take_along_axis(near, order, 1)
        self.bounds[rows, :-1] = np.take_along_axis(low, order, 1)
        self.bounds[rows, 0] = np.sqrt(least.astype(np.float64)) * (1 + _SLACK)


def _binary(a: np.ndarray) -> pa.Array:
    """The rows of an array as bytes."""
    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize * a.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(a)]).cast(pa.binary()) if width else pa.array([b""] * len(a), pa.binary())


def _rows_of(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _summed(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int, into: np.ndarray) -> None:
    """Add sums of components, counts and distances by cluster to ``into``."""
    order = np.argsort(cluster, kind="stable")
    there, first = np.unique(cluster[order], return_index=True)
    into[there, :-4] += np.add.reduceat(x[order], first, axis=0)
    into[there, -4] += np.diff(np.append(first, len(order)))
    into[there, -3] += np.add.reduceat(distance[order], first)


def _round(now: DataFrame, own: int, c: np.ndarray, shift: np.ndarray | None, listed: int) -> DataFrame:
    """A round's table: the vectors with their new state, and rows of sums (components, count, distances, distances computed, rescans)."""
    k, dims = c.shape
    width = min(listed, k - 1) + 1
    schema = StructType([*now.schema.fields[:own], *(StructField(n, t) for n, t in _STATE)])
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passed = np.zeros((k, dims + 4), np.int64), None
        for batch in batches:
            passed = passed or [batch.schema.field(i) for i in range(own)]
            if not batch.num_rows:
                continue
            x = _rows_of(batch.column(own), "<i4", dims).astype(np.int64)
            if shift is None:
                state = Bounds.scanned(x, c, width - 1)
            else:
                state = Bounds(_rows_of(batch.column(own + 1), "<i4", width).copy(), _rows_of(batch.column(own + 2), "<f8", width + 1).copy())
                state.moved(shift)
                state.assign(x, c)
            cluster = state.near[:, 0]
            distance = ((x - c[cluster]) ** 2).sum(1)
            _summed(x, cluster, distance, k, total)
            total[0, -2] += state.asked
            total[0, -1] += state.rescanned
            more = [batch.column(own), _binary(state.near), _binary(state.bounds), pa.array(cluster, pa.int32()), pa.array(distance), pa.nulls(len(x), kinds[5])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *more], names=schema.names)
        some = np.flatnonzero(total[:, -4])
        if len(some):
            sums = [pa.nulls(len(some), kinds[i]) for i in range(3)] + [pa.array(some, pa.int32()), pa.nulls(len(some), kinds[4]), pa.array(list(total[some]), kinds[5])]
            if not total[0, -4]:  # what task rows count goes with any cluster
                sums[5] = pa.array([*([*total[some[0], :-2], *total[0, -2:]],), *total[some[1:]]], kinds[5])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), f.type) for f in passed), *sums], names=schema.names)

    return now.select(*now.columns[:own], *[n for n, _ in _STATE if n in now.columns and n in ("_v", "_near", "_bounds")]).mapInArrow(run, schema)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", listed: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None, log: list[dict] | None = None) -> DataFrame:
    """Vectors with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors with ``dims`` components, none null or not finite, are kept; others
    give no row.  A component x counts as floor(scale * x); one of 2**27 or
    more in size is an error, as distances would not fit.  The first centroids
    are the ``k`` vectors with the smallest SHA-256 of ``seed:id`` (a null id
    is written as null; of equal ids the smaller vector comes first), all of
    them if there are fewer.  Each round assigns every vector to the nearest
    centroid, of equal ones that with the smaller number, and moves each
    centroid to the floor of its vectors' mean; one without vectors stays.  A
    last assignment follows.  Repeated rows get equal results; an empty table
    gives an empty one.  ``keep`` names the columns to keep; those with added
    names give way.  ``log`` is given what each assignment has computed.
    """
    spark = vectors.sparkSession
    names = drop_columns_clashing(vectors.select(*keep) if keep else vectors, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").columns
    own = len(names)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(sound).select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").cast("string").alias("_id"), v.alias("_x"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(own + 1).flatten().to_numpy(zero_copy_only=False) * scale)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component times {scale} is not below {LARGEST} in size")
            yield pa.RecordBatch.from_arrays([*batch.columns[: own + 1], _binary(x.astype("<i4").reshape(-1, dims))], names=[*batch.schema.names[: own + 1], "_v"])

    with scope(spark) as made:
        now = written(rows.mapInArrow(whole, StructType([*rows.schema.fields[: own + 1], StructField("_v", BinaryType())])))
        # The order of equal hashes is that of the components: signs turned, the bytes of big-endian integers sort as the integers do.
        start = now.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit("null"))), 256), _sortable("_v", dims)).limit(k).select("_v").collect()
        if not start:
            made.remove()
            return vectors.where("false").select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        c = np.stack([np.frombuffer(r[0], "<i4") for r in start]).astype(np.int64)
        now, shift = now.drop("_id"), None
        for turn in range(rounds + 1):
            table = written(_round(now, own, c, shift, listed))
            made.remove(but=1)
            sums = table.where("_sums is not null").groupBy("_cluster").agg(F.array(*[F.sum(F.get("_sums", F.lit(i))) for i in range(dims + 4)]).alias("s")).collect()  # k rows
            if log is not None:
                log.append({"asked": sum(r.s[-2] for r in sums), "rescanned": sum(r.s[-1] for r in sums), "vectors": sum(r.s[-4] for r in sums)})
            now = table.where("_sums is null")
            if turn < rounds:
                new = c.copy()
                for r in sums:
                    new[r._cluster] = np.array(r.s[:dims], np.int64) // r.s[-4]
                shift, c = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK), new
    inertia = sum(r.s[-3] for r in sums)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    clusters = spark.createDataFrame([(r._cluster, r.s[-3], inertia, digest[r._cluster]) for r in sums], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.join(F.broadcast(clusters), "_cluster").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)], F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _sortable(v: str, dims: int):
    """Hexadecimal digits of the vectors' components, ordered as the components are."""
    digit = lambda i, b: F.substring(v, 4 * i + b + 1, 1)
    top = lambda i: F.lpad(F.hex((F.conv(F.hex(digit(i, 3)), 16, 10).cast("int") + 128) % 256), 2, "0")
    return F.concat(*[F.concat(top(i), F.hex(digit(i, 2)), F.hex(digit(i, 1)), F.hex(digit(i, 0))) for i in range(dims)])


def oracle_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """DuckDB SQL with all distances in every round."""
    out = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
e AS MATERIALIZED (SELECT r, unnest(range(1, {dims + 1})) AS i, unnest(x) AS x FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), x) - 1 AS c, r FROM v QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN e USING (r))"""]
    for t in range(rounds + 1):
        out.append(f"""a{t} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.r, k.c, sum((e.x - k.x) * (e.x - k.x)) AS d FROM e JOIN c{t} k USING (i) GROUP BY e.r, k.c) GROUP BY r)""")
        if t < rounds:
            out.append(f"""m{t} AS (SELECT c, i, sum(e.x) AS s, count(*) AS n FROM a{t} JOIN e USING (r) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), k.x) AS x FROM c{t} k LEFT JOIN m{t} m ON k.c = m.c AND k.i = m.i)""")
    return "WITH " + ",\n".join(out) + f""",
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN h ON h.c = a.c
"""
