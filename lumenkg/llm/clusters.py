"""Centroid clustering of integer vectors: nearest centroids by blocked float64 BLAS, exact.

A vector's components become the integers floor(scale * x).  In every round each task
turns its Arrow batches into blocks and takes all distances of a block from one matrix
product, |x|^2 - 2 x.c + |c|^2.  That is exact as long as no partial sum leaves the
integers that float64 holds: where dim * (max|x| + max|c|)^2 < 2^53 every summand and every
sum of summands does not, in whatever order BLAS adds.  Rows beyond the bound take the
same expansion in Python integers of any size, row by row.  A task returns one row, the sums and
counts of its vectors per centroid, and RDD treeAggregate adds these up, so the driver holds k
sums at any size of input.  Averages are floors of exact quotients.

Cases: vectors of another length, null, or with a null or non-finite component take no
part and have no row; with fewer than k vectors there are fewer centroids; a null id
takes part and can start no centroid; rows that repeat an id are vectors of their own,
and of those with one hash the smaller vector starts the earlier centroid; of centroids
at one distance the smaller number wins; empty centroids stay where they are; no vectors give an empty result; components of any
finite size are exact; a distance or inertia of 2^63 and more is null in the long
columns, its assignment exact nevertheless.  Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table

EXACT = 2**53
LONG = 2**63


@dataclass(frozen=True)
class ClusterRules:
    k: int = 8
    dim: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: int = 3
    #: Rows of one matrix product.
    block_rows: int = 4096


def kept_vectors(rows: DataFrame, rules: ClusterRules, vector: str, key: str) -> DataFrame:
    """(id, v): the vectors of the asked length with finite components only, as doubles."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return named.filter(F.coalesce((F.size(v) == rules.dim) & F.forall(v, finite), F.lit(False)))


def starts(vectors: DataFrame, rules: ClusterRules) -> list[list[int]]:
    """The k vectors whose salted ids have the smallest hashes, k rows at most."""
    digest = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.filter("id IS NOT NULL").select(digest.alias("h"), "v").orderBy("h", "v").limit(rules.k).collect()
    return [[_whole(x, rules.scale) for x in r.v] for r in rows]


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for any finite x: a ratio of integers is never rounded."""
    a, b = float(x).as_integer_ratio()
    return a * scale // b


class Centroids:
    """Centroids as exact integers, with the float64 form and the bound up to which it is exact."""

    def __init__(self, values: list[list[int]], rules: ClusterRules):
        self.values, self.rules = values, rules
        self.top = max((abs(c) for v in values for c in v), default=0)
        #: Largest |x| for which the expansion is exact in float64, -1 if none is.
        self.reach = math.isqrt((EXACT - 1) // rules.dim) - self.top
        self.matrix = np.array(values, np.float64) if self.reach >= 0 else None

    def nearest(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | list]]:
        """(row numbers, their centroids, squared distances, integer vectors), a float64 part and an exact part of each block."""
        scale = self.rules.scale
        for at in range(0, len(x), self.rules.block_rows):
            block = x[at : at + self.rules.block_rows]
            near = np.abs(block).max(axis=1) <= (self.reach - 1) / scale
            if near.any():
                ints = np.floor(block[near] * scale)
                d = (ints * ints).sum(axis=1)[:, None] - 2.0 * (ints @ self.matrix.T) + (self.matrix * self.matrix).sum(axis=1)
                best = d.argmin(axis=1)
                yield at + np.flatnonzero(near), best, d[np.arange(len(d)), best].astype(np.int64), ints.astype(np.int64)
            if not near.all():
                wide = [[_whole(c, scale) for c in v] for v in block[~near]]
                scored = [min((self._exact(v, c), j) for j, c in enumerate(self.values)) for v in wide]
                yield at + np.flatnonzero(~near), np.array([j for _, j in scored]), np.array([d for d, _ in scored], object), wide

    def _exact(self, v: list[int], c: list[int]) -> int:
        return sum(a * a for a in v) - 2 * sum(a * b for a, b in zip(v, c)) + sum(b * b for b in c)

    def moved(self, total: list) -> Centroids:
        """Centroids at the floors of the averages; those without vectors stay."""
        sums, counts = total[0], total[1]
        return Centroids([[s // n for s in sums[j]] if (n := counts[j]) else v for j, v in enumerate(self.values)], self.rules)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _empty(k: int, dim: int) -> list:
    return [[[0] * dim for _ in range(k)], [0] * k, [0] * k]


def _added(a: list, b: list) -> list:
    """Sums, counts and distances of two parts, in integers of any size."""
    return [[[x + y for x, y in zip(u, v)] for u, v in zip(a[0], b[0])], [x + y for x, y in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]]


def totals(vectors: DataFrame, centroids: Centroids) -> list:
    """Per centroid the sum, the count and the summed distances of its vectors: one row a task, added by treeAggregate."""
    shared, k, dim = centroids, len(centroids.values), centroids.rules.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _empty(k, dim)
        for batch in batches:
            for _, best, distance, ints in shared.nearest(_matrix(batch.column(0), dim)) if batch.num_rows else ():
                part = _empty(k, dim)
                if isinstance(ints, np.ndarray):  # far below 2^63: a block of 4096 rows under 2^27
                    for j in range(k):
                        rows = best == j
                        part[0][j], part[1][j], part[2][j] = ints[rows].sum(axis=0).tolist(), int(rows.sum()), sum(distance[rows].tolist())
                else:
                    for j, d, v in zip(best.tolist(), distance, ints):
                        part[0][j], part[1][j], part[2][j] = [a + b for a, b in zip(part[0][j], v)], part[1][j] + 1, part[2][j] + d
                total = _added(total, part)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    parts = vectors.select("v").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeAggregate(_empty(k, dim), _added, _added)


def fit(vectors: DataFrame, rules: ClusterRules) -> Centroids:
    """Centroids after rules.rounds rounds over all vectors (id, v)."""
    centroids = Centroids(starts(vectors, rules), rules)
    for _ in range(rules.rounds if centroids.values else 0):
        centroids = centroids.moved(totals(vectors, centroids))
    return centroids


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance) of every vector (id, v)."""
    shared = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for at, best, d, _ in shared.nearest(_matrix(batch.column(1), shared.rules.dim)) if batch.num_rows else ():
                cluster[at], distance[at] = best, d
            longs = pa.array([int(d) if d < LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), longs], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long")


def clustered(spark: SparkSession, rows: DataFrame, rules: ClusterRules = ClusterRules(), vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Centroids, list[int]]:
    """Assignments of all vectors (id, cluster, distance), the fitted centroids, and each centroid's inertia."""
    prepare(spark)
    vectors = checkpointed(kept_vectors(rows, rules, vector, key))
    centroids = fit(vectors, rules)
    return assigned(vectors, centroids), centroids, totals(vectors, centroids)[2] if centroids.values else []


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids, inertia = clustered(spark, table(spark, sf_dir, "embeddings"))
    long = lambda x: F.lit(x if x < LONG else None).cast("long")
    of = lambda values, kind: F.get(F.array(*values).cast(f"array<{kind}>"), F.col("cluster"))
    digests = [F.lit(hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for v in centroids.values]
    return out.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of([long(x) for x in inertia], "bigint").alias("cluster_inertia"),
        long(sum(inertia)).alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def cluster_sql(rules: ClusterRules = ClusterRules()) -> str:
    """The same rounds for an engine with lists and exact integers: one pair of tables a round."""
    floor = "(s - ((s % n) + n) % n) // n"
    near = "SELECT id, v, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q"
    parts = [
        f"""WITH q AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({rules.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {rules.dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {rules.dim}),
x AS MATERIALIZED ({near}),
c0 AS MATERIALIZED (SELECT j, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM
  (SELECT row_number() OVER (ORDER BY sha256(concat('{rules.seed}:', vec_id)), v) - 1 AS j, v FROM q WHERE vec_id IS NOT NULL) WHERE j < {rules.k})"""
    ]
    for r in range(rules.rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT id, min(struct_pack(d := d, j := j)) AS b FROM
  (SELECT id, j, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY id, j) GROUP BY id)""")
        if r < rules.rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.j, c.i, coalesce({floor}, c.y)::BIGINT AS y FROM c{r} c LEFT JOIN
  (SELECT b.j AS j, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (id) GROUP BY b.j, i) m USING (j, i))""")
    last = rules.rounds
    return ",\n".join(parts) + f""",
h AS (SELECT j, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY j)
SELECT vec_id, b.j::INTEGER AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.j)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{last} JOIN q USING (id) JOIN h ON h.j = b.j
"""


OP12_SQL = cluster_sql()
