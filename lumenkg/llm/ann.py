"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then assigned to a leaf.  A query
walks the tree with a priority queue ordered by its inner product with the centres, twice:

1. It visits leaves in that order until they hold first_rows vectors, and scores those;
   the k-th best score is its floor.
2. It widens: every node whose centre, plus margin times the query's norm times the spread
   of the node, still lies above the floor is opened, and all leaves reached are visited.
   The margin is calibrated: for a bounded set of queries the exact neighbours are found by
   a scan of all vectors in blocks, and the margin is the least that reaches target_recall
   of them.  So a query in a dense or an unclear place visits more leaves than others; one
   that has fewer than k scores has no floor and visits all leaves.

Leaves are scored in blocks of bounded size: neighbouring small leaves share a block, a
leaf with a third of all vectors becomes many, which every query that visits the leaf
meets one by one, so nothing is dropped; what lies below a query's floor stays there.  A block that more than block_queries queries
visit is copied once for each so many of them; others are sent to one task once.

Cases: vectors that are null, empty, zero, of another length than most, or that hold null,
NaN or infinite components are no queries and no candidates; equal scores go to the
smaller id; with fewer candidates than k, all are returned; a row that repeats an id is a
candidate of its own, except for queries of that id; rows with a null id take no part;
products that overflow rank as infinite, or last if they are not numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table


@dataclass(frozen=True)
class TreeRules:
    k: int = 20
    #: Bounds of the vectors that the tree is fitted on: a twentieth of all, between these; and queries that calibrate it.
    sample_rows: int = 20_000
    most_sample_rows: int = 200_000
    calibration_queries: int = 150
    branching: int = 6
    leaf_rows: int = 256
    #: Vectors that the first walk of a query holds at least.
    first_rows: int = 512
    target_recall: float = 0.97
    block_rows: int = 4_096
    block_queries: int = 1_024


@dataclass
class Tree:
    """Nodes in breadth-first order: children[i] are the node numbers below node i, leaves have none."""

    centres: np.ndarray
    spread: np.ndarray  # root mean square distance of a node's sample vectors from its centre
    children: list[list[int]]
    leaf_of: list[int]  # number of a leaf, -1 for inner nodes
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = [i for i in np.unique(node) if self.children[i]]
            if not open_:
                return np.array(self.leaf_of)[node]
            for i in open_:
                at, below = np.flatnonzero(node == i), np.array(self.children[i])
                c = self.centres[below]
                node[at] = below[((c * c).sum(axis=1) - 2 * x[at] @ c.T).argmin(axis=1)]

    def walk(self, q: np.ndarray, rows: list[int], least: int, floor: float = -math.inf, margin: float | None = None) -> list[int]:
        """Leaves of a best-bin-first walk: until they hold least rows or, with a margin, all whose nodes may hold a score above floor."""
        near = self.centres @ q
        if margin is not None:
            near = near + margin * float(np.sqrt(q @ q)) * self.spread
        queue, out, held = [(-math.inf, 0)], [], 0
        while queue and (margin is not None or held < least):
            key, i = heapq.heappop(queue)
            if margin is not None and i and -key <= floor:
                break  # all that is left lies below
            if not self.children[i]:
                out.append(self.leaf_of[i])
                held += rows[self.leaf_of[i]]
            for c in self.children[i]:
                heapq.heappush(queue, (-float(near[c]), c))
        return out

    def paths(self) -> dict[int, list[int]]:
        """The nodes below the root that lead to each leaf."""
        above = {c: i for i, below in enumerate(self.children) for c in below}
        out = {}
        for i, leaf in enumerate(self.leaf_of):
            if leaf >= 0:
                path, at = [], i
                while at:
                    path.append(at)
                    at = above[at]
                out[leaf] = path
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        new = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def fit_tree(sample: np.ndarray, rows: int, rules: TreeRules = TreeRules()) -> Tree:
    """A tree whose leaves hold about leaf_rows of rows vectors, as far as the sample can tell them apart."""
    rng = np.random.default_rng(17)
    least = max(8, round(len(sample) * rules.leaf_rows / max(1, rows)))
    off = lambda x, c: float(np.sqrt(((x - c) ** 2).sum(axis=1).mean()))
    centres, children, level = [sample.mean(axis=0)], [[]], [(0, sample)]
    spread = [off(sample, centres[0])]
    while level:
        after = []
        for node, x in level:
            distinct = len(np.unique(x, axis=0))
            if len(x) <= 2 * least or distinct < 2:
                continue
            c = _kmeans(np.unique(x, axis=0) if distinct < len(x) else x, min(rules.branching, distinct, max(2, len(x) // least)), rng)
            label = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            kept = [j for j in range(len(c)) if (label == j).any()]
            if len(kept) < 2:
                continue
            for j in kept:
                children[node].append(len(centres))
                after.append((len(centres), x[label == j]))
                centres.append(c[j])
                spread.append(off(x[label == j], c[j]))
                children.append([])
        level = after
    number, leaf_of = 0, []
    for c in children:
        leaf_of.append(-1 if c else number)
        number += not c
    return Tree(np.array(centres), np.array(spread), children, leaf_of, number)


def usable_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(v, lambda x: x != 0)
    found = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(fine)
    usual = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found.filter(F.size("v") == (usual[0][0] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, leaf: np.ndarray | None = None, visited: list | None = None, floors: list | None = None) -> tuple[list, list, list]:
    """For each query its k best of x (of its visited leaves, at or above its floor) but itself; scores are summed per pair alike, so equal vectors tie exactly."""
    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    if visited is not None:
        numbers, place = np.unique(leaf[order], return_inverse=True)
        seen = np.zeros((len(q), len(numbers)), bool)
        for i, leaves in enumerate(visited):
            at = np.searchsorted(numbers, leaves)
            at = at[at < len(numbers)]
            seen[i, at[np.isin(numbers[at], leaves)]] = True
    with np.errstate(over="ignore", invalid="ignore"):
        longest = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
        for at in range(0, len(q), 64):
            rough = np.nan_to_num(q[at : at + 64] @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            for i, scores in enumerate(rough):
                own = q[at + i]
                allowed = ids != q_ids[at + i]
                if visited is not None:
                    allowed &= seen[at + i][place]
                open_ = np.flatnonzero(allowed)
                if not len(open_):
                    continue
                scores = scores[open_]
                floor = np.partition(scores, len(scores) - min(k, len(scores)))[len(scores) - min(k, len(scores))]
                slack = 1e-15 * len(own) * float(np.sqrt(own @ own)) * longest  # what rounding can do to a sum of products
                near = open_[scores >= floor - slack] if math.isfinite(slack) and math.isfinite(floor) else open_
                exact = np.nan_to_num((x[near] * own).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                top = np.argsort(-exact, kind="stable")[:k]
                if floors is not None and floors[at + i] is not None:
                    top = top[exact[top] >= floors[at + i]]
                out[0].extend([int(q_ids[at + i])] * len(top))
                out[1].extend(ids[near[top]].tolist())
                out[2].extend(exact[top].tolist())
    return out


FOUND = "query_id long, vec_id long, score double"


def _table(found: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])


def exact_neighbours(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k nearest of a bounded list of queries, by a scan of all vectors in blocks."""
    q_ids, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8_192):
                part = batch.slice(i, 8_192)
                yield _table(best_of(q, q_ids, _matrix(part.column(1)), part.column(0).to_numpy(), k))

    return ranked(vectors.mapInArrow(run, FOUND), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated_margin(tree: Tree, held: DataFrame, rules: TreeRules, queries: DataFrame) -> float:
    """The least margin whose walks reach target_recall of the exact neighbours of some (id, v, floor) queries."""
    some = [(r.id, r.v, r.floor) for r in queries.orderBy(F.xxhash64("id"), "id").limit(rules.calibration_queries).collect()]
    some = [x for x in some if x[2] is not None and math.isfinite(x[2])]
    if not some or tree.leaves < 2:
        return 0.0
    truth = exact_neighbours(held.select("id", "v"), [x[:2] for x in some], rules.k).select("query_id", "vec_id")
    # calibration_queries * k rows at most, but for repeated ids
    leaves = held.select("id", "leaf").join(F.broadcast(truth), F.col("id") == F.col("vec_id")).select("query_id", "leaf").collect()
    path, by = tree.paths(), {i: (np.array(v), floor) for i, v, floor in some}
    needed = []
    for r in leaves:
        q, floor = by[r.query_id]
        at = np.array(path[r.leaf])
        gap = (floor - tree.centres[at] @ q) / (float(np.sqrt(q @ q)) * np.maximum(tree.spread[at], 1e-12))
        needed.append(float(gap.max()))
    needed.sort()
    return max(0.0, needed[min(len(needed) - 1, math.ceil(rules.target_recall * len(needed)))]) * (1 + 1e-9) + 1e-12


def dealt_blocks(counts: list[int], block_rows: int) -> list[tuple[int, int]]:
    """(first block, number of blocks) of each leaf: neighbouring small leaves share a block, a large leaf has blocks of its own."""
    out, block, room = [], -1, 0
    for n in counts:
        own = max(1, -(-n // block_rows))
        if own > 1 or n > room:
            block, room = block + 1, block_rows
        out.append((block, own))
        block, room = block + own - 1, 0 if own > 1 else room - n
    return out


def search(spark: SparkSession, rows: DataFrame, is_query, rules: TreeRules = TreeRules(), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows."""
    prepare(spark)
    vectors = checkpointed(usable_vectors(rows, vector, key))
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = min(rules.most_sample_rows, max(rules.sample_rows, n // 20))
    share = F.pmod(F.xxhash64("id"), F.lit(n)) < most
    sample = _matrix((vectors.filter(share) if n > most else vectors).select("v").limit(most).toArrow().column("v").combine_chunks())
    tree = fit_tree(sample, n, rules)
    shared = spark.sparkContext.broadcast(tree)  # fewer centres than vectors in the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], ["id", "v", "leaf"])

    held = checkpointed(vectors.mapInArrow(assign, "id long, v array<double>, leaf long"))
    counts = [0] * tree.leaves  # as many as leaves, so bounded by the sample
    for r in held.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        counts[r.leaf] = r.n
    blocks = spark.sparkContext.broadcast((dealt_blocks(counts, rules.block_rows), counts))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        first = np.array(blocks.value[0])
        for batch in batches:
            leaf = batch.column(2).to_numpy()
            spread = np.fromiter((xxhash.xxh32_intdigest(b) for b in batch.column(0).to_numpy().astype("<i8").reshape(-1, 1)), np.int64, len(leaf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first[leaf, 0] + spread % first[leaf, 1], pa.int64())], ["id", "v", "leaf", "b"])

    def visitors(queries: DataFrame, margin: float | None) -> DataFrame:
        """(id, v, floor, b, leaves): each query with the blocks that it visits, and its leaves there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, rows_of = blocks.value
            kind = pa.list_(pa.struct([("b", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
            for batch in batches:
                met = []
                floors = [-math.inf if f is None else f for f in batch.column(2).to_pylist()]
                for q, floor in zip(_matrix(batch.column(1)), floors):
                    leaves = shared.value.walk(q, rows_of, rules.first_rows)
                    if margin is not None:
                        seen = set(leaves)
                        leaves = [x for x in shared.value.walk(q, rows_of, 0, floor, margin) if x not in seen]
                    by: dict[int, list[int]] = {}
                    for leaf in leaves:
                        start, own = first[leaf]
                        for b in range(start, start + own) if rows_of[leaf] else ():
                            by.setdefault(b, []).append(leaf)
                    met.append([{"b": b, "leaves": sorted(x)} for b, x in by.items()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, kind)], ["id", "v", "floor", "met"])

        met = queries.select("id", "v", "floor").mapInArrow(run, "id long, v array<double>, floor double, met array<struct<b:long,leaves:array<long>>>")
        return met.select("id", "v", "floor", F.explode("met").alias("m")).select("id", "v", "floor", "m.b", "m.leaves")

    def score(x: pa.Table, q: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if x.num_rows and q.num_rows:
            vectors_of = lambda t: _matrix(t.column("v").combine_chunks())
            found = best_of(vectors_of(q), q.column("id").to_numpy(), vectors_of(x), x.column("id").to_numpy(), rules.k, x.column("leaf").to_numpy(), q.column("leaves").to_pylist(), q.column("floor").to_pylist())
        return pa.Table.from_batches([_table(found)])

    def scored(queries: DataFrame, margin: float | None) -> DataFrame:
        asked = visitors(queries, margin)
        parts = asked.groupBy("b").agg(F.ceil(F.count("*") / rules.block_queries).alias("parts"))
        left = held.mapInArrow(placed, "id long, v array<double>, leaf long, b long").join(parts, "b").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = asked.join(parts, "b").withColumn("g", F.pmod(F.xxhash64("id"), "parts"))
        found = left.select("b", "g", "id", "v", "leaf").groupBy("b", "g").cogroup(right.select("b", "g", "id", "v", "floor", "leaves").groupBy("b", "g")).applyInArrow(score, FOUND)
        return ranked(found, rules.k)

    queries = vectors.filter(is_query(F.col("id")))
    near = checkpointed(scored(queries.withColumn("floor", F.lit(None).cast("double")), None))
    floors = near.filter(F.col("rank") == rules.k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")).dropDuplicates(["id"])
    widened = checkpointed(queries.join(floors, "id", "left"))
    more = scored(widened, calibrated_margin(tree, held, rules, widened))
    return ranked(near.drop("rank").unionByName(more.drop("rank")), rules.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
