"""Merkle manifest of a dataset: an authentication path for every row, by traversal scheduling.

Every row is a leaf; the leaves of a tree (a source) ascend by key, and runs of `arity`
nodes are hashed into their parent until one node is left.  The roots of the trees, in
order of their names, are the leaves of one more tree, whose top is the root.

Texts are read once, to hash a row; everything later moves digests.  Leaves are numbered
inside their tree by a range partition and one count per task.  Aligned blocks of
arity ** block_levels leaves are then the unit of work.  Going up, a treehash stack turns
a block into its top, and the tops are the nodes of the next level, again in blocks.
Going down, a block gets one header row with the path above its top, and its leaves are
traversed in order: at each level the current run of siblings is held, and a treehash
stack, fed one leaf a step, has the next run ready when the current one ends.  So a path
costs its own length, the state is one run and one stack a level, and the upper path is
appended to each leaf's own.  A source with a third of all rows is as many blocks as its
rows need.

Cases: a null field is `-`, an empty one `0:`; a null source is a tree of its own, the
first; null keys come first; rows that repeat a source and a key are leaves of their own in the
order of their digests, so rows equal in all fields share digest and path up to their position; texts of any length are
hashed whole; a tree of one leaf is that leaf, and with a single tree its subroot is the
root; an empty table gives an empty result.  Only the named fields are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, in_bucket, prepare, table

PATH = "array<struct<slot:int,left:string,right:string>>"
PATH_ARROW = pa.list_(pa.struct([("slot", pa.int32()), ("left", pa.string()), ("right", pa.string())]))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class MerkleRules:
    arity: int = 16
    #: Levels of one block, so arity ** block_levels leaves at most are in a task's hands at once.
    block_levels: int = 3
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    tree: str = "source"
    key: str = "doc_id"
    #: Trees are broadcast up to this many (about 60 bytes and the name each), beyond it joined by shuffle.
    broadcast_trees: int = 100_000

    @property
    def block_rows(self) -> int:
        return self.arity**self.block_levels


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Hash of a row's fields: each as its length in bytes, a colon and its text, or `-` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


class Treehash:
    """Nodes of one level out of leaves in order: one unfinished run is held for each level below."""

    def __init__(self, level: int, arity: int):
        self.runs: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []
        self.arity = arity

    def push(self, node: str, level: int = 0) -> None:
        for run in self.runs[level:]:
            run.append(node)
            if len(run) < self.arity:
                return
            node = digest(run)
            run.clear()
        self.nodes.append(node)

    def close(self) -> list[str]:
        """No leaf follows: unfinished runs, even of one node, become their parents."""
        for level, run in enumerate(self.runs, 1):
            if run:
                node = digest(run)
                run.clear()
                self.push(node, level)
        return self.nodes


def treehash(leaves: list[str], level: int, arity: int) -> list[str]:
    out = Treehash(level, arity)
    for leaf in leaves:
        out.push(leaf)
    return out.close()


def traverse(leaves: list[str], height: int, arity: int) -> Iterator[list[tuple[int, str, str]]]:
    """Per leaf its path up to height: (slot, siblings to the left, to the right) of each level."""
    spans = [arity ** (h + 1) for h in range(height)]
    runs = [treehash(leaves[: spans[h]], h, arity) for h in range(height)]
    ahead = [Treehash(h, arity) for h in range(height - 1)]  # the top's children are one run for all leaves
    path: list[tuple[int, str, str]] = [(0, "", "")] * height
    for i in range(len(leaves)):
        for h in range(height):
            if i % arity**h:
                break
            slot = i // arity**h % arity
            path[h] = (slot, "".join(runs[h][:slot]), "".join(runs[h][slot + 1 :]))
        yield list(path)
        for h in range(height - 1):
            if i + spans[h] < len(leaves):
                ahead[h].push(leaves[i + spans[h]])
            if (i + 1) % spans[h] == 0:
                runs[h], ahead[h] = ahead[h].close(), Treehash(h, arity)


def block_height(n: int, rules: MerkleRules) -> int:
    """Levels between a block of a tree of n nodes and the block's top: all of them, or as many as a tree of one block has."""
    if n > rules.block_rows:
        return rules.block_levels
    height = 0
    while rules.arity**height < n:
        height += 1
    return height


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (tree, block) after the other; they arrive sorted by both, a block never larger than rules allow."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack([batch.column("tree").to_numpy(), batch.column("block").to_numpy()])
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (at[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = at[a]
    if held:
        yield pa.Table.from_batches(held)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def block_tops(nodes: DataFrame, rules: MerkleRules) -> DataFrame:
    """(tree, pos, digest, n) of the next level: one node per block of nodes (tree, pos, digest, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for block in _blocks(batches):
            n = block.column("n")[0].as_py()
            top = treehash(block.column("digest").to_pylist(), block_height(n, rules), rules.arity)[0]
            rows.append((block.column("tree")[0].as_py(), block.column("block")[0].as_py(), top, -(-n // rules.block_rows)))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["tree", "pos", "digest", "n"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["tree", "pos", "digest", "n"])

    cut = nodes.select("tree", F.expr(f"pos div {rules.block_rows}").alias("block"), "pos", "digest", "n")
    return _dealt(cut).mapInArrow(run, "tree long, pos long, digest string, n long")


def _paths(column: list[list[tuple[int, str, str]]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, column)]).astype(np.int32)
    slot, left, right = zip(*(x for p in column for x in p)) if ends[-1] else ((), (), ())
    parts = [pa.array(slot, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["slot", "left", "right"]))


def with_paths(nodes: DataFrame, above: DataFrame, rules: MerkleRules) -> DataFrame:
    """nodes with `path` and `top`, out of above (tree, pos, path, top): the path over each block's top."""
    extra = [c for c in nodes.columns if c not in ("tree", "pos", "digest", "n")]
    cut = nodes.select("tree", F.expr(f"pos div {rules.block_rows}").alias("block"), "pos", "digest", "n", *extra, F.lit(None).cast(PATH).alias("path"))
    empty = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra]
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.col("top").alias("digest"), F.lit(0).cast("long").alias("n"), *empty, "path")
    names = ["tree", "pos", "digest", "n", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            head, block = block.slice(0, 1), block.slice(1)  # position -1 sorts first
            upper = [(s["slot"], s["left"], s["right"]) for s in head.column("path")[0].as_py()]
            height = block_height(block.column("n")[0].as_py(), rules)
            paths = _paths([p + upper for p in traverse(block.column("digest").to_pylist(), height, rules.arity)])
            tops = pa.array([head.column("digest")[0].as_py()] * block.num_rows, pa.string())
            out = block.select(names).append_column("path", paths).append_column("top", tops)
            yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in names)
    return _dealt(cut.unionByName(heads)).mapInArrow(run, f"{kinds}, path {PATH}, top string")


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with `pos`, their place in their tree from 0: a range partition, and one count per task and tree."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    cut = checkpointed(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = cut.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_at"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = cut.join(before, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_at")))
    return placed.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_tree", "_at", "_shift")


def climbed(nodes: DataFrame, most: int, rules: MerkleRules) -> list[DataFrame]:
    """nodes and the levels of block tops over them, until the largest tree (of most nodes) is one node."""
    levels = [nodes]
    while most > 1 or len(levels) == 1:
        levels.append(checkpointed(block_tops(levels[-1], rules)))
        most = -(-most // rules.block_rows)
    return levels


def manifest(spark: SparkSession, rows: DataFrame, rules: MerkleRules = MerkleRules(), extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, position, leaf, path, subroot, root, and the extra columns) of every row.

    path holds, level by level from the leaf to the root, the row's slot in its run and the
    digests of the run's other nodes, to its left and to its right.  extra are expressions over rows.
    """
    prepare(spark)
    extra = extra or {}
    names = [f"x{i}" for i in range(len(extra))]
    own = rows.select(
        F.col(rules.tree).cast("string").alias("source"),
        F.col(rules.key).alias("key"),
        leaf_digest([F.col(f) for f in rules.fields]).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        *[c.alias(n) for n, c in zip(names, extra.values())],
    )
    leaves = checkpointed(own)  # the last reading of texts
    counted = checkpointed(leaves.groupBy("source").agg(F.count("*").alias("n")))
    n_trees, most = counted.agg(F.count("*"), F.max("n")).first()
    trees = numbered(counted.withColumn("all", F.lit(0).cast("long")), "all", ["source"]).select(F.col("source").alias("name"), F.col("pos").alias("tree"), "n")
    named = F.broadcast(trees) if n_trees <= rules.broadcast_trees else trees
    nodes = numbered(leaves.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name"), "tree", ["key", "digest", "row"]).drop("row")
    levels = climbed(checkpointed(nodes), most or 0, rules)
    subroots = levels.pop().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_trees).cast("long").alias("n"))
    uppers = climbed(subroots, n_trees, rules)
    root = uppers.pop().first()
    above = spark.createDataFrame([(0, 0, [], None)] if root else [], f"tree long, pos long, path {PATH}, top string")
    for level in reversed(uppers):
        above = with_paths(level, above, rules)
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("top"))
    for level in reversed(levels):
        above = with_paths(level, above, rules)
    kept = [F.col(n).alias(c) for n, c in zip(names, extra)]
    return above.select(F.col("key").alias(rules.key), F.col("pos").alias("position"), F.col("digest").alias("leaf"), "path", F.col("top").alias("subroot"), F.lit(root.digest if root else None).alias("root"), *kept)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """Hash of all siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = MerkleRules()
    lower = F.when(F.length("text") == F.octet_length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, UPPER.lower()))
    tampered = leaf_digest([lower if f == "text" else F.col(f) for f in rules.fields])
    out = manifest(spark, table(spark, sf_dir, "documents"), rules, {"changed": F.when(in_bucket("doc_id", 5, 0), tampered)})
    found = out.withColumn("folded_root", folded(F.col("path"), F.coalesce("changed", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::VARCHAR), ':', {0}) END"


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(f) for f in ["doc_id", "source", "lang", "n_chars", text]) + "))"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, translate(text, '{UPPER}', '{UPPER.lower()}') AS low,
  xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS crc FROM documents),
e AS (SELECT r, doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {_leaf_sql('low')} END AS low FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM e),
a AS (SELECT s, 0 AS k, p, leaf AS h, n FROM p
  UNION ALL SELECT s, k + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (n + 15) // 16 FROM a WHERE n > 1 GROUP BY s, k, p // 16, n),
sub AS (SELECT s, k AS top, h FROM a WHERE n = 1),
b AS (SELECT 0 AS k, s AS p, h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT k + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (n + 15) // 16 FROM b WHERE n > 1 GROUP BY k, p // 16, n),
w AS (SELECT r, a.k, string_agg(a.h, '' ORDER BY a.p) FILTER (WHERE a.p < p.p // (16 ** a.k)::BIGINT) AS l, string_agg(a.h, '' ORDER BY a.p) FILTER (WHERE a.p > p.p // (16 ** a.k)::BIGINT) AS g
  FROM p JOIN a ON a.s = p.s AND a.n > 1 AND a.p // 16 = p.p // (16 ** (a.k + 1))::BIGINT GROUP BY r, a.k
  UNION ALL SELECT r, top + b.k, string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p < p.s // (16 ** b.k)::BIGINT), string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p > p.s // (16 ** b.k)::BIGINT)
  FROM p JOIN sub ON sub.s = p.s JOIN b ON b.n > 1 AND b.p // 16 = p.s // (16 ** (b.k + 1))::BIGINT GROUP BY r, top, b.k),
f AS (SELECT r, 0 AS k, coalesce(low, leaf) AS h FROM p
  UNION ALL SELECT f.r, f.k + 1, sha256(concat(l, f.h, g)) FROM f JOIN w ON w.r = f.r AND w.k = f.k),
o AS (SELECT r, arg_max(h, k) AS folded_root FROM f GROUP BY r),
q AS (SELECT r, string_agg(concat(l, g), '' ORDER BY k) AS all_siblings FROM w GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(coalesce(all_siblings, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT h FROM b WHERE n = 1) AS verified
FROM p JOIN sub USING (s) JOIN o USING (r) LEFT JOIN q USING (r)
"""
