"""Graph operators as joins and aggregations; iterations cut their lineage in the checkpoint folder."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/lumenkg"


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder (spark.checkpoint.dir); a local one only where none is set and all is one process."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or LOCAL_CHECKPOINT_DIR)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared checkpoint folder and read it back: lineage is cut, and lost executors lose nothing.

    A table read back has its true size.  checkpoint() keeps the estimate of its plan instead, which joins of
    round after round multiply into numbers of any length, so that planning outlasts the work.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85, seeds: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(node, rank) after a fixed number of power iterations over (subject, object, weight).

    With a tolerance the iterations end once all ranks together move by less than it; then rounds is the most there may be,
    and ranks that still move after them are an error.

    The mass of nodes without out-edges, and the jump, go to the seeds (node, p), p summing
    to 1, or to all nodes evenly.
    """
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    if seeds is None:
        start = nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select("node", (1.0 / F.col("n")).alias("p"))  # one row
    else:
        start = nodes.join(seeds, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    start = cut(start)
    out = edges.groupBy("subject").agg(F.sum("weight").alias("_all"))  # a join spreads the edges of a hub, a window would not
    share = cut(edges.join(out, "subject").select("subject", "object", (F.col("weight") / F.col("_all")).alias("share")))
    rank = start.select("node", F.col("p").alias("r"))
    for _ in range(rounds):
        flow = share.join(rank, share["subject"] == rank["node"]).groupBy(F.col("object").alias("node")).agg(F.sum(F.col("share") * F.col("r")).alias("x"))
        moved = cut(start.join(flow, "node", "left").select("node", "p", F.coalesce("x", F.lit(0.0)).alias("x")))  # read twice below
        lost = moved.agg((1 - F.sum("x")).alias("lost"))  # one row: what dangling nodes hold
        after = moved.crossJoin(F.broadcast(lost)).select("node", (alpha * (F.col("x") + F.col("lost") * F.col("p")) + (1 - alpha) * F.col("p")).alias("r"))
        if tolerance is None:
            rank = after
            continue
        before, rank = rank.withColumnRenamed("r", "old"), cut(after)
        moves = rank.join(before, "node").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        if moves is None or moves < tolerance:
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"ranks still move by {tolerance} or more after {rounds} rounds")
    return rank.withColumnRenamed("r", "rank")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, by least labels and pointer jumping."""
    both = cut(edges.select(F.col("subject").alias("u"), F.col("object").alias("v")).unionByName(edges.select(F.col("object").alias("u"), F.col("subject").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        low = label.join(near, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        root = low.select(F.col("u").alias("c"), F.col("c").alias("root"))
        after = cut(low.join(root, "c", "left").select("u", F.coalesce("root", "c").alias("c"), "old"))
        label = after.drop("old")
        if after.filter("c <> old").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, depth) within hops of the seeds, edges taken both ways, each node at its least depth."""
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, hops + 1):
        fresh = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = cut(fresh.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def trust(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(node, score): seed scores carried along edges, decayed once per hop and summed over all walks."""
    step = seeds.select("node", "score")
    total = step
    for _ in range(hops):
        step = step.join(edges, F.col("node") == F.col("subject")).groupBy(F.col("object").alias("node")).agg((F.sum("score") * decay).alias("score"))
        total = total.unionByName(step)
    return total.groupBy("node").agg(F.sum("score").alias("score"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): the largest k for which the node is in the k-core of the undirected graph.

    Bounds start at the degree; a node's next bound is the largest h such that h of its
    neighbours have a bound of h at least (its own bound being the limit).  They only fall,
    and where none falls they are the core numbers, for any k.
    """
    both = edges.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).filter("a <> b").distinct()
    near = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    bound = cut(near.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("core")))
    down = Window.partitionBy("a").orderBy(F.desc("x"))
    while True:
        mine, theirs = bound.select(F.col("node").alias("a"), F.col("core").alias("own")), bound.select(F.col("node").alias("b"), F.col("core").alias("x"))
        # How many neighbours have which bound, so that a hub has few rows.
        tally = near.join(theirs, "b").groupBy("a", "x").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(down))
        h = tally.groupBy("a").agg(F.max(F.least("x", "n")).alias("h"))
        after = cut(mine.join(h, "a").select(F.col("a").alias("node"), F.least("own", "h").alias("core"), "own"))
        bound = after.select("node", "core")
        if after.filter("core < own").isEmpty():
            return bound


def fuse_with_cores(ranks: DataFrame, cores: DataFrame, core_weight: float = 0.3) -> DataFrame:
    """(node, final, pr, k_core, norm_k, norm_pr): PageRank and core number, each over its largest, blended; a node without a core has 0."""
    both = ranks.select("node", F.col("rank").alias("pr")).join(cores.select("node", F.col("core").cast("double").alias("k")), "node", "left").withColumn("k_core", F.coalesce("k", F.lit(0.0)))
    tops = F.broadcast(both.agg(F.max("pr").alias("top_pr")).crossJoin(cores.agg(F.max("core").alias("top_k"))))  # one row
    over = lambda x, top: F.when(F.col(top) > 0, F.col(x) / F.col(top)).otherwise(0.0)
    scaled = both.crossJoin(tops).select("node", "pr", "k_core", over("k_core", "top_k").alias("norm_k"), over("pr", "top_pr").alias("norm_pr"))
    return scaled.select("node", ((1 - core_weight) * F.col("norm_pr") + core_weight * F.col("norm_k")).alias("final"), "pr", "k_core", "norm_k", "norm_pr")


def propagate_up(edges: DataFrame, scores: DataFrame, rate: float = 0.22, levels: int | None = None, mode: str = "linear", least: float = 1e-12) -> DataFrame:
    """(node, score): children (subject) raise parents (object) by rate / sqrt(number of parents), over all paths.

    Waves go up until none is left, or levels of them; on a cycle, where they never end,
    each is rate times the last at most, and they stop once all lie below least.
    mode linear adds the boost and divides by the largest score; saturating closes the gap to 1 by 1 - exp(-boost / .45).
    """
    up = edges.groupBy("subject").agg(F.count("*").alias("_n"))
    step = cut(edges.join(up, "subject").select("subject", "object", (rate / F.sqrt("_n")).alias("f")))
    wave = scores.select("node", F.col("score").alias("x"))
    boost, level = wave.filter("false"), 0
    while level != levels:
        wave = cut(wave.join(step, F.col("node") == F.col("subject")).groupBy(F.col("object").alias("node")).agg(F.sum(F.col("x") * F.col("f")).alias("x")))
        if wave.filter(F.abs("x") >= least).isEmpty():
            break
        boost, level = boost.unionByName(wave), level + 1
    raised = scores.join(boost.groupBy("node").agg(F.sum("x").alias("b")), "node", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    if mode == "saturating":
        return raised.select("node", (F.col("score") + (1 - F.col("score")) * (1 - F.exp(-F.col("b") / 0.45))).alias("score"))
    total = raised.select("node", (F.col("score") + F.col("b")).alias("score"))
    return total.crossJoin(F.broadcast(total.agg(F.max("score").alias("top")))).select("node", (F.col("score") / F.col("top")).alias("score"))


def hub_penalty(out_degree: Column, weak_share: Column, limit: int = 20) -> Column:
    """1 up to limit out-edges, then falling with the root of the degree; up to 30 % less for weak relations."""
    return F.when(out_degree > limit, F.sqrt(F.lit(float(limit)) / out_degree)).otherwise(1.0) * (1 - 0.3 * weak_share)


# Titles of books and courses, which are no concepts of a chapter.
META_TITLES = ("数理逻辑与集合论", "离散数学", "mathematical logic and set theory", "discrete mathematics")


def is_meta_name(name: Column, titles: tuple[str, ...] = META_TITLES) -> Column:
    """Whether a name, or what stands before its first slash, is a title or begins with one; titles of several words count anywhere in it. A null name is none."""
    full = F.lower(F.coalesce(name, F.lit("")))
    first = F.trim(F.split(full, "/")[0])
    signs = [(first == t) | (full.contains(t) if " " in t else full.startswith(t)) for t in titles]
    return reduce(Column.__or__, signs, F.lit(False))


def demote_meta_hubs(ranked: DataFrame, titles: tuple[str, ...] = META_TITLES, factor: float = 0.35, name: str = "node", score: str = "final") -> DataFrame:
    """ranked with the score of titles cut to factor of it, and a column meta_demoted."""
    return ranked.withColumn("meta_demoted", is_meta_name(F.col(name), titles)).withColumn(score, F.when(F.col("meta_demoted"), F.col(score) * factor).otherwise(F.col(score)))


def long_components(edges: DataFrame) -> DataFrame:
    """Edges of components that hold a simple path of at least 3 edges.

    Connected graphs without one are single nodes, stars and triangles, which their counts tell;
    paths themselves, many on a graph with hubs, are never listed.
    """
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).filter("a <> b").distinct()
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"))
    parts = components(edges)
    size = parts.join(degree, "node").groupBy("component").agg(F.count("*").alias("n"), (F.sum("d") / 2).alias("m"), F.max("d").alias("top"))
    good = size.filter("NOT (m = n - 1 AND top = n - 1) AND NOT (n = 3 AND m = 3)").select("component")
    return edges.join(parts.join(good, "component", "left_semi"), F.col("subject") == F.col("node"), "left_semi")
