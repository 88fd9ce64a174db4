"""Fusing the views of a course graph, and the videos of its points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("zh_name", "name", "en_name")


def identity(*names: Column) -> Column:
    """The first name that is not empty, without white space, in lower case."""
    first = F.coalesce(*[F.when(n != "", n) for n in names], F.lit(""))
    return F.lower(F.regexp_replace(first, "\\s+", ""))


def fused_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fused nodes, map of (view, id) to canonical id) of nodes (view, pos, id, zh_name, name, en_name, anchors).

    Nodes are one by identity (zh_name, else name, en_name, id); the first id stays, the
    values of the latest view win, anchors are united.  Nodes without an identity go.
    """
    at = F.struct("view", "pos")
    keyed = nodes.withColumn("key", identity(*[F.col(c) for c in (*NAMES, "id")])).filter("key <> ''")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in NAMES]
    anchors = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("anchors", F.array().cast("array<string>"))))))
    fused = keyed.groupBy("key").agg(F.min_by("id", F.when(F.col("id").isNotNull(), at)).alias("id"), *last, anchors.alias("anchors"))
    return fused, keyed.filter("id IS NOT NULL").join(fused.select("key", F.col("id").alias("canonical")), "key").select("view", "id", "canonical").distinct()


def fused_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (view, pos, source, target, relation, ...) with canonical ends, one per triplet, the latest view's; edges with an unknown end go."""
    end = lambda c: ids.select("view", F.col("id").alias(c), F.col("canonical").alias(f"_{c}"))
    e = edges.join(end("source"), ["view", "source"]).join(end("target"), ["view", "target"])
    e = e.withColumn("source", F.col("_source")).withColumn("target", F.col("_target")).drop("_source", "_target")
    i = F.row_number().over(Window.partitionBy("source", "target", "relation").orderBy(F.desc("view"), F.desc("pos")))
    return e.withColumn("_i", i).filter("_i = 1").drop("_i")


def point_aliases(*values: Column) -> Column:
    """Normal forms of names and of their parts between slashes and bars: letters, digits and underscores in lower case."""
    trimmed = [F.trim(F.coalesce(v, F.lit(""))) for v in values]
    parts = F.flatten(F.array(*[F.concat(F.array(v), F.split(v, "[/／|]")) for v in trimmed]))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"(?U)[^\w]+", "")), lambda p: p != ""))


def point_segments(points: DataFrame, relations: DataFrame) -> DataFrame:
    """(point, segment, place): segments of relations (point_id, point_name, segment, place) that share an alias with a point (point, name); the first place of each."""
    wanted = points.select("point", F.explode(point_aliases(F.col("point"), F.col("name"))).alias("alias"))
    held = relations.select("segment", "place", F.explode(point_aliases(F.col("point_id"), F.col("point_name"))).alias("alias"))
    return wanted.join(held, "alias").groupBy("point", "segment").agg(F.min("place").alias("place"))


def point_references(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(point, video, start_sec, segment): chunks (segment, video, start_sec) of a point's segments, one per video and start, the first place's; chunks without a video go."""
    found = segments.join(chunks.filter(F.trim(F.coalesce("video", F.lit(""))) != ""), "segment").withColumn("start_sec", F.coalesce("start_sec", F.lit(0.0)))
    return found.groupBy("point", "video", "start_sec").agg(F.min_by("segment", F.struct("place", "segment")).alias("segment"))
