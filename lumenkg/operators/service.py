"""Course graphs as tables: reads, edits with referential checks, views and their fusion, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order in which views override each other when fused.
VIEW_ORDER = {"base": 1, "document": 2, "video": 3}


def identity(zh: Column, name: Column, en: Column, id_: Column) -> Column:
    """What makes nodes of different views one: the first given name, without white space, in lower case."""
    filled = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (zh, name, en, id_)])
    return F.lower(F.regexp_replace(filled, "\\s+", ""))


def fuse(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all views: nodes by identity, later views win column by column, edge ends rewritten, edges distinct."""
    order = F.create_map(*[F.lit(x) for kv in VIEW_ORDER.items() for x in kv])[F.col("view")]
    n = nodes.withColumn("key", identity(F.col("zh_name"), F.col("name"), F.col("en_name"), F.col("id"))).withColumn("o", order)
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("o"))).alias(c)
    fused = n.groupBy("course", "key").agg(F.min_by("id", F.struct("o", "id")).alias("id"), *map(last, ("name", "zh_name", "en_name")), F.array_sort(F.collect_set("view")).alias("views"))
    ids = n.select("course", "view", F.col("id").alias("old"), "key").join(fused.select("course", "key", F.col("id").alias("new")), ["course", "key"]).select("course", "view", "old", "new")
    e = edges
    for end in ("source", "target"):
        e = e.join(ids.withColumnRenamed("old", end), ["course", "view", end]).withColumn(end, F.col("new")).drop("new")
    return fused.drop("key"), e.filter("source <> target").select("course", "source", "target", "relation").distinct()


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes whose id is free; taken ids are refused."""
    return nodes.unionByName(new.join(nodes, ["course", "view", "id"], "left_anti"), allowMissingColumns=True)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of (course, view, id), nor any edge that touches one."""
    key = ["course", "view", "id"]
    left = nodes.join(gone.select(*key), key, "left_anti")
    for end in ("source", "target"):
        edges = edges.join(gone.select("course", "view", F.col("id").alias(end)), ["course", "view", end], "left_anti")
    return left, edges


def rename_nodes(nodes: DataFrame, edges: DataFrame, renamed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of (course, view, id, new_id) replaced in nodes and in both ends of edges."""
    def swap(df: DataFrame, c: str) -> DataFrame:
        m = renamed.select("course", "view", F.col("id").alias(c), F.col("new_id").alias("_new"))
        return df.join(m, ["course", "view", c], "left").withColumn(c, F.coalesce("_new", c)).select(df.columns)

    return swap(nodes, "id"), swap(swap(edges, "source"), "target")


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges with both ends present, no loops, one per unordered pair; pairs that have an edge are refused."""
    ids = nodes.select("course", "view", "id").distinct()
    ok = new.filter("source <> target")
    for end in ("source", "target"):
        ok = ok.join(ids.withColumnRenamed("id", end), ["course", "view", end], "left_semi")
    pair = lambda df: df.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    ok = pair(ok).dropDuplicates(["course", "view", "a", "b"]).join(pair(edges).select("course", "view", "a", "b"), ["course", "view", "a", "b"], "left_anti")
    return edges.unionByName(ok.select(edges.columns))


def permission(role: Column, course: Column, readable: Column, writable: Column) -> Column:
    """U (unknown), L (listed only), RO or RW of a course for a role with lists of readable and writable courses."""
    return (
        F.when(role.isNull(), "U")
        .when(role == "admin", "RW")
        .when(F.array_contains(writable, course), "RW")
        .when(F.array_contains(readable, course), "RO")
        .otherwise("L")
    )
