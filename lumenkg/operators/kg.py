"""Building a knowledge graph from triplets: canonical names, merged edges, filters, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trust of an edge's source and strength of its relation when several meet on one pair.
RELATION_RANK = {"belong_to": 100, "part_of": 90, "depend_on": 85, "synonym_of": 40, "related_with": 15}
OTHER_RELATION_RANK = 20


def lookup(values: dict, c: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(table[c], F.lit(default))


def first_filled(c: Column, order: Column) -> Column:
    """Aggregate: the first non-empty value by order."""
    return F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", order))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def canonical(rows: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """Replace names by their canonical ones in (alias, canonical); unknown names stay."""
    for c in columns:
        map_ = aliases.select(F.col("alias").alias(c), F.col("canonical").alias("_to"))
        rows = rows.join(map_, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return rows


def merged_edges(trips: DataFrame) -> DataFrame:
    """One edge per (subject, relation, object): its number of mentions and cues, and its first non-empty statement; loops go."""
    return trips.filter("subject <> object").groupBy("subject", "relation", "object").agg(
        F.count("*").alias("mentions"),
        F.countDistinct("cue").alias("cues"),
        first_filled(F.col("statement"), F.col("row_id")).alias("statement"),
    )


def endpoints(edges: DataFrame, *carry: str) -> DataFrame:
    """(entity, ...) once per end of each edge."""
    return edges.select(F.explode(F.array("subject", "object")).alias("entity"), *carry)


def without_weak_twins(edges: DataFrame, weak: str = "related_with") -> DataFrame:
    """Drop weak edges of an unordered pair that also has a specific relation."""
    w = Window.partitionBy(F.least("subject", "object"), F.greatest("subject", "object"))
    return edges.withColumn("_strong", F.max((F.col("relation") != weak).cast("int")).over(w)).filter((F.col("relation") != weak) | (F.col("_strong") == 0)).drop("_strong")


def one_relation_per_pair(edges: DataFrame) -> DataFrame:
    """Of several relations on an unordered pair the strongest; equal ones by subject, object."""
    rank = lookup(RELATION_RANK, F.col("relation"), OTHER_RELATION_RANK)
    w = Window.partitionBy(F.least("subject", "object"), F.greatest("subject", "object")).orderBy(F.desc(rank), "subject", "object")
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def without_shortcuts(edges: DataFrame) -> DataFrame:
    """Drop s part_of o where s belong_to p and p part_of o."""
    up = edges.filter("relation = 'belong_to'").select(F.col("subject").alias("s"), F.col("object").alias("p"))
    over = edges.filter("relation = 'part_of'").select(F.col("subject").alias("p"), F.col("object").alias("o"))
    both = up.join(over, "p").select("s", "o").distinct()
    cut = (F.col("subject") == F.col("s")) & (F.col("object") == F.col("o")) & (F.col("relation") == "part_of")
    return edges.join(both, cut, "left_anti")
