"""Scores of relations and entities: composite relation score, discourse and mention channels, chapter rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkg.operators.graph import cut


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with the place of each row in a total order, from 1: rows are sorted by ranges, so no task sees all of them.

    The sorted rows are written to the checkpoint folder, so that places do not move; what
    is broadcast has one row a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % 2**33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part")) - F.col("_n")).drop("_n")  # a row a partition
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")


def relation_score(weight: Column, seeds: Column, text_hits: Column, mentioned: Column, importance: Column, hop: Column, weak: Column) -> Column:
    """Weight + 3 a seed end + 2 a text hit + 2 a mentioned end + 10 x importance - 3 a hop - 2 for a weak relation beyond the first hop."""
    return weight + 3.0 * seeds + 2.0 * text_hits + 2.0 * mentioned + 10.0 * importance - 3.0 * hop - F.when((hop >= 1) & weak, 2.0).otherwise(0.0)


def discourse_channel(ends: DataFrame, example: Column, definition: Column, boost: Column | float = 1.0) -> DataFrame:
    """(entity, score) of ends (entity, role in attr/owner/other, ...): x .55 near an example, x 1.35 near a definition, x .5 for mere attributes."""
    w = Window.partitionBy("entity")
    d = ends.withColumn("deg", F.count("*").over(w)).withColumn("attr", F.count_if(F.col("role") == "attr").over(w)).withColumn("owner", F.count_if(F.col("role") == "owner").over(w))
    only = (F.col("deg") <= 3) & (F.col("owner") == 0) & (F.col("attr") >= F.greatest(F.lit(1), F.col("deg") - F.col("owner")))
    x = F.when(example, 0.55).otherwise(1.0) * F.when(definition, 1.35).otherwise(1.0) * F.when(only, 0.5).otherwise(1.0) * boost
    return d.groupBy("entity").agg(F.sum(x).alias("score"))


def mention_channel(mentions: DataFrame, position: Column, weight: Column | float = 1.0) -> DataFrame:
    """(entity, score): mean context weight x 1.25 x log(1 + mentions) x entity weight."""
    return mentions.groupBy("entity").agg((F.avg(position) * 1.25 * F.log1p(F.count("*")) * F.max(F.lit(weight) if isinstance(weight, float) else weight)).alias("score"))


def off_chapter(score: Column, prefers_other: Column, protected: Column, in_secondary: Column, penalty: float = 0.55) -> Column:
    """Soften scores of entities outside the chapter; those that suit another one better lose most."""
    rest = F.when(in_secondary, score * min(1.0, penalty + 0.15)).otherwise(score * penalty)
    return F.when(prefers_other, score * min(penalty, 0.35)).when(protected, score).otherwise(rest)


def chapter_boost(prior: DataFrame, hit: Column, boost: float = 1.35, top: int = 80) -> DataFrame:
    """Raise the prior's first top entities and those that hit the chapter's words."""
    head = prior.orderBy(F.desc("score"), "entity").limit(top).select("entity", F.lit(True).alias("head"))
    return prior.join(F.broadcast(head), "entity", "left").select("entity", F.when(F.col("head") | hit, F.col("score") * boost).otherwise(F.col("score")).alias("score"))


def longest_mentions(text: Column, names: list[str]) -> Column:
    """Mentions from left to right, the longest name first at each place, without overlaps."""
    ordered = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    return F.regexp_extract_all(text, F.lit("|".join(f"\\Q{n}\\E" for n in ordered)), F.lit(0)) if ordered else F.array().cast("array<string>")
