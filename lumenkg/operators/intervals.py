"""Interval and sequence operators over timed rows: islands, unions, range joins, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: str, start: str, end: str, gap: float, tie: str) -> DataFrame:
    """Number the runs of rows whose start is at most gap after the latest end so far (column island)."""
    w = Window.partitionBy(group).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    return rows.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w)).drop("_new")


def union_intervals(rows: DataFrame, group: str, start: str, end: str, gap: float, tie: str) -> DataFrame:
    """The union of a group's intervals, joined across gaps of at most gap."""
    return islands(rows, group, start, end, gap, tie).groupBy(group, "island").agg(F.min(start).alias("start_sec"), F.max(end).alias("end_sec"), F.count("*").alias("n"))


def changed_runs(rows: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """Number the runs of neighbouring rows with one key (column run)."""
    w = Window.partitionBy(group).orderBy(*order)
    fresh = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w)).drop("_new")


def boundaries_to_pages(rows: DataFrame, group: str, at: str, shortest: float) -> DataFrame:
    """Intervals between neighbouring boundaries of at least shortest seconds, numbered anew."""
    w = Window.partitionBy(group).orderBy(at)
    cut = rows.select(group, at).distinct().withColumn("end_sec", F.lead(at).over(w)).filter(F.col("end_sec") - F.col(at) >= shortest)
    return cut.select(group, (F.row_number().over(w) - 1).alias("page"), F.col(at).alias("start_sec"), "end_sec")


def range_join(left: DataFrame, right: DataFrame, group: str, width: float) -> DataFrame:
    """Pairs of left (l_start, l_end) and right (r_start, r_end) of one group that overlap.

    Both sides are cut into buckets of width, so the plan is an equi-join; a pair is kept in
    the first bucket that it shares only.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    a, b = left.withColumn("_b", bucket("l_start", "l_end")), right.withColumn("_b", bucket("r_start", "r_end"))
    both = a.join(b, [group, "_b"]).filter((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    return both.filter(F.col("_b") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_b")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def split_long(rows: DataFrame, longest: float, lap: float) -> DataFrame:
    """Cut intervals longer than longest into pieces that overlap by lap."""
    n = F.when(F.col("end_sec") - F.col("start_sec") <= longest, 0).otherwise(F.ceil((F.col("end_sec") - F.col("start_sec") - longest) / (longest - lap)))
    at = F.col("start_sec") + F.col("piece") * (longest - lap)
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    return cut.withColumn("piece_start", at).withColumn("piece_end", F.least(F.col("end_sec"), at + longest))


def debounce(rows: DataFrame, group: str, at: str, gap: float) -> DataFrame:
    """Keep the first moment of a group, then each at least gap after the last kept one.

    The anchor is the last kept row, so this is a fold: moments of a group are sorted and
    folded as one array (a group is one lecture's boundaries).
    """
    folded = F.aggregate(
        F.array_sort(F.collect_set(at)),
        F.array().cast("array<double>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(x))).otherwise(kept),
    )
    return rows.groupBy(group).agg(folded.alias("kept")).select(group, F.explode("kept").alias(at))
