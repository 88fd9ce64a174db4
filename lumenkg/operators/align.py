"""Sequence alignment and matching between texts by character and word n-grams."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_grams(rows: DataFrame, key: str, words: Column, n: int = 4) -> DataFrame:
    """(key, pos, gram) of every window of n words."""
    w = rows.select(key, words.alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    return w.select(key, F.posexplode(grams).alias("pos", "gram"))


def unique_grams(grams: DataFrame) -> DataFrame:
    """Grams that occur once in all rows."""
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.min(grams.columns[0]).alias(grams.columns[0])).filter("n = 1").drop("n")


def among(grams: DataFrame, known: DataFrame, max_broadcast: int = 500_000) -> DataFrame:
    """Rows of grams whose gram known has, too: by a broadcast of known up to a counted bound, so that other grams are never shuffled, else by a shuffle."""
    keys = known.select("gram").distinct()
    few = keys.limit(max_broadcast + 1).count() <= max_broadcast
    return grams.join(F.broadcast(keys) if few else keys, "gram", "left_semi").select(grams.columns)


def anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Grams unique on both sides: pairs of places that must be the same passage."""
    x = unique_grams(a)
    y = unique_grams(among(b, x))
    ka, kb = a.columns[0], b.columns[0]
    return x.select(F.col(ka).alias("a"), F.col("pos").alias("a_pos"), "gram").join(y.select(F.col(kb).alias("b"), F.col("pos").alias("b_pos"), "gram"), "gram")


def increasing(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Longest chain of pairs ascending on both sides (strictly on the second)."""
    tails: list[float] = []
    ends: list[int] = []
    back: list[int] = []
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for i, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tails, y)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            ends.append(i)
        else:
            tails[at], ends[at] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def chained(found: DataFrame, group: str) -> DataFrame:
    """(group, o, n): the longest chain of anchors (group, o, n) that ascends in n and strictly in o, of each group; equally long chains end lowest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = increasing(list(zip(rows["n"], rows["o"])))
        return pd.DataFrame([(rows[group].iloc[0], o, n) for n, o in kept], columns=[group, "o", "n"])

    return found.groupBy(group).applyInPandas(run, found.select(group, "o", "n").schema)


def warp(times: DataFrame, anchors_: DataFrame, group: str, at: str) -> DataFrame:
    """Map times by linear interpolation between the anchors (o, n) around them; outside, the nearest anchor's shift.

    Times and anchors are sorted together once per group; no pair of them is formed.
    """
    both = times.select(group, F.col(at).alias("t"), F.lit(None).cast("double").alias("n"), F.lit(1).alias("ask")).unionByName(
        anchors_.select(group, F.col("o").alias("t"), "n", F.lit(0).alias("ask"))
    )
    w = Window.partitionBy(group).orderBy("t", "ask")
    at_anchor = F.when(F.col("ask") == 0, F.struct("t", "n"))
    both = both.withColumn("lo", F.last(at_anchor, True).over(w)).withColumn("hi", F.first(at_anchor, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    inside = F.col("lo.n") + (F.col("t") - F.col("lo.t")) * (F.col("hi.n") - F.col("lo.n")) / (F.col("hi.t") - F.col("lo.t"))
    shift = F.when(F.col("lo").isNull(), F.col("t") + F.col("hi.n") - F.col("hi.t")).when(F.col("hi").isNull() | (F.col("hi.t") == F.col("lo.t")), F.col("t") + F.col("lo.n") - F.col("lo.t")).otherwise(inside)
    return both.filter("ask = 1").select(group, F.col("t").alias(at), shift.alias("warped"))


def gram_similarity(a: DataFrame, b: DataFrame, common: float = 0.3, rows: DataFrame | None = None) -> DataFrame:
    """(a, b, score): IDF-weighted share of a's distinct grams that b has; grams in more than common of b's rows are left out.

    rows has one row with n, the number of b's rows that have a gram; without it they are counted from the grams.
    """
    ka, kb = a.columns[0], b.columns[0]
    n = F.broadcast(b.agg(F.countDistinct(kb).alias("n")) if rows is None else rows)  # one row
    y = among(b, a).select(F.col(kb).alias("b"), F.xxhash64("gram").alias("gram")).distinct()
    df = y.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(n).filter(F.col("df") <= common * F.col("n")).select("gram", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    x = a.select(F.col(ka).alias("a"), F.xxhash64("gram").alias("gram")).distinct().join(df, "gram")
    total = x.groupBy("a").agg(F.sum("idf").alias("total"))
    hit = x.join(y, "gram").groupBy("a", "b").agg(F.sum("idf").alias("hit"))
    return hit.join(total, "a").select("a", "b", (F.col("hit") / F.col("total")).alias("score"))
