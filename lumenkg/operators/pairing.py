"""One-to-one choices between two sides, by rounds of joins: lectures for videos, aliases for names, entities for cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkg.operators.course import substring_join
from lumenkg.operators.graph import cut

# What a second choice needs, what makes a match sure (score, margin), and names too general to link to.
ENOUGH = 80
SURE = {"high": (150, 1.5), "medium": (80, 1.15)}
HUBS = "图论 理论 化学 陆地 方法性强 算法 离散数学 数理逻辑 集合论".split() + ["Graph Theory"]


def chosen_lectures(scores: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """(video, lecture, held) of scores (video, lecture, score): videos choose in order of their best score, each its best lecture that is left.

    Ties go to the larger video and the smaller lecture.  Another than the first choice needs a score of enough; a video
    that finds none keeps its first choice without holding it.  Choosing in turn is the same as asking in
    rounds: every video asks its next choice, a lecture keeps the foremost video that ever asked it, and the
    others ask on.  So a round is two aggregations, and no list of videos is on the driver.
    """
    wish = F.struct((-F.col("score")).alias("s"), "lecture").alias("wish")
    options = cut(scores.select("video", wish))
    first = options.groupBy("video").agg(F.min("wish").alias("wish"))
    asks = cut(first.select("video", F.struct((-F.col("wish.s")).alias("best"), "video").alias("rank"), "wish"))
    while True:
        kept = asks.groupBy(F.col("wish.lecture").alias("lecture")).agg(F.max("rank").alias("kept"))
        turned = cut(asks.join(kept, F.col("wish.lecture") == F.col("lecture")).filter("rank < kept").select("video", "rank", "wish"))
        if turned.isEmpty():
            held = asks.select("video", "wish.lecture")
            out = first.select("video", F.col("wish.lecture").alias("_first")).join(held, "video", "left")
            return out.select("video", F.coalesce("lecture", "_first").alias("lecture"), F.col("lecture").isNotNull().alias("held"))
        later = options.join(turned.select("video", "rank", F.col("wish").alias("_old")), "video").filter((F.col("wish") > F.col("_old")) & (-F.col("wish.s") >= enough))
        moved = later.groupBy("video", "rank").agg(F.min("wish").alias("wish"))
        asks = cut(asks.join(turned, "video", "left_anti").unionByName(moved.select("video", "rank", "wish")))


def lecture_matches(scores: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """chosen_lectures() with score, runner_up, margin (over the best other lecture) and confidence."""
    chosen = cut(chosen_lectures(scores, enough))
    others = scores.join(chosen.select("video", F.col("lecture").alias("_own")), "video")
    best = others.groupBy("video").agg(
        F.max(F.when(F.col("lecture") == F.col("_own"), F.col("score"))).alias("score"), F.min(F.when(F.col("lecture") != F.col("_own"), F.struct((-F.col("score")).alias("s"), "lecture"))).alias("o")
    )
    margin = F.round(F.col("score") / F.greatest(F.lit(1), -F.coalesce("o.s", F.lit(0))), 2)
    sure = F.lit("low")
    for name, (score, least) in reversed(SURE.items()):
        sure = F.when((F.col("score") >= score) & (F.col("margin") >= least), name).otherwise(sure)
    return chosen.join(best, "video").select("video", "lecture", "held", "score", F.col("o.lecture").alias("runner_up"), margin.alias("margin")).withColumn("confidence", sure)


def absorbed_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): of pairs, the most similar first, those where neither name is absorbed yet; b is absorbed then.  Ties go to the smaller a, then b.

    In each round all pairs are taken that come before every other open pair that would absorb one of
    their names, and the pairs behind them that hold a name so absorbed go.  The foremost open pair is always among them.
    """
    order = F.struct((-F.col("similarity")).alias("s"), "a", "b").alias("at")
    left = cut(pairs.filter("a <> b").select("a", "b", "similarity", order))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        foremost = left.groupBy(F.col("b").alias("name")).agg(F.min("at").alias("first"))
        met = left.join(foremost.select(F.col("name").alias("b"), F.col("first").alias("_b")), "b").filter("at = _b")
        met = met.join(foremost.select(F.col("name").alias("a"), F.col("first").alias("_a")), "a", "left").filter("_a IS NULL OR at < _a")
        taken.append(cut(met.select("a", "b", "similarity", "at")))
        gone = taken[-1].select(F.col("b").alias("name"), F.col("at").alias("since"))
        for end in ("a", "b"):
            left = left.join(gone, (left[end] == gone["name"]) & (left["at"] >= gone["since"]), "left_anti")
        left = cut(left)
    out = pairs.select("a", "b", "similarity").limit(0)
    for part in taken:
        out = out.unionByName(part.drop("at"))
    return out


def without_subsumed(ranked: DataFrame) -> DataFrame:
    """ranked (card, entity, zh, ...) without names of two characters or more that another name of the same card holds."""
    other = ranked.select("card", F.col("zh").alias("_zh")).distinct()
    inside = (F.length("zh") >= 2) & (F.col("zh") != F.col("_zh")) & F.contains("_zh", "zh")
    held = ranked.select("card", "zh").distinct().join(other, "card").filter(inside).select("card", "zh").distinct()
    return ranked.join(held, ["card", "zh"], "left_anti")


def relinked_cards(cards: DataFrame, entities: DataFrame, k: int = 2, least: float = 0.45, overlap: Column | None = None) -> DataFrame:
    """(card, entity, score, place): cards (card, name, text) linked to the k best entities (entity, zh) that they name.

    A name in the card's own name counts .85, in its text .55, overlap (over both sides' columns, 0 to 1) up to .15 more; names too
    general, outside the card's name, count less; names that a longer linked name holds go before the k best are taken.
    """
    names = entities.filter(F.length("zh") >= 2)
    met = substring_join(cards.withColumn("_all", F.concat_ws(" ", "name", "text")), names, "_all", "zh")
    in_name = F.col("name").contains(F.col("zh"))
    score = F.when(in_name, 0.85).otherwise(0.55) + F.least(F.lit(0.15), F.lit(0.25) * (F.lit(0.0) if overlap is None else overlap))
    scored = met.withColumn("score", F.when(F.col("zh").isin(HUBS) & ~in_name, score * 0.4).otherwise(score)).filter(F.col("score") >= least)
    best = Window.partitionBy("card").orderBy(F.desc("score"), "entity")
    placed = without_subsumed(scored.select("card", "entity", "zh", "score").distinct()).withColumn("place", F.row_number().over(best))
    return placed.filter(F.col("place") <= k).select("card", "entity", "score", "place")
