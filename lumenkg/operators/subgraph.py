"""The part of a graph that a text is about, for many texts at once: seeds, edges beside them, selection, scores, limit, merged names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkg.functions.text import clean_text
from lumenkg.operators.graph import cut
from lumenkg.operators.scoring import relation_score

#: What a relation weighs in a score; others weigh 1.
RELATION_WEIGHTS = {"part_of": 3.0, "belong_to": 3.0, "depend_on": 2.0, "property_of": 1.5, "synonym_of": 1.2, "related_with": 1.0}


def merged_names(rows: DataFrame, aliases: DataFrame | None, *columns: str) -> DataFrame:
    """rows with the named columns replaced by the canonical name of their value, where aliases (alias, canonical) has one."""
    for c in columns if aliases is not None else ():
        other = aliases.select(F.col("alias").alias(c), F.col("canonical").alias("_canonical"))
        rows = rows.join(other, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
    return rows


def capped_seeds(seeds: DataFrame, importance: DataFrame, most: int = 40) -> DataFrame:
    """(qid, node) of at most so many seeds (qid, node, matched) a text: longest match first, then importance, then name."""
    own = seeds.groupBy("qid", "node").agg(F.max("matched").alias("matched")).join(importance, "node", "left")
    w = Window.partitionBy("qid").orderBy(F.desc("matched"), F.desc(F.coalesce("importance", F.lit(0.0))), "node")
    return own.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most).select("qid", "node")


def selected_pairs(edges: DataFrame, seeds: DataFrame, pool: DataFrame, both_in_pool: bool = True) -> DataFrame:
    """(qid, node, other, other_seed, in_pool): a seed and a neighbour whose edges, in either direction, belong to the text.

    Those are pairs whose ends both lie in the pool (qid, node), and bridges: a node that is no seed and has edges to two seeds
    or more, whether in the pool or not.  Without both_in_pool every pair stays.

    Neighbours of a seed are found by pair, not by edge, and meet once by text and neighbour; such a group has no more rows
    than the text has seeds.
    """
    pairs = edges.select(F.explode(F.array(F.struct(F.col("subject").alias("node"), F.col("object").alias("other")), F.struct(F.col("object").alias("node"), F.col("subject").alias("other")))).alias("p"))
    near = pairs.select("p.*").distinct().join(seeds, "node").select("qid", "node", "other")
    marks = pool.select("qid", "node", F.lit(True).alias("p"), F.lit(False).alias("s")).unionByName(seeds.select("qid", "node", F.lit(False).alias("p"), F.lit(True).alias("s")))
    marks = marks.groupBy("qid", "node").agg(F.max("p").alias("p"), F.max("s").alias("s"))
    w = Window.partitionBy("qid", "other")
    near = near.withColumn("several", F.min("node").over(w) < F.max("node").over(w))  # two different seeds, without counting them
    near = near.join(marks.select("qid", F.col("node").alias("other"), F.col("p").alias("other_pool"), F.col("s").alias("other_seed")), ["qid", "other"], "left")
    near = near.join(marks.select("qid", "node", F.col("p").alias("node_pool")), ["qid", "node"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = near.select("qid", "node", "other", "several", no("other_seed").alias("other_seed"), (no("node_pool") & no("other_pool")).alias("in_pool"))
    return (rows.filter(F.col("in_pool") | F.col("several") & ~F.col("other_seed")) if both_in_pool else rows).drop("several")


def pooled_pairs(seeds: DataFrame, pool: DataFrame) -> DataFrame:
    """selected_pairs() whose ends both lie in the pool, from the pool itself; that an edge joins them is for scored_edges() to find."""
    own = pool.select("qid", "node").distinct()
    rows = seeds.join(own, ["qid", "node"], "left_semi").join(own.select("qid", F.col("node").alias("other")), "qid")
    return _with_seeds(rows, seeds, F.lit(True))


def _with_seeds(pairs: DataFrame, seeds: DataFrame, in_pool: Column) -> DataFrame:
    rows = pairs.join(seeds.select("qid", F.col("node").alias("other"), F.lit(True).alias("_s")), ["qid", "other"], "left")
    return rows.select("qid", "node", "other", F.coalesce("_s", F.lit(False)).alias("other_seed"), in_pool.alias("in_pool"))


def rated_edges(edges: DataFrame, importance: DataFrame) -> DataFrame:
    """edges with what of a score depends on them alone: weight, worth (importance of both ends) and the cleaned texts about them."""
    more = [c for c in ("context", "description") if c in edges.columns]
    rows = edges.select("subject", "relation", "object", F.transform(F.array(*more).cast("array<string>"), lambda x: clean_text(F.coalesce(x, F.lit("")))).alias("about"))
    for end in ("subject", "object"):
        rows = rows.join(importance.select(F.col("node").alias(end), F.col("importance").alias(f"_i_{end}")), end, "left")
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in RELATION_WEIGHTS.items() for x in pair])[F.col("relation")], F.lit(1.0))
    worth = F.coalesce("_i_subject", F.lit(0.0)) + F.coalesce("_i_object", F.lit(0.0))
    return rows.select("subject", "relation", "object", weight.alias("weight"), worth.alias("worth"), F.filter("about", lambda x: x != "").alias("about"))


def _names(c: Column) -> Column:
    """The cleaned name and what of it stands before or after a slash, of two characters or more."""
    return F.filter(F.transform(F.concat(F.split(c, "/"), F.array(c)), clean_text), lambda x: F.length(x) >= 2)


def _cleaned(texts: DataFrame) -> DataFrame:
    return texts.select("qid", clean_text(F.coalesce("text", F.lit(""))).alias("_text"))


def scored_edges(pairs: DataFrame, rated: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, subject, relation, object, in_pool, score) of the edges of pairs (qid, node, other, other_seed, in_pool).

    The score adds relation weight, seed ends, text hits of both ends, context and description, mentions (a name, or what
    stands before or after a slash in it, of two characters or more) and the importance of both ends.
    """
    ahead = pairs.select("qid", F.col("node").alias("subject"), F.col("other").alias("object"), "other_seed", "in_pool")
    back = pairs.filter("node <> other AND NOT other_seed")  # between two seeds an edge is found from both
    back = back.select("qid", F.col("other").alias("subject"), F.col("node").alias("object"), "other_seed", "in_pool")
    found = ahead.unionByName(back).join(rated, ["subject", "object"])
    found = found.join(_cleaned(texts), "qid", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    inside, one = (lambda x: F.col("_text").contains(x)), lambda c: c.cast("int")
    held = F.concat(F.filter(F.array(clean_text(F.col("subject")), clean_text(F.col("object"))), lambda x: x != ""), "about")
    named = one(F.exists(_names(F.col("subject")), inside)) + one(F.exists(_names(F.col("object")), inside))
    score = relation_score(F.col("weight"), 1 + one(F.col("other_seed")), F.size(F.filter(held, inside)), named, F.col("worth"), F.lit(0), F.lit(False))
    return found.select("qid", "subject", "relation", "object", "in_pool", F.round(score, 6).alias("score"))


def held_phrases(texts: DataFrame, phrases: DataFrame, most: int = 8) -> DataFrame:
    """(qid, phrase) of cleaned texts (qid, _text) that hold a phrase; both meet under its first most characters, or all of it."""
    key = phrases.select("phrase").distinct().withColumn("_k", F.substring("phrase", 1, most))
    lengths = sorted(r[0] for r in key.select(F.length("_k").alias("n")).distinct().collect() if r[0])  # most values at most
    cuts = lambda n: F.when(F.length("_text") >= n, F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda i: F.col("_text").substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.flatten(F.array(F.array().cast("array<string>"), *map(cuts, lengths))))
    met = texts.select("qid", F.explode(parts).alias("_k")).join(key, "_k")
    long = met.filter(F.length("phrase") > most).join(texts, "qid").filter(F.col("_text").contains(F.col("phrase"))).select("qid", "phrase")
    return met.filter(F.length("phrase") <= most).select("qid", "phrase").unionByName(long).distinct()


def first_edges_of(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of the edges (weight, worth, subject, relation, object) under each key all that can be among the most best in a score that adds the same to each.

    Edges of equal weight and worth have equal scores and follow each other by name.  Scores are rounded
    to six digits, so what lies closer than that below the last one stays.
    """
    alike = Window.partitionBy(*keys, "weight", "worth").orderBy("subject", "relation", "object")
    rows = rows.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= most).drop("_n")
    own, best = Window.partitionBy(*keys), F.col("weight") + 10.0 * F.col("worth")
    rows = rows.withColumn("_b", best).withColumn("_n", F.row_number().over(own.orderBy(F.desc("_b"))))
    return rows.withColumn("_least", F.min(F.when(F.col("_n") <= most, F.col("_b"))).over(own)).filter(F.col("_b") >= F.col("_least") - 2e-6).drop("_b", "_n", "_least")


def beside(rated: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, rated columns) of edges at the given nodes, found from either end."""
    ahead = rated.select(F.col("subject").alias("node"), F.col("object").alias("other"), "*")
    back = rated.filter("subject <> object").select(F.col("object").alias("node"), F.col("subject").alias("other"), "*")
    return ahead.unionByName(back).join(nodes.select("node").distinct(), "node", "left_semi")


def named_pairs(rated: DataFrame, seeds: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, node, other) of a seed and a node that the text names or that is a seed itself."""
    ends = rated.select(F.explode(F.array("subject", "object")).alias("other")).distinct()
    names = ends.select("other", F.explode(F.concat(_names(F.col("other")), F.array(clean_text(F.col("other"))))).alias("phrase")).filter("phrase <> ''").distinct()
    named = held_phrases(_cleaned(texts), names).join(names, "phrase").select("qid", "other").distinct()
    return seeds.join(named.unionByName(seeds.select("qid", F.col("node").alias("other"))), "qid").distinct()


def held_abouts(rated: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, about, said): what is said about edges and the text holds a part of; said is its number."""
    every = cut(rated.filter("size(about) > 0").select("about").distinct())
    held = cut(held_phrases(_cleaned(texts), every.select(F.explode("about").alias("phrase"))))
    held = held.join(every.select("about", F.explode("about").alias("phrase")), "phrase").select("qid", "about").distinct()
    numbers = held.select("about").distinct().rdd.map(lambda r: list(r[0])).zipWithIndex()
    return cut(held.join(rated.sparkSession.createDataFrame(numbers, "about array<string>, said long"), "about"))


def _own_score(seeds: DataFrame, lists: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """(qid, subject, relation, object, score) of lists at seeds: what an edge scores if of its other end and what is said about it the text holds nothing."""
    inside = lambda x: F.col("_text").contains(x)
    own = seeds.join(_cleaned(texts), "qid", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    whole = clean_text(F.col("node"))
    own = own.select(*seeds.columns, (inside(whole) & (whole != "")).cast("int").alias("_hit"), F.exists(_names(F.col("node")), inside).cast("int").alias("_named"))
    score = relation_score(F.col("weight"), F.lit(1), F.col("_hit"), F.col("_named"), F.col("worth"), F.lit(0), F.lit(False))
    return own.join(lists, on).select("qid", "subject", "relation", "object", F.round(score, 6).alias("score"))


def best_beside(rated: DataFrame, seeds: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """(qid, subject, relation, object, score): edges beside seeds, among them the limit best of each text.

    A seed gives the same to all its edges, so those of its edges that the text says nothing more of come
    in one order for every text, and no text needs more than the first limit of them.  Edges that it says more of are sought by what it says.
    """
    listed = _own_score(seeds, first_edges_of(beside(rated, seeds), ["node"], limit), texts, ["node"])
    held, pairs = held_abouts(rated, texts), named_pairs(rated, seeds, texts)
    said = first_edges_of(beside(rated.join(held.select("about", "said").distinct(), "about"), seeds), ["node", "said"], limit)
    pairs = pairs.unionByName(seeds.join(held, "qid").join(said.select("node", "other", "said").distinct(), ["node", "said"]).select("qid", "node", "other")).distinct()
    telling = scored_edges(_with_seeds(pairs, seeds, F.lit(False)), rated, texts)
    return listed.unionByName(telling.drop("in_pool")).groupBy("qid", "subject", "relation", "object").agg(F.max("score").alias("score"))


#: Neighbours of a seed up to which a text takes them all; a seed with more is a hub.
HUB = 1000


def seed_bridges(near: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, node, other) of near whose neighbour is no seed and lies beside two seeds or more."""
    w = Window.partitionBy("qid", "other")
    rows = near.withColumn("_several", F.min("node").over(w) < F.max("node").over(w)).filter("_several").drop("_several")
    return rows.join(seeds.select("qid", F.col("node").alias("other")), ["qid", "other"], "left_anti").select("qid", "node", "other")


def hub_lists(rows: DataFrame, pairs: DataFrame, most: int, slice_rows: int = 200_000) -> DataFrame:
    """first_edges_of() for every pair (node, mate) of hubs, among the edges (beside(), said) of node whose other end is beside mate, too; and as many of each said.

    A hub's neighbours become bits under their numbers.  The edges of a hub, slice by slice, meet the bits of its
    mates in a group of its own, so that no pair of hubs is joined edge by edge.
    """
    spark = rows.sparkSession
    others = rows.select("other").distinct()
    numbers = cut(spark.createDataFrame(others.rdd.map(lambda r: r[0]).zipWithIndex(), "other string, i long"))
    rows = cut(rows.join(numbers, "other").withColumn("best", F.col("weight") + 10.0 * F.col("worth")))

    def as_bits(group: pa.Table) -> pa.Table:
        bits = np.zeros(int(pc.max(group.column("i")).as_py()) + 1, bool)
        bits[group.column("i").to_numpy()] = True
        return pa.table({"mate": group.column("node").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bits = cut(rows.select("node", "i").distinct().groupBy("node").applyInArrow(as_bits, "mate string, bits binary"))
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / slice_rows).alias("_parts"))
    sliced = rows.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("subject", "relation", "object"), "_parts")).drop("_parts")
    mates = pairs.join(bits, "mate").join(sizes, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).select("node", "part", "mate", "bits")

    def first(edges: pa.Table, beside: pa.Table) -> pa.Table:
        out = []
        edges = edges.sort_by([("best", "descending"), ("weight", "ascending"), ("worth", "ascending"), ("subject", "ascending"), ("relation", "ascending"), ("object", "ascending")])
        i, best = (edges.column(c).to_numpy() for c in ("i", "best"))
        alike = np.flatnonzero((np.diff(edges.column("weight").to_numpy(), prepend=-1) != 0) | (np.diff(edges.column("worth").to_numpy(), prepend=-1) != 0))
        kind = np.searchsorted(alike, np.arange(len(i)), "right")  # runs of equal weight and worth
        said = edges.column("said").fill_null(-1).to_numpy()
        kinds = np.unique(said[said >= 0])

        def best_of(met: np.ndarray) -> np.ndarray:
            run = kind[met]
            met = met[np.arange(len(met)) - np.searchsorted(run, run) < most]  # the first of each run
            return met[best[met] >= best[met[min(most, len(met)) - 1]] - 2e-6] if len(met) else met

        for mate, packed in zip(beside.column("mate").to_pylist(), beside.column("bits").to_pylist()):
            have = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            met = np.flatnonzero(np.where(i < len(have), have[np.minimum(i, len(have) - 1)], False))
            met = np.unique(np.concatenate([best_of(met), *(best_of(met[said[met] == k]) for k in kinds)]))
            out.append(edges.take(pa.array(met, pa.int64())).append_column("mate", pa.array([mate] * len(met), pa.string())).select(names))
        return pa.concat_tables(out) if out else empty

    schema = rows.select("node", F.lit("").alias("mate"), "other", "subject", "relation", "object", "weight", "worth", "said").schema
    kinds = {"weight": pa.float64(), "worth": pa.float64(), "said": pa.int64()}
    names, empty = schema.names, pa.table({f.name: pa.array([], kinds.get(f.name, pa.string())) for f in schema})
    edges = sliced.select("node", "part", "i", "best", "subject", "relation", "object", "other", "weight", "worth", "said")
    return edges.groupBy("node", "part").cogroup(mates.groupBy("node", "part")).applyInArrow(first, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


def best_bridges(rated: DataFrame, seeds: DataFrame, pool: DataFrame, texts: DataFrame, limit: int, most_seeds: int, hub: int = HUB) -> DataFrame:
    """(qid, subject, relation, object, in_pool, score): edges of selected_pairs(), among them the limit best of each text.

    Pairs inside the pool come from the pool.  Of bridges, those beside a seed that is no hub are found from its neighbours,
    of which there are few, and the hubs that these lie beside; those between hubs from one list a pair of hubs,
    and those that the text says more of by what it says.
    """
    inside = pooled_pairs(seeds, pool)
    edges = beside(rated, seeds)
    near = cut(edges.select("node", "other").distinct())
    hubs = cut(near.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("node"))
    few = seeds.join(hubs, "node", "left_anti").join(near, "node").select("qid", "node", "other")
    if hubs.isEmpty():
        return scored_edges(_selected(seed_bridges(few, seeds), inside, seeds), rated, texts)
    own = cut(seeds.join(hubs, "node", "left_semi"))
    beside_hubs = cut(near.join(hubs, "node", "left_semi"))
    # A neighbour of a seed that is no hub may lie beside hubs of the text; most lie beside none at all.
    open_ = few.join(beside_hubs.select("other").distinct(), "other", "left_semi").select("qid", "other").distinct()
    from_hubs = open_.join(own, "qid").join(beside_hubs, ["node", "other"], "left_semi").select("qid", "node", "other")
    held, most = held_abouts(rated, texts), limit + most_seeds
    at_hubs = edges.join(hubs, "node", "left_semi").join(held.select("about", "said").distinct(), "about", "left").drop("about")
    two = cut(own.join(own.select("qid", F.col("node").alias("mate")), "qid").filter("node <> mate"))
    lists = cut(hub_lists(at_hubs, two.select("node", "mate").distinct(), most))
    said = first_edges_of(lists.filter("said IS NOT NULL"), ["node", "mate", "said"], most)  # of all slices
    told = two.join(held, "qid").join(said.select("node", "mate", "other", "said").distinct(), ["node", "mate", "said"]).select("qid", "node", "other")
    # What the text says more of, at hubs, and what else of the text's hubs lies there.
    told = named_pairs(rated, own, texts).unionByName(told).select("qid", "other").distinct()
    told = told.join(own, "qid").join(beside_hubs, ["node", "other"], "left_semi").select("qid", "node", "other")
    bridges = seed_bridges(few.unionByName(from_hubs).unionByName(told).distinct(), seeds)
    sure = scored_edges(_selected(bridges, inside, seeds), rated, texts)
    listed = _own_score(two, first_edges_of(lists, ["node", "mate"], most).drop("other", "said"), texts, ["node", "mate"])
    seeded = seeds.select("qid", "node")
    for end in ("subject", "object"):  # no bridge leads from seed to seed; such edges are found above if the pool has them
        listed = listed.join(seeded.select("qid", F.col("node").alias(end), F.lit(1).alias(f"_{end}")), ["qid", end], "left")
    listed = listed.filter("_subject IS NULL OR _object IS NULL").select("qid", "subject", "relation", "object", F.lit(False).alias("in_pool"), "score")
    return sure.unionByName(listed).groupBy("qid", "subject", "relation", "object").agg(F.max("in_pool").alias("in_pool"), F.max("score").alias("score"))


def _selected(bridges: DataFrame, inside: DataFrame, seeds: DataFrame) -> DataFrame:
    rows = _with_seeds(bridges, seeds, F.lit(False)).unionByName(inside)
    return rows.groupBy("qid", "node", "other").agg(F.max("other_seed").alias("other_seed"), F.max("in_pool").alias("in_pool"))


def retrieve_subgraphs(
    edges: DataFrame,
    seeds: DataFrame,
    pool: DataFrame,
    texts: DataFrame,
    importance: DataFrame,
    aliases: DataFrame | None = None,
    most_seeds: int = 40,
    both_in_pool: bool = True,
    min_score: float | None = None,
    limit: int | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(qid, subject, relation, object, score, rank) of the edges that each text is about.

    edges (subject, relation, object, and context and description if there are any), one row a triple; seeds (qid, node,
    matched: length of the match); pool (qid, node): seeds before they were filtered; texts (qid, text);
    importance (node, importance); aliases (alias, canonical), one row an alias.

    In order: names of seeds and pool are merged, seeds capped, edges beside them selected, scored, cut at min_score (then
    bridges out of the pool go too, if both_in_pool), limited to the best (equal scores by subject, relation, object),
    filtered by keep (a hook over rows), and their names merged: loops go, of equal triples the best stays.
    A text without seeds has no row; an unknown seed finds nothing; null names meet nothing.
    """
    seeds, pool = merged_names(seeds, aliases, "node"), merged_names(pool, aliases, "node")
    seeds = cut(capped_seeds(seeds.filter("qid IS NOT NULL AND node IS NOT NULL"), importance, most_seeds))
    rated = cut(rated_edges(edges, importance))
    if both_in_pool and min_score is not None:
        rows = scored_edges(pooled_pairs(seeds, pool), rated, texts)
    elif not both_in_pool and limit is not None:
        rows = best_beside(rated, seeds, texts, limit)
    elif limit is not None:
        rows = best_bridges(rated, seeds, pool, texts, limit, most_seeds)
    else:
        rows = scored_edges(selected_pairs(edges, seeds, pool, both_in_pool), rated, texts)
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    order = [F.desc("score"), "subject", "relation", "object"]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    rows = rows if limit is None else rows.filter(F.col("rank") <= limit)
    rows = rows if keep is None else keep(rows)
    rows = merged_names(rows.select("qid", "subject", "relation", "object", "score", "rank"), aliases, "subject", "object").filter("subject <> object")
    return rows.groupBy("qid", "subject", "relation", "object").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))


def subgraph_entities(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, node, seed): seeds (qid, node) and the ends of found edges."""
    ends = found.select("qid", F.explode(F.array("subject", "object")).alias("node"), F.lit(False).alias("seed"))
    return ends.unionByName(seeds.select("qid", "node", F.lit(True).alias("seed"))).groupBy("qid", "node").agg(F.max("seed").alias("seed"))
