"""Course-level operators: textbook linking, chapter affinity, reports, trees of a lecture, query preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkg.operators.graph import cut


def link_entities(rows: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """rows with column linked: the registry's (full, zh, en) entry by full name, else by zh, else by en, ignoring case."""
    keys = registry.select("full", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("full").alias("k")), F.struct(F.lit(2).alias("p"), F.col("zh").alias("k")), F.struct(F.lit(3).alias("p"), F.col("en").alias("k")))).alias("x"))
    keys = keys.select("full", "x.p", F.lower("x.k").alias("k")).filter("k <> ''").groupBy("k").agg(F.min_by("full", F.struct("p", "full")).alias("linked"))
    return rows.join(keys, F.lower(F.trim(name)) == F.col("k"), "left").drop("k")


def chapter_keywords(title: Column) -> Column:
    """Words of a chapter title of two characters or more, its number left out."""
    bare = F.trim(F.regexp_replace(title, r"^(第\s*\d+\s*章|(?i:chapter)\s*\d+[.:]?)\s*", ""))
    return F.filter(F.array_distinct(F.concat(F.array(bare), F.split(bare, r"[与和及、,，/\s]+"))), lambda k: F.length(k) >= 2)


def toc_scores(items: DataFrame, nodes: DataFrame, least: float = 10.0, max_broadcast: int = 10_000) -> DataFrame:
    """(name, score): the summed scores of table-of-contents items (text, score) that a node's name lies in.

    Names are met by substring_join().  max_broadcast is kept for callers and has no effect.
    """
    hit = substring_join(items, nodes, "text", "name")
    return hit.groupBy("name").agg(F.sum("score").alias("score")).filter(F.col("score") >= least)


def substring_join(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Rows of texts and names where the text holds the name, names of any length and number.

    Both sides meet in an equi-join: a name under its first two characters (a name of one
    under that one, an empty one under the empty key of every text), a text under each of
    its distinct ones; then the whole name is looked for.
    """
    t, letters = F.col(text), F.split(F.col(text), "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.lit(0), F.size(letters) - 1)), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    keys = F.concat(F.array(F.lit("")), letters, pairs)
    starts = names.select(F.substring(name, 1, 2).alias("_g")).distinct()
    # Keys go without their text; the text is met again by its hash, and the test below settles what a hash cannot.
    # A text's keys are made distinct in its row, so that no row of a letter is shuffled.
    met = texts.select(F.xxhash64(text).alias("_h"), F.explode(F.array_distinct(keys)).alias("_g")).join(starts, "_g").distinct()
    found = names.withColumn("_g", F.substring(name, 1, 2)).join(met, "_g").drop("_g")
    return texts.withColumn("_h", F.xxhash64(text)).join(found, "_h").filter(t.contains(F.col(name))).drop("_h")


def current_chapter(lines: DataFrame, order: str, heading: Column, group: str) -> DataFrame:
    """Each line with the last heading at or before it in its document."""
    w = Window.partitionBy(group).orderBy(order)
    return lines.withColumn("chapter", F.last(F.when(heading, F.col("text")), True).over(w))


def evaluation_rates(rows: DataFrame, group: str) -> DataFrame:
    """Hit, supported and partial rates of answered questions (hit boolean, verdict string)."""
    share = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    return rows.groupBy(group).agg(F.count("*").alias("n"), share(F.col("hit"), "hit_rate"), share(F.col("verdict") == "supported", "supported"), share(F.col("verdict") == "partial", "partial"))


def assign_capped(scores: DataFrame, cap: Column, least: float = 0.0) -> DataFrame:
    """(triplet, cue) of scored (lecture, triplet, cue, score): each triplet goes to its best cue, each cue keeps its cap best."""
    best = Window.partitionBy("lecture", "triplet").orderBy(F.desc("score"), "cue")
    own = scores.filter(F.col("score") > least).withColumn("_i", F.row_number().over(best)).filter("_i = 1")
    room = Window.partitionBy("lecture", "cue").orderBy(F.desc("score"), "triplet")
    return own.withColumn("_i", F.row_number().over(room)).filter(F.col("_i") <= cap).drop("_i")


def snippets(provenance: Column, n: int = 3, context: int = 300, source: int = 500) -> Column:
    """Distinct texts of the first n provenance records, contexts and sources cut to their lengths."""
    first = F.slice(provenance, 1, n)
    texts = F.flatten(F.transform(first, lambda p: F.array(F.substring(p["context"], 1, context), F.substring(p["source_text"], 1, source))))
    return F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != "")))


def prune_tree(rows: DataFrame, max_depth: int, max_children: int) -> DataFrame:
    """Tree rows (path, parent, depth, importance) with at most max_children a node and max_depth levels, whole branches kept or cut."""
    w = Window.partitionBy("parent").orderBy(F.desc("importance"), "path")
    kept = rows.filter(F.col("depth") <= max_depth).withColumn("_i", F.row_number().over(w)).filter((F.col("_i") <= max_children) | (F.col("depth") == 0)).drop("_i")
    for d in range(1, max_depth + 1):  # a node goes with its parent
        ok = kept.filter(F.col("depth") == d - 1).select(F.col("path").alias("_p"))
        kept = kept.filter(F.col("depth") != d).unionByName(kept.filter(F.col("depth") == d).join(ok, F.col("parent") == F.col("_p"), "left_semi"))
    return kept


# What a relation says of itself, and verbs of a description in order, as (verb, phrase).
PHRASES = {"part_of": "属于", "belong_to": "属于", "depend_on": "依赖", "synonym_of": "同义于", "property_of": "具有属性", "related_with": "相关"}
VERBS = "称为 称为 也叫 称为 又称为 称为 等同于 等同于 等价于 等价于 是基础 是基础 依赖于 依赖 依赖 依赖 包含 包含 划分为 划分为 细分为 细分为 属于 属于 具有 具有 表示 表示 推出 推出 扩展 扩展".split()


def concrete_relation(description: Column, predicate: Column) -> Column:
    """A short description itself (8 characters, no closing mark), else the phrase of its first listed verb, else the relation's own phrase."""
    text = F.trim(F.coalesce(description, F.lit("")))
    own = F.coalesce(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[predicate], F.lit("相关"))
    verb = F.coalesce(*[F.when(text.contains(v), p) for v, p in zip(VERBS[::2], VERBS[1::2])], own)
    return F.when(text == "", own).when((F.length(text) <= 8) & ~text.rlike("[。；;]"), text).otherwise(verb)


def importance_lookup(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """asked (name, ...) with score: its own, else the smallest name's with the same part before the slash, else 0."""
    zh = lambda c: F.trim(F.split(F.coalesce(c, F.lit("")), "/")[0])
    own = scores.groupBy("name").agg(F.max("score").alias("_own"))
    near = own.withColumn("_zh", zh(F.col("name"))).filter("_zh <> ''").groupBy("_zh").agg(F.min_by("_own", "name").alias("_near"))
    out = asked.join(own, "name", "left").withColumn("_zh", zh(F.col("name"))).join(near, "_zh", "left")
    return out.withColumn("score", F.coalesce("_own", "_near", F.lit(0.0))).drop("_own", "_near", "_zh")


def id_redirects(existing: DataFrame, merges: DataFrame, kept: DataFrame) -> DataFrame:
    """(src, dst): ids that are gone, with the kept id that their chain of redirects (src, dst) ends in; later merges replace existing ones.

    Chains are followed by doubling until they are longer than there are redirects; those
    that run in a circle or end in nothing that is kept give no row.
    """
    fine = "src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> '' AND src <> dst"
    both = existing.select("src", "dst", F.lit(0).alias("o")).unionByName(merges.select("src", "dst", F.lit(1).alias("o"))).filter(fine)
    step = both.groupBy("src").agg(F.max_by("dst", F.struct("o", "dst")).alias("dst"))
    stays = kept.select(F.col("id").alias("src")).distinct()
    step = cut(step.join(stays, "src", "left_anti"))
    for _ in range(step.count().bit_length() + 1):
        step = cut(step.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("_next")), "dst", "left").select("src", F.coalesce("_next", "dst").alias("dst")))
    return step.join(stays.withColumnRenamed("src", "dst"), "dst", "left_semi").filter("NOT startswith(src, '__')").select("src", "dst")


def text_slices(spans: DataFrame, windows: DataFrame, group: str) -> DataFrame:
    """(group, slot, text): of each span (group, start_sec, end_sec, text) the share that its overlap with a window (group, slot, s, e) has in time, in order."""
    both = spans.join(windows, group).filter((F.col("end_sec") > F.col("s")) & (F.col("start_sec") < F.col("e")) & (F.col("text") != ""))
    long = F.greatest(F.lit(1e-6), F.col("end_sec") - F.col("start_sec"))
    a = F.floor(F.length("text") * F.greatest(F.lit(0.0), (F.col("s") - F.col("start_sec")) / long)).cast("int")
    b = F.ceil(F.length("text") * F.least(F.lit(1.0), (F.col("e") - F.col("start_sec")) / long)).cast("int")
    part = F.col("text").substr(a + 1, F.greatest(F.lit(0), b - a))
    rows = both.groupBy(group, "slot").agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", part.alias("t")))).alias("x"))
    return rows.select(group, "slot", F.array_join(F.transform("x", lambda r: r["t"]), "").alias("text"))


def may_reuse(stored: Column, expected: Column, adopt_missing: bool = True) -> Column:
    """Whether an artifact's stored marks (a map, null if there are none) hold all expected ones; without any, whether it is adopted."""
    holds = F.forall(F.map_entries(expected), lambda e: F.coalesce(F.get(F.map_values(F.map_filter(stored, lambda k, v: k == e["key"])), F.lit(0)) == e["value"], F.lit(False)))
    return F.when(stored.isNull(), F.lit(adopt_missing)).otherwise(holds)
