"""Course-level queries over the driver tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.functions import rules as V
from lumenkg.functions import text as T
from lumenkg.operators import course as C
from lumenkg.registry import query
from lumenkg.sources.tables import CUES_SQL, TRIPLETS_SQL, cues, table, triplets


@query("j22_link_entities", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS linked FROM part")
def j22_link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    reg = p.select(F.col("p_type").alias("full"), F.col("p_type").alias("zh"), F.lit("").alias("en")).distinct()
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_type"))).otherwise("no such name")
    return C.link_entities(p.select("p_partkey", name.alias("name")), reg).select("p_partkey", "linked")


@query("x16_chapter_keywords", "SELECT DISTINCT p_type, CASE WHEN length(w) >= 2 THEN w END AS word FROM (SELECT p_type, unnest(list_distinct(list_concat([p_type], string_split(p_type, ' ')))) AS w FROM part) WHERE length(w) >= 2")
def x16_chapter_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_type").distinct()
    return p.select("p_type", F.explode(C.chapter_keywords(F.concat(F.lit("Chapter 3: "), "p_type"))).alias("word"))


@query("j9_toc_scores", "WITH i AS (SELECT p_type AS text, sum(20)::BIGINT AS score FROM part WHERE p_size > 25 GROUP BY p_type), n AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS name FROM part) SELECT name, sum(score)::BIGINT AS score FROM n JOIN i ON contains(text, name) GROUP BY name HAVING sum(score) >= 10")
def j9_toc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    items = p.filter("p_size > 25").groupBy(F.col("p_type").alias("text")).agg(F.sum(F.lit(20)).alias("score"))
    return C.toc_scores(items, p.select(F.explode(F.split("p_type", " ")).alias("name")).distinct())


@query("x30_current_chapter", f"WITH {CUES_SQL} SELECT cue, last_value(CASE WHEN text = 'purchase' THEN text END IGNORE NULLS) OVER (PARTITION BY lecture ORDER BY cue ROWS UNBOUNDED PRECEDING) AS chapter FROM c")
def x30_current_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.current_chapter(cues(spark, sf_dir), "cue", F.col("text") == "purchase", "lecture").select("cue", "chapter")


@query("a17_eval_rates", "SELECT source, count(*) AS n, round(avg((quality = 1)::INT), 6) AS hit_rate, round(avg((toxic = 0)::INT), 6) AS supported, round(avg((toxic = 1)::INT), 6) AS partial FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a17_eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return C.evaluation_rates(j.select("source", (F.col("quality") == 1).alias("hit"), F.when(F.col("toxic") == 0, "supported").otherwise("partial").alias("verdict")), "source")


@query(
    "k10_assign_capped",
    f"""WITH {TRIPLETS_SQL}, b AS (SELECT lecture, object AS triplet, cue, weight AS score FROM t QUALIFY row_number() OVER (PARTITION BY lecture, object ORDER BY weight DESC, cue) = 1)
    SELECT lecture, triplet, cue FROM b QUALIFY row_number() OVER (PARTITION BY lecture, cue ORDER BY score DESC, triplet) <= 1 + cue % 3""",
)
def k10_assign_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = triplets(spark, sf_dir).select("lecture", F.col("object").alias("triplet"), "cue", F.col("weight").alias("score"))
    s = s.groupBy("lecture", "triplet", "cue").agg(F.max("score").alias("score"))
    return C.assign_capped(s, 1 + F.col("cue") % 3).select("lecture", "triplet", "cue")


@query("m6_prune_tree", "WITH b AS (SELECT p_brand, max(p_retailprice) AS i FROM part GROUP BY p_brand), kb AS (SELECT p_brand FROM b ORDER BY i DESC, p_brand LIMIT 8), t AS (SELECT p_brand, p_type, max(p_retailprice) AS i FROM part JOIN kb USING (p_brand) GROUP BY ALL), kt AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY i DESC, p_type) <= 8) SELECT 'root' AS path, 0 AS depth UNION ALL SELECT 'root/' || p_brand, 1 FROM kb UNION ALL SELECT 'root/' || p_brand || '/' || p_type, 2 FROM kt")
def m6_prune_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand, leaf = F.concat(F.lit("root/"), "p_brand"), F.concat(F.lit("root/"), "p_brand", F.lit("/"), "p_type")
    rows = p.agg(F.lit("root").alias("path"), F.lit("").alias("parent"), F.lit(0).alias("depth"), F.max("p_retailprice").alias("importance"))
    for d, (path, parent) in enumerate(((brand, F.lit("root")), (leaf, brand)), 1):
        rows = rows.unionByName(p.groupBy(path.alias("path"), parent.alias("parent")).agg(F.lit(d).alias("depth"), F.max("p_retailprice").alias("importance")))
    return C.prune_tree(rows, 2, 8).select("path", "depth")


@query("x21_snippets", f"WITH {TRIPLETS_SQL}, p AS (SELECT subject, statement, row_number() OVER (PARTITION BY subject ORDER BY row_id) AS i FROM t) SELECT subject, count(DISTINCT left(statement, 6)) AS n FROM p WHERE i <= 3 AND statement <> '' GROUP BY subject")
def x21_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    p = t.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("row_id", F.col("statement").alias("context"), F.lit("").alias("source_text")))).alias("p"))
    return p.select("subject", F.size(C.snippets(F.col("p"), 3, 6)).cast("long").alias("n")).filter("n > 0")


@query("w15_strip_overlap", "WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND length(text) > 8 AND right(prev, 8) = left(text, 8) THEN 8 ELSE 0 END AS n FROM u")
def w15_strip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the repeated start (here of exactly eight characters) that the previous turn ends with."""
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    same = prev.isNotNull() & (F.length("text") > 8) & (F.right(prev, F.lit(8)) == F.left("text", F.lit(8)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(same, 8).otherwise(0).alias("n"))


@query("w15_strip_overlap_full")
def w15_strip_overlap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn without the start, of any length from 8 to 160, that the previous turn ends with."""
    from lumenkg.operators.folds import strip_overlap

    strip = F.udf(lambda t, p: strip_overlap(t, p), "rest string, start string")
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", prev.alias("prev")).withColumn("x", strip("text", "prev"))
    return out.select("conv_id", "turn", F.length("x.start").alias("n"), F.col("x.rest").alias("text"))


@query("f23_infer_relation", "SELECT item_id, CASE WHEN contains(lower(text), ' is ') THEN 'is' WHEN contains(lower(text), ' was ') THEN 'was' WHEN contains(lower(text), ' are ') THEN 'are' ELSE 'relates to' END AS phrase FROM benchmark")
def f23_infer_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the listed verbs that a description holds."""
    t, verbs = F.lower("text"), ("is", "was", "are")
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(*[F.when(t.contains(f" {v} "), v) for v in verbs], F.lit("relates to")).alias("phrase"))


@query("f24_flatten_records", f"WITH {TRIPLETS_SQL}, g AS (SELECT cue, list(row_id ORDER BY row_id) AS rows FROM t GROUP BY cue) SELECT cue, unnest(rows) AS row_id, CASE WHEN cue % 2 = 0 THEN 'textbook' ELSE 'lecture' END AS route FROM g")
def f24_flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = triplets(spark, sf_dir).groupBy("cue").agg(F.collect_list("row_id").alias("rows"))
    return g.select("cue", F.explode("rows").alias("row_id"), F.when(F.col("cue") % 2 == 0, "textbook").otherwise("lecture").alias("route"))


@query("f5_f6_specific_entities", "SELECT DISTINCT tok, regexp_matches(tok, '^(theorem|lemma|example|figure|table|chapter|section)\\s*[0-9]+') AS specific, regexp_matches(tok, '^([a-z](\\s*[,]\\s*[a-z])+|x|none|null)$') AS placeholder FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS tok FROM part UNION ALL SELECT 'theorem 3' UNION ALL SELECT 'a, b' UNION ALL SELECT 'none')")
def f5_f6_specific_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("tok"))
    w = w.unionByName(spark.createDataFrame([("theorem 3",), ("a, b",), ("none",)], "tok string")).distinct()
    return w.select("tok", V.overly_specific(F.col("tok")).alias("specific"), V.placeholder_entity(F.col("tok")).alias("placeholder"))


@query("u2_union_graphs", f"WITH {TRIPLETS_SQL} SELECT subject, relation, object, min(cue) AS cue FROM t GROUP BY subject, relation, object")
def u2_union_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of all cues as one: an edge by subject, relation and object, with its first cue."""
    return triplets(spark, sf_dir).groupBy("subject", "relation", "object").agg(F.min("cue").alias("cue"))


@query("u8_filtered_relations", f"WITH {TRIPLETS_SQL} SELECT row_id, relation <> 'related_with' AS kept FROM t")
def u8_filtered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir).select("row_id", "relation")
    kept = t.filter("relation <> 'related_with'")
    return kept.select("row_id", F.lit(True).alias("kept")).unionByName(t.join(kept, ["row_id", "relation"], "left_anti").select("row_id", F.lit(False).alias("kept")))


@query("q4_q6_best_chapter", "WITH d AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), g AS (SELECT item_id, unnest(list_distinct(w)) AS tok FROM d), s AS (SELECT a.item_id, b.item_id AS chapter, count(*) AS shared FROM g a JOIN g b ON a.tok = b.tok AND a.item_id <> b.item_id GROUP BY ALL) SELECT item_id, arg_min(chapter, (-shared, chapter)) AS chapter FROM s GROUP BY item_id")
def q4_q6_best_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("tok"))
    s = g.join(g.select(F.col("item_id").alias("chapter"), "tok"), "tok").filter("item_id <> chapter").groupBy("item_id", "chapter").agg(F.count("*").alias("shared"))
    return s.groupBy("item_id").agg(F.min_by("chapter", F.struct(-F.col("shared"), F.col("chapter"))).alias("chapter"))


@query("x28_lecture_ordinals", "SELECT event_id, (user_id % 40)::BIGINT AS ordinal FROM events")
def x28_lecture_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("lecture_"), F.col("user_id") % 40)
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(name, r"(\d+)\D*$", 1).cast("long").alias("ordinal"))


@query("x29_text_slice", "SELECT doc_id, substr(text, 1 + floor(length(text) * 0.25)::INT, floor(length(text) * 0.5)::INT) AS part FROM documents")
def x29_text_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a time span, in proportion: from a quarter, for half of the length."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1 + F.floor(n * 0.25).cast("int"), F.floor(n * 0.5).cast("int")).alias("part"))


@query("x22_entity_documents", "SELECT s_suppkey, concat_ws(chr(10), s_name, nullif('', ''), 'nation ' || s_nationkey) AS doc FROM supplier")
def x22_entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\n", "s_name", F.nullif(F.lit(""), F.lit("")), F.concat(F.lit("nation "), "s_nationkey")).alias("doc"))


@query("x19_json_repair", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def x19_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of answers that wrap JSON in a fence and talk: the outermost braces are parsed."""
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    inner = F.regexp_extract(wrapped, r"(?s)\{.*\}", 0)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(inner), "$.k", "int").alias("k"))


@query("i10_fragment_importance", f"WITH {TRIPLETS_SQL} SELECT object AS entity, round(0.75 * ln(1 + count(*)) + 0.25 * ln(1 + count(DISTINCT subject)), 6) AS score FROM t GROUP BY object")
def i10_fragment_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = triplets(spark, sf_dir).groupBy(F.col("object").alias("entity")).agg(F.count("*").alias("m"), F.countDistinct("subject").alias("d"))
    return g.select("entity", F.round(0.75 * F.log1p("m") + 0.25 * F.log1p("d"), 6).alias("score"))


@query("i13_chapter_view", f"WITH {TRIPLETS_SQL}, s AS (SELECT object AS entity, lecture, max(weight) AS score FROM t GROUP BY ALL) SELECT entity, round(sum(score * CASE lecture WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 ELSE 0.1 END), 6)::DOUBLE AS score FROM s GROUP BY entity")
def i13_chapter_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = triplets(spark, sf_dir).groupBy(F.col("object").alias("entity"), "lecture").agg(F.max("weight").alias("score"))
    w = F.when(F.col("lecture") == 0, 0.6).when(F.col("lecture") == 1, 0.3).otherwise(0.1)
    return s.groupBy("entity").agg(F.round(F.sum(F.col("score") * w), 6).alias("score"))


@query("a25_entity_texts", f"WITH {TRIPLETS_SQL}, x AS (SELECT subject AS entity, statement, row_id FROM t UNION ALL SELECT object, statement, row_id FROM t) SELECT entity, count(DISTINCT statement) AS n, arg_min(statement, row_id) AS first FROM x WHERE statement <> '' GROUP BY entity")
def a25_entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkg.operators.kg import endpoints

    x = endpoints(triplets(spark, sf_dir).filter("statement <> ''"), "statement", "row_id")
    return x.groupBy("entity").agg(F.countDistinct("statement").alias("n"), F.min_by("statement", "row_id").alias("first"))


@query("a12_asset_boost", "SELECT w AS entity, max(CASE WHEN p_size % 5 = 0 THEN 1.4 WHEN p_size % 5 = 1 THEN 1.3 ELSE 1.1 END)::DOUBLE AS boost FROM (SELECT p_size, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) GROUP BY w")
def a12_asset_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, 1.4).when(F.col("p_size") % 5 == 1, 1.3).otherwise(1.1)
    names = F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    return table(spark, sf_dir, "part").select(kind.alias("k"), names.alias("entity")).groupBy("entity").agg(F.max("k").alias("boost"))


@query("v7_window_duplicates", f"WITH {TRIPLETS_SQL} SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM t x WHERE x.lecture = t.lecture - 1 AND x.subject = t.subject AND x.relation = t.relation AND x.object = t.object) THEN 'lecture_existing' WHEN row_number() OVER (PARTITION BY lecture, subject, relation, object ORDER BY cue, row_id) > 1 THEN 'window_overlap' END AS reason FROM t")
def v7_window_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lecture's new edges against those of the lecture before it, and against themselves."""
    spo = ["lecture", "subject", "relation", "object"]
    t = triplets(spark, sf_dir)
    known = t.withColumn("lecture", F.col("lecture") + 1).select(*spo).distinct().withColumn("known", F.lit(True))
    i = F.row_number().over(Window.partitionBy(*spo).orderBy("cue", "row_id"))
    new = t.withColumn("i", i).join(known, spo, "left")
    return new.select("row_id", F.when(F.col("known"), "lecture_existing").when(F.col("i") > 1, "window_overlap").alias("reason"))


@query("g15_hop_tags", f"WITH {TRIPLETS_SQL}, g AS (SELECT DISTINCT subject, object FROM t), d0 AS (SELECT 'S1' AS n UNION SELECT 'S2'), e0 AS (SELECT g.* FROM g WHERE subject IN (FROM d0) OR object IN (FROM d0)), d1 AS (SELECT subject AS n FROM e0 UNION SELECT object FROM e0), e1 AS (SELECT g.* FROM g WHERE (subject IN (FROM d1) OR object IN (FROM d1)) EXCEPT FROM e0) SELECT *, 0 AS hop FROM e0 UNION ALL SELECT *, 1 FROM e1")
def g15_hop_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges reached from the seeds in either direction, tagged by the hop that found them."""
    from lumenkg.operators.graph import expand

    e = triplets(spark, sf_dir).select("subject", "object").distinct()
    near = expand(e, spark.createDataFrame([("S1",), ("S2",)], "node string"), 1)
    for end in ("subject", "object"):
        e = e.join(near.select(F.col("node").alias(end), F.col("depth").alias(f"d_{end}")), end, "left")
    return e.select("subject", "object", F.least("d_subject", "d_object").alias("hop")).filter("hop IS NOT NULL")
