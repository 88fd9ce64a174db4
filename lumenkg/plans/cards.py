"""Cards, display graph and remaining projections over the driver tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.functions.text import char_ngrams
from lumenkg.operators import cards as C
from lumenkg.operators import kg as K
from lumenkg.operators.scoring import numbered
from lumenkg.registry import query
from lumenkg.sources.tables import TRIPLETS_SQL, table, triplets
from lumenkg.streaming import ingest


@query("f15_card_errors", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 7 = 0 THEN 'name is empty' END, CASE WHEN p_size % 3 = 0 THEN 'unknown kind' END, CASE WHEN p_size % 5 = 0 THEN 'statement is empty' END], lambda x: x IS NOT NULL), ';') AS errors FROM part")
def f15_card_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda n: F.col("p_size") % n == 0
    card = {"name": F.when(by(7), " ").otherwise(F.col("p_name")), "kind": F.when(by(3), "odd").otherwise("theorem"), "statement": F.when(~by(5), F.col("p_type")), "steps": F.array(), "concepts": F.array(F.col("p_brand"))}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.card_errors(card), ";").alias("errors"))


@query("f13_formula_reasons", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'defined_value' WHEN 1 THEN 'said_in_example' WHEN 2 THEN 'bare_notation' END AS reason FROM part")
def f13_formula_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few of the ten rules; f13_formula_rules has them all."""
    k = F.col("p_size") % 4
    name = F.when(k == 0, "P(x,y)定义为 x+y=2").when(k == 1, "两数之和").when(k == 2, "集合记号").otherwise("加法公式")
    evidence = F.when(k == 1, "例如 两个").otherwise("一般地")
    return table(spark, sf_dir, "part").select("p_partkey", C.formula_drop_reason(name, F.lit("x"), evidence).alias("reason"))


@query("f14_f16_junk_theorems", "SELECT p_partkey, length(trim(p_type)) < 4 OR p_size % 6 = 0 AS junk FROM part")
def f14_f16_junk_theorems(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 6 == 0, "Theorem 3.1").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.junk_theorem(name, F.col("p_type")).alias("junk"))


@query("f20_align_properties", f"WITH {TRIPLETS_SQL} SELECT row_id, CASE WHEN relation = 'related_with' AND cue % 2 = 0 THEN object ELSE subject END AS subject, CASE WHEN relation = 'related_with' AND cue % 2 = 0 THEN subject ELSE object END AS object FROM t")
def f20_align_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    t = t.withColumn("relation", F.when(F.col("relation") == "related_with", "property_of").otherwise(F.col("relation"))).withColumn("direction", F.when(F.col("cue") % 2 == 0, "object_to_subject").otherwise("subject_to_object")).withColumn("phrase", F.lit(""))
    return C.align_properties(t).select("row_id", "subject", "object")


@query("f9_f10_delta_filter", f"WITH {TRIPLETS_SQL}, d AS (SELECT row_id, subject, object, CASE WHEN cue % 3 = 0 THEN 'of ' || subject ELSE 'has' END AS phrase FROM t) SELECT row_id FROM d WHERE NOT contains(phrase, subject) QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY row_id) = 1")
def f9_f10_delta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir).withColumn("phrase", F.when(F.col("cue") % 3 == 0, F.concat(F.lit("of "), "subject")).otherwise("has"))
    fine = t.filter(~C.awkward_delta(F.col("subject"), F.col("phrase"), F.col("object")))
    return K.keep_first(fine.select("row_id", "subject", "object"), ["subject", "object"], ["row_id"]).select("row_id")


@query(
    "g23_display_graph",
    f"""WITH {TRIPLETS_SQL}, e AS (SELECT DISTINCT CASE WHEN subject = 'S2' THEN 'S1' ELSE subject END AS subject, relation, object FROM t),
    s AS (SELECT * FROM e QUALIFY relation <> 'related_with' OR max((relation <> 'related_with')::INT) OVER (PARTITION BY subject, object) = 0)
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY CASE relation WHEN 'belong_to' THEN 100 WHEN 'depend_on' THEN 85 ELSE 15 END DESC) = 1""",
)
def g23_display_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("S2", "S1")], "alias string, canonical string")
    return C.display_graph(triplets(spark, sf_dir), aliases)


@query("m2_prepared_tree", f"WITH {TRIPLETS_SQL} SELECT entity, string_agg(DISTINCT other, ',' ORDER BY other) AS related FROM (SELECT subject AS entity, object AS other FROM t WHERE relation = 'related_with' UNION ALL SELECT object, subject FROM t WHERE relation = 'related_with') GROUP BY entity")
def m2_prepared_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = C.prepared_tree_edges(triplets(spark, sf_dir))[1]
    return related.select("entity", F.array_join("related", ",").alias("related"))


@query("x20_allowed_points", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE '' END AS points FROM part")
def x20_allowed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lower("p_type"), F.lit(" "))).otherwise("unknown"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.allowed_points(points, F.array(F.upper("p_type"))), ",").alias("points"))


@query(
    "j19_link_cards",
    """WITH c AS (SELECT p_partkey AS id, list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2))) AS g FROM (SELECT p_partkey, lower(p_name) AS n FROM part)), e AS (SELECT id, list_distinct(list_transform(range(1, length(id)), lambda i: substr(id, i, 2))) AS g FROM (SELECT DISTINCT lower(p_type) AS id FROM part)),
    s AS (SELECT c.id AS card, e.id AS entity, len(list_intersect(c.g, e.g)) / least(len(c.g), len(e.g)) AS score FROM c, e) SELECT card, entity, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY card ORDER BY score DESC, entity) <= 2""",
)
def j19_link_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = lambda df, i, n: df.select(i.alias("id"), char_ngrams(n).alias("g")).select("id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    out = C.link_cards(rows(p, F.col("p_partkey"), F.lower("p_name")), rows(p.select(F.lower("p_type").alias("t")).distinct(), F.col("t"), F.col("t")))
    return out.select("card", "entity", F.round("score", 6).alias("score"))


@query("j23_incremental_rows", f"WITH {TRIPLETS_SQL} SELECT row_id, lecture NOT IN (3, 4) AS carried FROM t")
def j23_incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of rebuilt lectures replace the old ones, the rest is carried."""
    t = triplets(spark, sf_dir).select("row_id", "lecture")
    fresh = t.filter(F.col("lecture").isin(3, 4))
    carried = t.join(fresh.select("lecture").distinct(), "lecture", "left_anti")
    return carried.select("row_id", F.lit(True).alias("carried")).unionByName(fresh.select("row_id", F.lit(False).alias("carried")))


@query("k8_sorted_importance", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part")
def k8_sorted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"]).drop("p_retailprice")


@query("a24_anchor_stats", f"WITH {TRIPLETS_SQL}, a AS (SELECT cue, sum((subject IN ('S1', 'S2'))::INT + (object = 'P1')::INT) AS n FROM t GROUP BY cue) SELECT round(avg(n), 6) AS mean_anchors, sum((n = 0)::INT)::BIGINT AS without FROM a")
def a24_anchor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("subject").isin("S1", "S2").cast("int") + (F.col("object") == "P1").cast("int")
    a = triplets(spark, sf_dir).groupBy("cue").agg(F.sum(n).alias("n"))
    return a.agg(F.round(F.avg("n"), 6).alias("mean_anchors"), F.count_if(F.col("n") == 0).alias("without"))


@query("a26_checksum", "SELECT user_id, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS checksum FROM events GROUP BY user_id")
def a26_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sha2(F.array_join(ids, ","), 256).alias("checksum"))


@query("s21_reuse_artifacts", "SELECT p_partkey FROM part WHERE p_size % 10 <> 0")
def s21_reuse_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts whose stored fingerprint equals the input's are taken again."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = p.withColumn("p_name", F.when(F.col("p_size") % 10 == 0, "old").otherwise(F.col("p_name")))
    stored = old.select("p_partkey", ingest.fingerprint(old, ["p_name", "p_size"]).alias("digest"))
    now = p.select("p_partkey", ingest.fingerprint(p, ["p_name", "p_size"]).alias("digest"))
    return now.join(stored, ["p_partkey", "digest"], "left_semi").select("p_partkey")


@query("v3_structural_partition", f"WITH {TRIPLETS_SQL} SELECT row_id, CASE WHEN trim(statement) = '' THEN 'discard' ELSE 'pass' END AS verdict FROM t")
def v3_structural_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkg.functions.rules import first_failure

    c = F.col
    reason = first_failure({"subject": c("subject"), "object": c("object"), "relation": c("relation"), "phrase": F.substring("statement", 1, 4), "direction": F.lit("subject_to_object"), "context": F.lit(""), "source": F.lit("")})
    return triplets(spark, sf_dir).select("row_id", F.when(reason.isNull(), "pass").otherwise("discard").alias("verdict"))


@query("r11_hit_context", "SELECT vec_id, concat_ws(chr(10), '[' || vec_id || ']', CASE WHEN label = 0 THEN 'frame' END, 'score ' || label) AS context FROM embeddings")
def r11_hit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.concat(F.lit("["), "vec_id", F.lit("]")), F.when(F.col("label") == 0, "frame"), F.concat(F.lit("score "), "label")]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws("\n", *parts).alias("context"))


@query("r12_image_paths", f"WITH {TRIPLETS_SQL}, f AS (SELECT lecture, cue, min(row_id) AS r FROM t GROUP BY ALL) SELECT lecture, string_agg(cue::VARCHAR, ',' ORDER BY r) AS paths FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lecture ORDER BY r) <= 6) GROUP BY lecture")
def r12_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six distinct paths of each answer, in order."""
    f = triplets(spark, sf_dir).groupBy("lecture", "cue").agg(F.min("row_id").alias("r"))
    six = f.withColumn("i", F.row_number().over(Window.partitionBy("lecture").orderBy("r"))).filter("i <= 6")
    return six.groupBy("lecture").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "cue"))), lambda x: x["cue"].cast("string")), ",").alias("paths"))
