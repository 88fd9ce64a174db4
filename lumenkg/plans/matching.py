"""Joins, filters, set operations and alignment over the driver tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.functions import rules as V
from lumenkg.functions import text as T
from lumenkg.operators import align as A
from lumenkg.operators import kg as K
from lumenkg.operators import retrieval as R
from lumenkg.registry import query
from lumenkg.sources.tables import TRIPLETS_SQL, table, triplets


@query("f4_bad_entities", "SELECT tok, (length(tok) = 1 AND regexp_matches(tok, '^[A-Za-z0-9]$')) OR regexp_matches(tok, '[:：]$') OR regexp_matches(tok, '^[A-Za-z]\\w*\\([^)]*\\)$') OR regexp_matches(tok, '^[=+\\-*/<>^|&~]+$') AS bad FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS tok FROM benchmark) WHERE trim(tok) = tok AND tok <> '' AND tok NOT LIKE concat('%', chr(10), '%')")
def f4_bad_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("tok")).distinct().filter((F.trim("tok") == F.col("tok")) & (F.col("tok") != "") & ~F.col("tok").contains("\n"))
    return w.select("tok", V.bad_entity(F.col("tok")).alias("bad"))


@query(
    "f7_validate_triplets",
    f"""WITH {TRIPLETS_SQL} SELECT row_id, CASE WHEN subject = object THEN 'self_loop' WHEN trim(statement) = '' THEN 'concrete_empty' WHEN length(replace(statement, ' ', '')) > 4 AND lecture > 20 THEN 'concrete_too_long'
    WHEN lecture % 3 = 0 THEN 'bad_direction' WHEN NOT contains(lower(statement), 'line') THEN 'context_not_in_source' END AS reason FROM t""",
)
def f7_validate_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    phrase = F.when(F.col("statement") == "", "").when(F.col("lecture") > 20, F.concat("statement", F.lit(" more"))).otherwise(F.lit("is"))
    direction = F.when(F.col("lecture") % 3 == 0, "sideways").otherwise("subject_to_object")
    parts = {"subject": F.col("subject"), "object": F.col("object"), "relation": F.col("relation"), "phrase": phrase, "direction": direction, "context": F.lit("line"), "source": F.col("statement")}
    return t.select("row_id", V.first_failure(parts).alias("reason"))


@query("f8_evidence_in_text", "SELECT doc_id, contains(regexp_replace(text, '\\s+', '', 'g'), 'andthe') AS found FROM documents")
def f8_evidence_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.contains_ignoring_space(F.col("text"), F.lit("and the"), empty=False).alias("found"))


@query("f11_entity_weights", "SELECT p_partkey, round(p_retailprice * CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 0.0 WHEN length(p_name) < 8 THEN 0.5 ELSE 1.0 END, 4) AS weight FROM part")
def f11_entity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), 0.0).when(F.length("p_name") < 8, 0.5).otherwise(1.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * m, 4).alias("weight"))


@query("f19_apply_review", f"WITH {TRIPLETS_SQL} SELECT row_id FROM t WHERE row_id // 1000000 NOT IN (SELECT doc_id * 10 + 1 FROM labels WHERE toxic = 1)")
def f19_apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = table(spark, sf_dir, "labels").filter("toxic = 1").select((F.col("doc_id") * 10 + 1).alias("line"))
    return triplets(spark, sf_dir).select("row_id", F.floor(F.col("row_id") / 1_000_000).alias("line")).join(rejected, "line", "left_anti").select("row_id")


@query(
    "f21_relation_names",
    "SELECT event_id, CASE WHEN r = 'has_part' THEN 'part_of' WHEN r = 'requires' THEN 'depend_on' WHEN r = 'is_a' THEN 'belong_to' ELSE r END AS relation FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'has_part' WHEN 1 THEN 'requires' WHEN 2 THEN 'is_a' ELSE event_type END AS r FROM events)",
)
def f21_relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 4
    raw = F.when(i == 0, "Has Part").when(i == 1, " requires").when(i == 2, "IS-A").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", V.normal_relation(raw).alias("relation"))


@query("f22_statements", f"WITH {TRIPLETS_SQL} SELECT row_id, CASE WHEN lecture % 2 = 0 THEN subject || ' is in ' || object ELSE object || ' is in ' || subject END AS sentence FROM t")
def f22_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.when(F.col("row_id") % 2 == 0, " is in …").otherwise(" is in ")
    return triplets(spark, sf_dir).select("row_id", V.statement(F.col("subject"), phrase, F.col("object"), F.col("lecture") % 2 == 0).alias("sentence"))


@query("f25_weak_aliases", "SELECT DISTINCT tok, length(tok) < 2 OR regexp_matches(tok, '^[0-9[:punct:]]+$') AS weak FROM (SELECT unnest(regexp_extract_all(p_name || ' ' || p_brand, '[A-Za-z0-9#]+')) AS tok FROM part)")
def f25_weak_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_brand"), F.lit("[A-Za-z0-9#]+"), F.lit(0))).alias("tok")).distinct()
    return w.select("tok", V.weak_alias(F.col("tok")).alias("weak"))


@query("f26_importance_keep", "SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) <= greatest(1, ceil(count(*) OVER (PARTITION BY p_brand) * 0.2))")
def f26_importance_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    p = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(w.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey"))).withColumn("n", F.count("*").over(w))
    return p.filter(F.col("i") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.2))).select("p_partkey")


@query("f28_empty_lectures", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def f28_empty_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("f18_min_score", "SELECT vec_id FROM embeddings WHERE embedding[1] >= 0.05::FLOAT AND (label IS NULL OR label < 3)")
def f18_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.filter((F.col("embedding")[0] >= F.lit(0.05).cast("float")) & (F.col("label").isNull() | (F.col("label") < 3))).select("vec_id")


@query("j1_enrich_provenance", f"WITH {TRIPLETS_SQL} SELECT row_id, coalesce(nullif(statement, ''), o_orderpriority) AS source_text, o_custkey FROM t LEFT JOIN orders ON o_orderkey = cue")
def j1_enrich_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue"), "o_orderpriority", "o_custkey")
    return triplets(spark, sf_dir).join(o, "cue", "left").select("row_id", F.coalesce(F.nullif(F.col("statement"), F.lit("")), F.col("o_orderpriority")).alias("source_text"), "o_custkey")


@query("j2_clip_evidence", f"WITH {TRIPLETS_SQL} SELECT DISTINCT object AS entity, o_custkey AS clip FROM t JOIN orders ON o_orderkey = cue")
def j2_clip_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cue"), F.col("o_custkey").alias("clip"))
    return triplets(spark, sf_dir).join(o, "cue").select(F.col("object").alias("entity"), "clip").distinct()


@query("j3_alias_evidence", f"WITH {TRIPLETS_SQL}, a AS (SELECT i AS entity, unnest(['S' || i, 'P' || i]) AS alias FROM range(1, 60) r(i)) SELECT DISTINCT entity, row_id FROM a JOIN t ON alias = subject OR alias = object")
def j3_alias_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.range(1, 60).select(F.col("id").alias("entity"), F.explode(F.array(F.concat(F.lit("S"), "id"), F.concat(F.lit("P"), "id"))).alias("alias"))
    t = triplets(spark, sf_dir)
    either = t.select("row_id", F.col("subject").alias("alias")).unionByName(t.select("row_id", F.col("object").alias("alias")))
    return a.join(either, "alias").select("entity", "row_id").distinct()


@query("j8_alias_matches", "SELECT n_nationkey, item_id FROM nation JOIN benchmark ON contains(lower(text), lower(left(n_name, 2)))")
def j8_alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 2)).alias("alias"))  # a fixed table of 25 names
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t"))
    return b.join(F.broadcast(n), F.col("t").contains(F.col("alias"))).select("n_nationkey", "item_id")


@query("j14_video_segments", "SELECT DISTINCT p_partkey, n_nationkey FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) JOIN (SELECT n_nationkey, lower(left(n_name, 1)) AS l FROM nation) ON left(w, 1) = l")
def j14_video_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w")).select("p_partkey", F.substring("w", 1, 1).alias("l")).distinct()
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 1)).alias("l"))
    return w.join(n, "l").select("p_partkey", "n_nationkey").distinct()


@query("j15_first_reference", "SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY user_id, event_type")
def j15_first_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))


@query("j16_id_rewrite", f"WITH {TRIPLETS_SQL}, m AS (SELECT 'S' || s_suppkey AS old, 'fused:' || s_nationkey AS new FROM supplier) SELECT DISTINCT new AS source, object AS target, relation FROM t JOIN m ON old = subject")
def j16_id_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("subject"), F.concat(F.lit("fused:"), "s_nationkey").alias("source"))
    return triplets(spark, sf_dir).join(m, "subject").select("source", F.col("object").alias("target"), "relation").distinct()


@query("j17_overlay", "SELECT c_custkey, coalesce(n_name, c_mktsegment) AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal > 5000")
def j17_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_acctbal") > 5000), "left").select("c_custkey", F.coalesce("n_name", "c_mktsegment").alias("label"))


@query("u1_graph_union", "SELECT key, arg_max(v, o) AS name, count(*) AS views FROM (SELECT lower(replace(n_name, ' ', '')) AS key, n_name AS v, 1 AS o FROM nation UNION ALL SELECT lower(replace(r_name, ' ', '')), r_name, 2 FROM region UNION ALL SELECT lower(replace(n_name, ' ', '')), lower(n_name), 3 FROM nation WHERE n_regionkey = 1) GROUP BY key")
def u1_graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    views = n.select(F.col("n_name").alias("v"), F.lit(1).alias("o")).unionByName(r.select(F.col("r_name").alias("v"), F.lit(2).alias("o"))).unionByName(n.filter("n_regionkey = 1").select(F.lower("n_name").alias("v"), F.lit(3).alias("o")))
    return views.groupBy(F.lower(T.without_space(F.col("v"))).alias("key")).agg(F.max_by("v", "o").alias("name"), F.count("*").alias("views"))


@query("u4_topk_jaccard", "WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 50) SELECT round(sum((a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL)::INT) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def u4_topk_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", F.lit(1).alias("a"))
    b = p.orderBy(F.desc("p_size"), "p_partkey").limit(50).select("p_partkey", F.lit(1).alias("b"))
    return a.join(b, "p_partkey", "full").agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*"), 6).alias("jaccard"))


@query("s18_stable_ids", "SELECT p_partkey, 'textbook:' || left(sha256(p_name), 20) AS id FROM part")
def s18_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("textbook:"), F.substring(F.sha2("p_name", 256), 1, 20)).alias("id"))


@query("s20_fingerprint", "SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def s20_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive content hash of each source's rows (one 64-digit hash a row is gathered)."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return d.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("digest"))


@query("s11_merge_textbooks", "SELECT p_brand AS name, arg_max(p_name, length(p_name) * 1000000 - p_partkey) AS definition, max(p_retailprice) AS importance, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS theorems FROM part GROUP BY p_brand")
def s11_merge_textbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = F.max_by("p_name", F.length("p_name") * F.lit(1000000) - F.col("p_partkey"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(longest.alias("definition"), F.max("p_retailprice").alias("importance"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("theorems"))


@query("s14_cypher", f"WITH {TRIPLETS_SQL} SELECT DISTINCT 'MERGE (a:Entity {{name: \"' || subject || '\"}}) MERGE (b:Entity {{name: \"' || object || '\"}}) MERGE (a)-[:' || upper(relation) || ']->(b);' AS statement FROM t")
def s14_cypher(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkg.sources.exports import cypher_statements

    return cypher_statements(triplets(spark, sf_dir).select("subject", "relation", "object").distinct())


@query("s13_graphml", f"WITH {TRIPLETS_SQL} SELECT DISTINCT '<edge source=\"' || subject || '\" target=\"' || object || '\"><data key=\"relation\">' || relation || '</data></edge>' AS line FROM t")
def s13_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkg.sources.exports import graphml_edges

    return graphml_edges(triplets(spark, sf_dir).select("subject", "relation", "object").distinct())


GRAMS_SQL = """b AS (SELECT item_id AS a, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), d AS (SELECT doc_id AS b, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
    ga AS (SELECT a, i AS pos, array_to_string(w[i + 1:i + 4], ' ') AS gram FROM b, unnest(range(0, len(w) - 3)) u(i)), gb AS (SELECT b, i AS pos, array_to_string(w[i + 1:i + 4], ' ') AS gram FROM d, unnest(range(0, len(w) - 3)) u(i))"""


def _grams(spark, sf_dir):
    words = T.tokens(F.col("text"))
    return A.word_grams(table(spark, sf_dir, "benchmark"), "item_id", words), A.word_grams(table(spark, sf_dir, "documents"), "doc_id", words)


@query("q1_anchors", f"WITH {GRAMS_SQL}, ua AS (SELECT gram, min(a) AS a, min(pos) AS a_pos FROM ga GROUP BY gram HAVING count(*) = 1), ub AS (SELECT gram, min(b) AS b, min(pos) AS b_pos FROM gb GROUP BY gram HAVING count(*) = 1) SELECT a, a_pos::INT AS a_pos, b, b_pos::INT AS b_pos, gram FROM ua JOIN ub USING (gram)")
def q1_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.anchors(*_grams(spark, sf_dir))


@query("q5_lecture_votes", f"WITH {GRAMS_SQL}, ua AS (SELECT gram, min(a) AS a FROM (SELECT DISTINCT a, gram FROM ga) GROUP BY gram HAVING count(*) = 1) SELECT a, b, count(DISTINCT gram) AS votes FROM ua JOIN gb USING (gram) GROUP BY a, b")
def q5_lecture_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _grams(spark, sf_dir)
    once = a.select("item_id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("n"), F.min("item_id").alias("a")).filter("n = 1").drop("n")
    return once.join(A.among(b, once).select(F.col("doc_id").alias("b"), "gram"), "gram").groupBy("a", "b").agg(F.countDistinct("gram").alias("votes"))


@query(
    "q3_gram_similarity",
    f"""WITH {GRAMS_SQL}, y AS (SELECT DISTINCT b, gram FROM gb), n AS (SELECT count(DISTINCT b) AS n FROM y), df AS (SELECT gram, ln(1 + n::DOUBLE / count(*)) AS idf FROM y, n GROUP BY gram, n HAVING count(*) <= 0.3 * n),
    x AS (SELECT DISTINCT a, gram, idf FROM ga JOIN df USING (gram)), tot AS (SELECT a, sum(idf) AS total FROM x GROUP BY a), h AS (SELECT a, b, sum(idf) AS hit FROM x JOIN y USING (gram) GROUP BY a, b) SELECT a, b, round(hit / total, 6) AS score FROM h JOIN tot USING (a)""",
)
def q3_gram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    n = table(spark, sf_dir, "documents").filter(F.size(words) >= 4).agg(F.countDistinct("doc_id").alias("n"))
    return A.gram_similarity(*_grams(spark, sf_dir), rows=n).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "q2_time_warp",
    """WITH a AS (SELECT user_id, o, n FROM (SELECT DISTINCT user_id, floor(abs(value) * 10) * 100.0::DOUBLE AS o, floor(abs(value) * 10) * 110.0::DOUBLE + 7 AS n FROM events)), e AS (SELECT event_id, user_id, event_id * 1.5::DOUBLE AS t FROM events),
    j AS (SELECT e.user_id, e.t, (SELECT max(o) FROM a WHERE a.user_id = e.user_id AND o <= e.t) AS lo, (SELECT min(o) FROM a WHERE a.user_id = e.user_id AND o > e.t) AS hi FROM e)
    SELECT user_id, t, round(CASE WHEN lo IS NULL THEN t + hi * 1.1 + 7 - hi WHEN hi IS NULL THEN t + lo * 1.1 + 7 - lo ELSE lo * 1.1 + 7 + (t - lo) * 1.1 END, 4) AS warped FROM j""",
)
def q2_time_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.floor(F.abs("value") * 10)
    a = e.select("user_id", (step * 100.0).alias("o"), (step * 110.0 + 7).alias("n")).distinct()
    return A.warp(e.select("user_id", (F.col("event_id") * 1.5).alias("t")), a, "user_id", "t").select("user_id", "t", F.round("warped", 4).alias("warped"))


@query("q7_merge_cards", "SELECT p_type AS name, arg_max(p_partkey, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END * 1000000 - p_partkey) AS card FROM part GROUP BY p_type")
def q7_merge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("p_size") % 3 == 0, 3).when(F.col("p_size") % 3 == 1, 2).otherwise(1)
    return K.keep_first(table(spark, sf_dir, "part").withColumn("r", rank), ["p_type"], [F.desc("r"), "p_partkey"]).select(F.col("p_type").alias("name"), F.col("p_partkey").alias("card"))


@query("j11_similar_vectors", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.3")
def j11_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one kind (the structural block) with a cosine of .3 or more."""
    from lumenkg.operators.similarity import similar_pairs

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return similar_pairs(e, "vec_id", "label", "v", 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))
