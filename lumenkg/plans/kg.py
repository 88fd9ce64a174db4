"""Knowledge-graph construction over the triplets view of order lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.operators import kg as K
from lumenkg.registry import query
from lumenkg.sources.tables import TRIPLETS_SQL, table, triplets

EDGES_SQL = f"{TRIPLETS_SQL}, e AS (SELECT subject, relation, object, count(*) AS mentions, count(DISTINCT cue) AS cues, arg_min(statement, row_id) FILTER (statement <> '') AS statement FROM t WHERE subject <> object GROUP BY ALL)"


def edges(spark, sf_dir):
    return K.merged_edges(triplets(spark, sf_dir))


@query("a3_merge_edges", f"WITH {EDGES_SQL} SELECT * FROM e")
def a3_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(
    "a1_triplet_stats",
    f"""WITH {TRIPLETS_SQL} SELECT lecture, relation, count(*) AS n, count(DISTINCT subject) AS subjects FROM t GROUP BY GROUPING SETS ((lecture), (relation), ())""",
)
def a1_triplet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    return t.groupingSets([["lecture"], ["relation"], []], "lecture", "relation").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects")).select("lecture", "relation", "n", "subjects")


@query(
    "a2_validation_summary",
    "SELECT count(*) AS total, sum((toxic = 1)::INT)::BIGINT AS discard, sum((toxic = 0 AND quality = 0)::INT)::BIGINT AS revise, round(avg((toxic = 1)::INT), 6) AS discard_rate FROM labels",
)
def a2_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("toxic") == 1
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(bad).alias("discard"), F.count_if(~bad & (F.col("quality") == 0)).alias("revise"), F.round(F.avg(bad.cast("int")), 6).alias("discard_rate"))


@query(
    "a4_entity_cues",
    f"WITH {TRIPLETS_SQL}, x AS (SELECT subject AS entity, cue, relation FROM t UNION ALL SELECT object, cue, relation FROM t) SELECT entity, count(DISTINCT cue) AS mention_count, min(cue) AS first_cue FROM x GROUP BY entity",
)
def a4_entity_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.endpoints(triplets(spark, sf_dir), "cue").groupBy("entity").agg(F.countDistinct("cue").alias("mention_count"), F.min("cue").alias("first_cue"))


@query(
    "a5_entity_degree",
    f"WITH {TRIPLETS_SQL}, x AS (SELECT subject AS entity, relation, cue, 1 AS o FROM t UNION ALL SELECT object, relation, cue, 0 FROM t) SELECT entity, count(*) AS degree, count(DISTINCT relation) AS relations, sum(o)::BIGINT AS out_degree FROM x GROUP BY entity",
)
def a5_entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    ends = t.select(F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.lit(1).alias("o")), F.struct(F.col("object").alias("entity"), F.lit(0).alias("o")))).alias("x"), "relation")
    return ends.groupBy(F.col("x.entity").alias("entity")).agg(F.count("*").alias("degree"), F.countDistinct("relation").alias("relations"), F.sum("x.o").alias("out_degree"))


@query("a6_cue_index", f"WITH {TRIPLETS_SQL} SELECT cue, arg_min(lecture, row_id) AS lecture, arg_min(statement, (-length(statement), row_id)) AS longest FROM t GROUP BY cue")
def a6_cue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    return t.groupBy("cue").agg(F.min_by("lecture", "row_id").alias("lecture"), F.min_by("statement", F.struct(-F.length("statement"), F.col("row_id"))).alias("longest"))


@query("a7_provenance_first", f"WITH {TRIPLETS_SQL} SELECT cue, subject, relation, row_id FROM t QUALIFY row_number() OVER (PARTITION BY cue, subject, relation ORDER BY row_id) = 1")
def a7_provenance_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keep_first(triplets(spark, sf_dir).select("cue", "subject", "relation", "row_id"), ["cue", "subject", "relation"], ["row_id"])


@query("u6_dedupe_triplets", f"WITH {TRIPLETS_SQL} SELECT row_id, subject, relation, object FROM t QUALIFY row_number() OVER (PARTITION BY subject, relation, object ORDER BY row_id) = 1")
def u6_dedupe_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keep_first(triplets(spark, sf_dir).select("row_id", "subject", "relation", "object"), ["subject", "relation", "object"], ["row_id"])


@query("a8_lecture_df", f"WITH {TRIPLETS_SQL}, x AS (SELECT subject AS entity, lecture FROM t UNION ALL SELECT object, lecture FROM t) SELECT entity, count(DISTINCT lecture) AS df, round(ln(1 + (SELECT count(DISTINCT lecture) FROM t)::DOUBLE / count(DISTINCT lecture)), 6) AS idf FROM x GROUP BY entity")
def a8_lecture_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    n = F.broadcast(t.agg(F.countDistinct("lecture").alias("n")))  # one row
    df = K.endpoints(t, "lecture").groupBy("entity").agg(F.countDistinct("lecture").alias("df"))
    return df.crossJoin(n).select("entity", "df", F.round(F.log1p(F.col("n") / F.col("df")), 6).alias("idf"))


@query("a10_structure_degree", f"WITH {TRIPLETS_SQL}, x AS (SELECT subject AS entity, relation FROM t UNION ALL SELECT object, relation FROM t) SELECT entity, sum(CASE WHEN relation = 'related_with' THEN 0.5 ELSE 1.0 END)::DOUBLE AS degree FROM x GROUP BY entity")
def a10_structure_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.endpoints(triplets(spark, sf_dir), "relation").groupBy("entity").agg(F.sum(F.when(F.col("relation") == "related_with", 0.5).otherwise(1.0)).alias("degree"))


@query("a11_feedback_weights", "SELECT user_id, round(sum(CASE event_type WHEN 'error' THEN 1.2 WHEN 'purchase' THEN 1.5 ELSE 1.0 END * floor(abs(value) * 100)), 4)::DOUBLE AS weight FROM events GROUP BY user_id")
def a11_feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("event_type") == "error", 1.2).when(F.col("event_type") == "purchase", 1.5).otherwise(1.0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(w * F.floor(F.abs("value") * 100)), 4).alias("weight"))


@query("a14_median", "SELECT lang, median(n_chars)::DOUBLE AS median_chars, count(*) AS n FROM documents GROUP BY lang")
def a14_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.median("n_chars").alias("median_chars"), F.count("*").alias("n"))


@query("a15_alignment_means", "SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS mean_a, sum((embedding[2] < 0.12::FLOAT)::INT)::BIGINT AS low FROM embeddings GROUP BY label")
def a15_alignment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(e[0].cast("double")), 6).alias("mean_a"), F.count_if(e[1] < F.lit(0.12).cast("float")).alias("low"))


@query("a16_evidence_coverage", f"WITH {EDGES_SQL} SELECT count(*) AS edges, sum((statement IS NOT NULL)::INT)::BIGINT AS with_statement, sum((cues > 1)::INT)::BIGINT AS multi_cue FROM e")
def a16_evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).agg(F.count("*").alias("edges"), F.count_if(F.col("statement").isNotNull()).alias("with_statement"), F.count_if(F.col("cues") > 1).alias("multi_cue"))


@query("a18_weighted_lecture_scores", f"WITH {TRIPLETS_SQL} SELECT object AS entity, round(sum(weight * lecture) / sum(weight), 6) AS score FROM t GROUP BY object")
def a18_weighted_lecture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).groupBy(F.col("object").alias("entity")).agg(F.round(F.sum(F.col("weight") * F.col("lecture")) / F.sum("weight"), 6).alias("score"))


@query("a19_max_minmax", f"WITH {TRIPLETS_SQL}, m AS (SELECT object AS entity, max(weight * (lecture + 1)) AS s FROM t GROUP BY object) SELECT entity, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS score FROM m")
def a19_max_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = triplets(spark, sf_dir).groupBy(F.col("object").alias("entity")).agg(F.max(F.col("weight") * (F.col("lecture") + 1)).alias("s"))
    ends = F.broadcast(m.agg(F.min("s").alias("lo"), F.max("s").alias("hi")))  # one row
    above, span = F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")
    score = F.when(span == 0, above + float("nan")).otherwise(F.round(above / span, 6))  # a span of 0 has no scores: 0 / 0, which ANSI mode refuses
    return m.crossJoin(ends).select("entity", score.alias("score"))


@query(
    "a23_fuse_lectures",
    f"""WITH {TRIPLETS_SQL}, a AS (SELECT DISTINCT subject, relation, object FROM t WHERE lecture = 1), b AS (SELECT DISTINCT subject, relation, object FROM t WHERE lecture = 2)
    SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.relation, b.relation) AS relation, coalesce(a.object, b.object) AS object,
    CASE WHEN b.subject IS NULL THEN 'only-a' WHEN a.subject IS NULL THEN 'only-b' ELSE 'both' END AS origin
    FROM a FULL JOIN b ON a.subject = b.subject AND a.relation = b.relation AND a.object = b.object""",
)
def a23_fuse_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    spo = ["subject", "relation", "object"]
    t = triplets(spark, sf_dir)
    a = t.filter("lecture = 1").select(*spo).distinct().withColumn("a", F.lit(1))
    b = t.filter("lecture = 2").select(*spo).distinct().withColumn("b", F.lit(1))
    return a.join(b, spo, "full").select(*spo, F.when(F.col("b").isNull(), "only-a").when(F.col("a").isNull(), "only-b").otherwise("both").alias("origin"))


@query("g18_drop_weak_twins", f"WITH {EDGES_SQL} SELECT subject, relation, object FROM e QUALIFY relation <> 'related_with' OR max((relation <> 'related_with')::INT) OVER (PARTITION BY least(subject, object), greatest(subject, object)) = 0")
def g18_drop_weak_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.without_weak_twins(edges(spark, sf_dir)).select("subject", "relation", "object")


@query("g19_collapse_relations", f"WITH {EDGES_SQL} SELECT subject, relation, object FROM e QUALIFY row_number() OVER (PARTITION BY least(subject, object), greatest(subject, object) ORDER BY CASE relation WHEN 'belong_to' THEN 100 WHEN 'depend_on' THEN 85 ELSE 15 END DESC, subject, object) = 1")
def g19_collapse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.one_relation_per_pair(edges(spark, sf_dir)).select("subject", "relation", "object")


@query("g20_fold_properties", f"WITH {EDGES_SQL} SELECT subject, count(*) AS n, string_agg(object, ',' ORDER BY object) AS properties FROM e WHERE relation = 'belong_to' GROUP BY subject")
def g20_fold_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = edges(spark, sf_dir).filter("relation = 'belong_to'").groupBy("subject")
    return own.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("object")), ",").alias("properties"))


@query("j4_canonical_rewrite", f"WITH {TRIPLETS_SQL}, m AS (SELECT 'P' || i AS alias, 'P' || (i // 2 * 2) AS canonical FROM range(0, 100) r(i)) SELECT row_id, subject, coalesce(canonical, object) AS object FROM t LEFT JOIN m ON alias = object")
def j4_canonical_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    m = spark.range(100).select(F.concat(F.lit("P"), i).alias("alias"), F.concat(F.lit("P"), (F.floor(i / 2) * 2)).alias("canonical"))
    return K.canonical(triplets(spark, sf_dir).select("row_id", "subject", "object"), m, ["object"]).select("row_id", "subject", "object")


@query("j5_new_triplets", f"WITH {TRIPLETS_SQL} SELECT row_id FROM t WHERE lecture >= 20 AND NOT EXISTS (SELECT 1 FROM t x WHERE x.lecture < 20 AND x.subject = t.subject AND x.relation = t.relation AND x.object = t.object)")
def j5_new_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, spo = triplets(spark, sf_dir), ["subject", "relation", "object"]
    return t.filter("lecture >= 20").join(t.filter("lecture < 20").select(*spo), spo, "left_anti").select("row_id")


@query("j12_loose_overlap", f"WITH {TRIPLETS_SQL}, k AS (SELECT DISTINCT lecture < 20 AS old, least(subject, object) AS a, greatest(subject, object) AS b, relation FROM t) SELECT x.a, x.b, x.relation FROM k x JOIN k y ON x.old AND NOT y.old AND x.a = y.a AND x.b = y.b AND x.relation = y.relation")
def j12_loose_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = triplets(spark, sf_dir).select("lecture", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "relation")
    return k.filter("lecture < 20").drop("lecture").intersect(k.filter("lecture >= 20").drop("lecture"))


@query("u3_set_difference", f"WITH {TRIPLETS_SQL} SELECT subject, object FROM t WHERE lecture = 3 EXCEPT SELECT subject, object FROM t WHERE lecture = 4")
def u3_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    return t.filter("lecture = 3").select("subject", "object").subtract(t.filter("lecture = 4").select("subject", "object"))


@query("u5_relations", f"WITH {TRIPLETS_SQL} SELECT DISTINCT relation FROM t")
def u5_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).select("relation").distinct()


@query("u7_undirected_dedupe", f"WITH {TRIPLETS_SQL} SELECT relation, CASE WHEN relation = 'related_with' THEN least(subject, object) ELSE subject END AS a, CASE WHEN relation = 'related_with' THEN greatest(subject, object) ELSE object END AS b, count(DISTINCT cue) AS cues, max(weight) AS weight FROM t GROUP BY ALL")
def u7_undirected_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = F.col("relation").isin("related_with", "synonym_of")
    a = F.when(free, F.least("subject", "object")).otherwise(F.col("subject"))
    b = F.when(free, F.greatest("subject", "object")).otherwise(F.col("object"))
    return triplets(spark, sf_dir).groupBy("relation", a.alias("a"), b.alias("b")).agg(F.countDistinct("cue").alias("cues"), F.max("weight").alias("weight"))


@query("k3_seed_cap", f"WITH {TRIPLETS_SQL} SELECT lecture, row_id, row_number() OVER (PARTITION BY lecture ORDER BY weight DESC, row_id)::INT AS rank FROM t QUALIFY rank <= 40")
def k3_seed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lecture").orderBy(F.desc("weight"), "row_id")
    return triplets(spark, sf_dir).select("lecture", "row_id", F.row_number().over(w).alias("rank")).filter("rank <= 40")


@query("g1_weighted_graph", f"WITH {TRIPLETS_SQL} SELECT subject, object, max(weight) AS weight FROM t WHERE subject <> object GROUP BY ALL")
def g1_weighted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).filter("subject <> object").groupBy("subject", "object").agg(F.max("weight").alias("weight"))


@query("g2_normalised_graph", f"WITH {TRIPLETS_SQL}, g AS (SELECT subject, object, max(weight) AS w FROM t WHERE subject <> object GROUP BY ALL) SELECT subject, object, round(w / sqrt(count(*) OVER (PARTITION BY subject)), 6) AS weight FROM g")
def g2_normalised_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = g1_weighted_graph(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("subject"))
    return g.select("subject", "object", F.round(F.col("weight") / F.sqrt(n), 6).alias("weight"))


@query("g25_isolated_nodes", f"WITH {TRIPLETS_SQL} SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM t WHERE subject = 'S' || s_suppkey)")
def g25_isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = triplets(spark, sf_dir).select("subject")
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("subject"))
    return nodes.join(ends, "subject", "left_semi").select("s_suppkey")
