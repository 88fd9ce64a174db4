"""Graph, importance and tree queries over the triplets view and the part hierarchy."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.operators import graph as G
from lumenkg.operators import kg as K
from lumenkg.operators.forest import chain_ends
from lumenkg.registry import query
from lumenkg.sources.tables import TRIPLETS_SQL, table, triplets

GRAPH_SQL = f"{TRIPLETS_SQL}, g AS (SELECT subject, object, max(weight) AS weight FROM t GROUP BY ALL)"


def graph(spark, sf_dir):
    return triplets(spark, sf_dir).groupBy("subject", "object").agg(F.max("weight").alias("weight"))


def hierarchy(spark, sf_dir):
    """part -> brand -> type, an acyclic graph of children (subject) and parents (object)."""
    p = table(spark, sf_dir, "part")
    up = p.select(F.concat(F.lit("P"), "p_partkey").alias("subject"), F.col("p_brand").alias("object"))
    return up.unionByName(p.select(F.col("p_brand").alias("subject"), F.concat(F.lit("T"), "p_type").alias("object"))).distinct()


HIERARCHY_SQL = "h AS (SELECT 'P' || p_partkey AS subject, p_brand AS object FROM part UNION SELECT p_brand, 'T' || p_type FROM part)"

_PR = ", ".join(
    f"""f{i} AS (SELECT v.node, v.p, coalesce(sum(s.share * r.r), 0) AS x FROM v LEFT JOIN sh s ON s.object = v.node LEFT JOIN r{i} r ON r.node = s.subject GROUP BY v.node, v.p),
    r{i + 1} AS (SELECT node, 0.85 * (x + (1 - (SELECT sum(x) FROM f{i})) * p) + 0.15 * p AS r FROM f{i})"""
    for i in range(10)
)


@query(
    "g4_pagerank",
    f"""WITH {GRAPH_SQL}, v AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS p FROM (SELECT subject AS node FROM g UNION SELECT object FROM g)),
    sh AS (SELECT subject, object, weight / sum(weight) OVER (PARTITION BY subject) AS share FROM g), r0 AS (SELECT node, p AS r FROM v), {_PR} SELECT node, round(r, 6) AS rank FROM r10""",
)
def g4_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(graph(spark, sf_dir), 10).select("node", F.round("rank", 6).alias("rank"))


@query(
    "g3_trust_seeds",
    f"""WITH {GRAPH_SQL}, s0 AS (SELECT 'S' || i AS node, 1.0::DOUBLE AS score FROM range(1, 6) x(i)), s1 AS (SELECT object AS node, sum(score) * 0.5 AS score FROM s0 JOIN g ON node = subject GROUP BY object),
    s2 AS (SELECT object AS node, sum(score) * 0.5 AS score FROM s1 JOIN g ON node = subject GROUP BY object) SELECT node, round(sum(score), 6) AS score FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2) GROUP BY node""",
)
def g3_trust_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1, 6).select(F.concat(F.lit("S"), "id").alias("node"), F.lit(1.0).alias("score"))
    return G.trust(graph(spark, sf_dir), seeds).select("node", F.round("score", 6).alias("score"))


SMALL_SQL = f"{TRIPLETS_SQL}, g AS (SELECT DISTINCT subject, object FROM t)"


def small_graph(spark, sf_dir):
    return triplets(spark, sf_dir).select("subject", "object").distinct()


@query("g5_components", f"WITH RECURSIVE {SMALL_SQL}, b AS (SELECT subject AS u, object AS v FROM g UNION SELECT object, subject FROM g), r(node, x) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.x) SELECT node, min(x) AS component FROM r GROUP BY node")
def g5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(small_graph(spark, sf_dir))


@query("g11_core_numbers")
def g11_core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.core_numbers(graph(spark, sf_dir))


@query("g11_core_fusion")
def g11_core_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.cut(graph(spark, sf_dir))
    return G.fuse_with_cores(G.pagerank(e, 10), G.core_numbers(e)).select("node", *[F.round(c, 6).alias(c) for c in ("final", "pr", "k_core", "norm_k", "norm_pr")])


@query(
    "g12_hub_penalty",
    f"WITH {TRIPLETS_SQL}, d AS (SELECT subject, count(*) AS n, avg((relation = 'related_with')::INT) AS w FROM t GROUP BY subject) SELECT subject, round(CASE WHEN n > 20 THEN sqrt(20.0::DOUBLE / n) ELSE 1.0 END * (1 - 0.3 * w), 6) AS factor FROM d",
)
def g12_hub_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = triplets(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"), F.avg((F.col("relation") == "related_with").cast("int")).alias("w"))
    return d.select("subject", F.round(G.hub_penalty(F.col("n"), F.col("w")), 6).alias("factor"))


@query("g13_meta_hubs", "SELECT p_partkey, round(p_retailprice * CASE WHEN starts_with(lower(p_name), 'a') THEN 0.35 ELSE 1.0 END, 4) AS score FROM part")
def g13_meta_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * F.when(F.lower("p_name").startswith("a"), 0.35).otherwise(1.0), 4).alias("score"))


@query(
    "g13_demoted_titles",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' / ' || p_type ELSE p_type || '/' || p_name END AS node, p_retailprice AS final FROM part),
    m AS (SELECT *, lower(node) AS full_name, trim(split_part(lower(node), '/', 1)) AS first FROM n), d AS (SELECT *, first IN ('promo', 'new', 'large gear') OR starts_with(full_name, 'promo') OR starts_with(full_name, 'new') OR contains(full_name, 'large gear') AS meta_demoted FROM m)
    SELECT p_partkey, node, round(CASE WHEN meta_demoted THEN final * 0.35 ELSE final END, 4) AS final, meta_demoted FROM d""",
)
def g13_demoted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under two names, of which three titles are given: one word counts at the beginning, two words count anywhere."""
    p, kind = table(spark, sf_dir, "part"), F.col("p_type")
    node = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" / "), kind)).otherwise(F.concat(kind, F.lit("/"), "p_name"))
    ranked = p.select("p_partkey", node.alias("node"), F.col("p_retailprice").alias("final"))
    return G.demote_meta_hubs(ranked, ("promo", "new", "large gear")).withColumn("final", F.round("final", 4))


@query(
    "g14_expand",
    f"""WITH {SMALL_SQL}, b AS (SELECT subject AS a, object AS b FROM g UNION SELECT object, subject FROM g), d0 AS (SELECT 'S1' AS node UNION SELECT 'S2'), d1 AS (SELECT DISTINCT b AS node FROM d0 JOIN b ON a = node), d2 AS (SELECT DISTINCT b AS node FROM d1 JOIN b ON a = node)
    SELECT node, min(depth)::INT AS depth, round(1.0 / (min(depth) + 1), 6)::DOUBLE AS score FROM (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node""",
)
def g14_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1, 3).select(F.concat(F.lit("S"), "id").alias("node"))
    return G.expand(small_graph(spark, sf_dir), seeds, 2).select("node", "depth", F.round(1.0 / (F.col("depth") + 1), 6).alias("score"))


@query(
    "g16_two_hop_pool",
    f"WITH {GRAPH_SQL}, s AS (SELECT subject, object FROM g WHERE subject IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8')) SELECT object AS mid, count(DISTINCT subject) AS landings FROM s GROUP BY object HAVING count(DISTINCT subject) >= 2",
)
def g16_two_hop_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph(spark, sf_dir).filter(F.col("subject").isin(*[f"S{i}" for i in range(1, 9)]))
    return s.groupBy(F.col("object").alias("mid")).agg(F.countDistinct("subject").alias("landings")).filter("landings >= 2")


@query(
    "g6_long_components",
    f"""WITH RECURSIVE {SMALL_SQL}, b AS (SELECT subject AS u, object AS v FROM g UNION SELECT object, subject FROM g), r(node, x) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.x), c AS (SELECT node, min(x) AS c FROM r GROUP BY node),
    d AS (SELECT u AS node, count(*) AS d FROM b GROUP BY u), k AS (SELECT c FROM c JOIN d USING (node) GROUP BY c HAVING count(*) >= 4 AND NOT (max(d) = count(*) - 1 AND sum(d) = 2 * (count(*) - 1))) SELECT subject, object FROM g JOIN c ON node = subject WHERE c IN (SELECT c FROM k)""",
)
def g6_long_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.long_components(small_graph(spark, sf_dir))


@query(
    "g9_alias_chains",
    "WITH RECURSIVE m AS (SELECT p_partkey AS alias, p_partkey - p_size AS target FROM part WHERE p_size < p_partkey), c(alias, x) AS (SELECT alias, target FROM m UNION ALL SELECT c.alias, m.target FROM c JOIN m ON m.alias = c.x) SELECT alias, min(x) AS canonical FROM c GROUP BY alias",
)
def g9_alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is an alias of the part as many numbers before it as its size, until there is none."""
    return chain_ends(table(spark, sf_dir, "part").filter("p_size < p_partkey").select(F.col("p_partkey").alias("alias"), (F.col("p_partkey") - F.col("p_size")).alias("target")))


@query(
    "g21_propagate",
    f"""WITH {HIERARCHY_SQL}, s AS (SELECT 'P' || p_partkey AS node, p_size / 50.0::DOUBLE AS score FROM part UNION ALL SELECT DISTINCT p_brand, 0.1 FROM part UNION ALL SELECT DISTINCT 'T' || p_type, 0.1 FROM part),
    e AS (SELECT subject, object, 0.22 / sqrt(count(*) OVER (PARTITION BY subject)) AS f FROM h), w1 AS (SELECT object AS node, sum(score * f) AS x FROM s JOIN e ON node = subject GROUP BY object), w2 AS (SELECT object AS node, sum(x * f) AS x FROM w1 JOIN e ON node = subject GROUP BY object),
    b AS (SELECT node, sum(x) AS b FROM (FROM w1 UNION ALL FROM w2) GROUP BY node), t AS (SELECT node, score + coalesce(b, 0) AS v FROM s LEFT JOIN b USING (node)) SELECT node, round(v / (SELECT max(v) FROM t), 6) AS score FROM t""",
)
def g21_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own = p.select(F.concat(F.lit("P"), "p_partkey").alias("node"), (F.col("p_size") / 50.0).alias("score"))
    up = p.select(F.explode(F.array("p_brand", F.concat(F.lit("T"), "p_type"))).alias("node")).distinct().withColumn("score", F.lit(0.1))
    return G.propagate_up(hierarchy(spark, sf_dir), own.unionByName(up)).select("node", F.round("score", 6).alias("score"))


@query(
    "g24_blend_classroom",
    "SELECT vec_id, round(CASE WHEN abs(c - p) <= 0.2 THEN p WHEN c > p THEN p + least(0.25, 0.15 * (c - p)) ELSE p - 0.22 * (p - c) END, 6) AS score FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) * 3 AS p, abs(embedding[2]::DOUBLE) * 3 AS c FROM embeddings)",
)
def g24_blend_classroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.abs(F.col("embedding")[i].cast("double")) * 3
    e = table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("p"), at(1).alias("c"))
    p, c = F.col("p"), F.col("c")
    s = F.when(F.abs(c - p) <= 0.2, p).when(c > p, p + F.least(F.lit(0.25), 0.15 * (c - p))).otherwise(p - 0.22 * (p - c))
    return e.select("vec_id", F.round(s, 6).alias("score"))


@query(
    "j10_hierarchy_shortcuts",
    f"""WITH {HIERARCHY_SQL}, e AS (SELECT subject, 'belong_to' AS relation, object FROM h WHERE starts_with(subject, 'P') UNION ALL SELECT subject, 'part_of', object FROM h WHERE NOT starts_with(subject, 'P') UNION ALL SELECT 'P' || p_partkey, 'part_of', 'T' || p_type FROM part)
    SELECT * FROM e WHERE NOT (relation = 'part_of' AND EXISTS (SELECT 1 FROM e a JOIN e b ON a.object = b.subject WHERE a.relation = 'belong_to' AND b.relation = 'part_of' AND a.subject = e.subject AND b.object = e.object))""",
)
def j10_hierarchy_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(spark, sf_dir)
    rel = F.when(F.col("subject").startswith("P"), "belong_to").otherwise("part_of")
    short = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("subject"), F.lit("part_of").alias("relation"), F.concat(F.lit("T"), "p_type").alias("object"))
    return K.without_shortcuts(h.select("subject", rel.alias("relation"), "object").unionByName(short))


@query("m1_orient_edges", f"WITH {TRIPLETS_SQL} SELECT row_id, object AS parent, subject AS child, CASE relation WHEN 'belong_to' THEN 1.0 ELSE 0.85 END::DOUBLE AS strength FROM t WHERE relation IN ('belong_to', 'part_of')")
def m1_orient_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir).filter(F.col("relation").isin("belong_to", "part_of"))
    return t.select("row_id", F.col("object").alias("parent"), F.col("subject").alias("child"), F.when(F.col("relation") == "belong_to", 1.0).otherwise(0.85).alias("strength"))


@query("m3_single_parent", f"WITH {TRIPLETS_SQL}, d AS (SELECT object, count(*) AS n FROM t GROUP BY object), e AS (SELECT DISTINCT subject, object FROM t WHERE relation = 'belong_to') SELECT subject AS child, object AS parent FROM e JOIN d USING (object) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, object) = 1")
def m3_single_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    n = t.groupBy("object").agg(F.count("*").alias("n"))
    e = t.filter("relation = 'belong_to'").select("subject", "object").distinct().join(n, "object")
    return e.groupBy(F.col("subject").alias("child")).agg(F.min_by("object", F.struct(-F.col("n"), F.col("object"))).alias("parent")).select("child", "parent")


@query("m7_closure", f"WITH {HIERARCHY_SQL} SELECT object AS ancestor, subject AS descendant, 1 AS dist FROM h UNION SELECT b.object, a.subject, 2 FROM h a JOIN h b ON b.subject = a.object")
def m7_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(spark, sf_dir)
    one = h.select(F.col("object").alias("ancestor"), F.col("subject").alias("descendant"), F.lit(1).alias("dist"))
    two = h.select(F.col("subject").alias("descendant"), F.col("object").alias("mid")).join(h.select(F.col("subject").alias("mid"), F.col("object").alias("ancestor")), "mid")
    return one.unionByName(two.select("ancestor", "descendant", F.lit(2).alias("dist")).distinct())


@query("m10_forest_stats", f"WITH {HIERARCHY_SQL}, n AS (SELECT subject AS x FROM h UNION SELECT object FROM h) SELECT count(*) AS nodes, sum((x NOT IN (SELECT subject FROM h))::INT)::BIGINT AS roots, sum((x NOT IN (SELECT object FROM h))::INT)::BIGINT AS leaves FROM n")
def m10_forest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(spark, sf_dir)
    ends = h.select(F.col("subject").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(h.select(F.col("object").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    n = ends.groupBy("x").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return n.agg(F.count("*").alias("nodes"), F.count_if(F.col("up") == 0).alias("roots"), F.count_if(F.col("down") == 0).alias("leaves"))


@query("i2_board_channel", f"WITH {TRIPLETS_SQL} SELECT object AS entity, sum(1 + CASE WHEN lecture % 4 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS score FROM t GROUP BY object")
def i2_board_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).groupBy(F.col("object").alias("entity")).agg(F.sum(1 + F.when(F.col("lecture") % 4 == 0, 0.25).otherwise(0.0)).alias("score"))


@query("i4_structure_channel", f"WITH {TRIPLETS_SQL}, d AS (SELECT object AS entity, count(DISTINCT subject) AS d FROM t GROUP BY object) SELECT entity, round(ln(1 + d) * CASE WHEN d <= 1 THEN 0.55 WHEN d <= 2 THEN 0.75 ELSE 1.35 END, 6) AS score FROM d")
def i4_structure_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = triplets(spark, sf_dir).groupBy(F.col("object").alias("entity")).agg(F.countDistinct("subject").alias("d"))
    return d.select("entity", F.round(F.log1p("d") * F.when(F.col("d") <= 1, 0.55).when(F.col("d") <= 2, 0.75).otherwise(1.35), 6).alias("score"))


@query(
    "i5_blend_channels",
    f"""WITH {TRIPLETS_SQL}, a AS (SELECT object AS entity, count(*)::DOUBLE AS s FROM t GROUP BY object), b AS (SELECT object AS entity, sum(weight)::DOUBLE AS s FROM t GROUP BY object),
    na AS (SELECT entity, coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0.5) AS x FROM a), nb AS (SELECT entity, coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0.5) AS y FROM b)
    SELECT coalesce(na.entity, nb.entity) AS entity, round((0.6 * coalesce(x, 0) + 0.2 * coalesce(y, 0)) / 0.8, 6) AS score FROM na FULL JOIN nb ON na.entity = nb.entity""",
)
def i5_blend_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scaled(c: DataFrame, name: str) -> DataFrame:
        ends = F.broadcast(c.agg(F.min("s").alias("lo"), F.max("s").alias("hi")))  # one row
        return c.crossJoin(ends).select("entity", F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias(name))

    t = triplets(spark, sf_dir)
    a = t.groupBy(F.col("object").alias("entity")).agg(F.count("*").cast("double").alias("s"))
    b = t.groupBy(F.col("object").alias("entity")).agg(F.sum("weight").alias("s"))
    both = scaled(a, "x").join(scaled(b, "y"), "entity", "full")
    return both.select("entity", F.round((0.6 * F.coalesce("x", F.lit(0.0)) + 0.2 * F.coalesce("y", F.lit(0.0))) / 0.8, 6).alias("score"))


@query("i6_lecture_idf", f"WITH {TRIPLETS_SQL}, d AS (SELECT subject AS entity, count(*) AS c, count(DISTINCT lecture) AS df FROM t GROUP BY subject) SELECT entity, round(c * ln(1 + 40.0::DOUBLE / df), 6) AS score FROM d")
def i6_lecture_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = triplets(spark, sf_dir).groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("c"), F.countDistinct("lecture").alias("df"))
    return d.select("entity", F.round(F.col("c") * F.log1p(40.0 / F.col("df")), 6).alias("score"))
