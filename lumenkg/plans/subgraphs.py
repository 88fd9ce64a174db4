"""Subgraphs of cues: every hundredth cue asks for the part of the whole graph that it is about."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.operators.graph import cut
from lumenkg.operators.subgraph import capped_seeds, merged_names, retrieve_subgraphs, subgraph_entities
from lumenkg.registry import query
from lumenkg.sources.tables import TRIPLETS_SQL, triplets

ENDS = ("subject", "object")


def cue_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph of all triplets; a cue's candidates are the ends of its own lines, its seeds those of weight 20 and more, which its text names too.

    A part whose number ends in 9 is another name of the one before; importance is the share of the highest degree.
    """
    t = triplets(spark, sf_dir)
    edges = cut(t.groupBy("subject", "relation", "object").agg(F.min("statement").alias("description")))
    degree = edges.select(F.explode(F.array(*ENDS)).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    importance = degree.crossJoin(F.broadcast(degree.agg(F.max("d").alias("top")))).select("node", (F.col("d") / F.col("top")).alias("importance"))  # one row
    importance = cut(importance)
    number = F.substring("object", 2, 9).cast("int")
    aliases = t.select("object").distinct().filter(number % 10 == 9).select(F.col("object").alias("alias"), F.concat(F.lit("P"), number - 1).alias("canonical"))
    asked = t.filter("cue % 100 = 0").withColumnRenamed("cue", "qid")
    pool = asked.select("qid", "weight", F.explode(F.array(*ENDS)).alias("node"))
    seeds = pool.filter("weight >= 20").select("qid", "node", F.length("node").alias("matched"))
    lines = F.array_sort(F.collect_list(F.struct("row_id", F.concat_ws(" ", *ENDS).alias("x"))))
    texts = asked.filter("weight >= 20").groupBy("qid").agg(F.array_join(F.transform(lines, lambda s: s["x"]), " ").alias("text"))
    return {"edges": edges, "seeds": seeds, "pool": pool.select("qid", "node").distinct(), "texts": texts, "importance": importance, "aliases": aliases}


def subgraphs_sql(pool_only: bool, most: int, floor: float | None, limit: int) -> str:
    """CTEs up to f: the edges found."""
    kept = "inp OR br" if pool_only else "true"
    cut = "true" if floor is None else f"score >= {floor}" + (" AND inp" if pool_only else "")
    return f"""{TRIPLETS_SQL}, g AS (SELECT subject, relation, object, min(statement) AS description FROM t GROUP BY ALL),
    dg AS (SELECT node, count(*) AS d FROM (SELECT subject AS node FROM g UNION ALL SELECT object FROM g) GROUP BY node), im AS (SELECT node, d / (SELECT max(d) FROM dg) AS importance FROM dg),
    al AS (SELECT DISTINCT object AS alias, 'P' || (substr(object, 2)::INT - 1) AS canonical FROM t WHERE substr(object, 2)::INT % 10 = 9),
    x0 AS (SELECT cue AS qid, unnest([subject, object]) AS node, weight FROM t WHERE cue % 100 = 0),
    x AS (SELECT qid, coalesce(canonical, node) AS node, weight, length(node) AS matched FROM x0 LEFT JOIN al ON alias = node),
    po AS (SELECT DISTINCT qid, node FROM x),
    se AS (SELECT qid, node FROM (SELECT qid, x.node, max(matched) AS matched FROM x WHERE weight >= 20 GROUP BY ALL) m LEFT JOIN im USING (node)
           QUALIFY row_number() OVER (PARTITION BY qid ORDER BY matched DESC, coalesce(importance, 0) DESC, node) <= {most}),
    tx AS (SELECT cue AS qid, regexp_replace(lower(string_agg(subject || ' ' || object, ' ' ORDER BY row_id)), '[^a-z0-9]', '', 'g') AS txt FROM t WHERE cue % 100 = 0 AND weight >= 20 GROUP BY cue),
    c AS (SELECT qid, subject, relation, object, max(f) AS fs, max(o) AS ts FROM (SELECT qid, g.subject, relation, object, 1 AS f, 0 AS o FROM g JOIN se ON node = subject UNION ALL SELECT qid, subject, relation, object, 0, 1 FROM g JOIN se ON node = object) GROUP BY ALL),
    md AS (SELECT qid, CASE WHEN fs = 1 THEN object ELSE subject END AS mid FROM c WHERE fs + ts = 1 GROUP BY ALL HAVING count(DISTINCT CASE WHEN fs = 1 THEN subject ELSE object END) >= 2),
    k AS (SELECT c.*, p1.node IS NOT NULL AND p2.node IS NOT NULL AS inp, md.mid IS NOT NULL AS br FROM c LEFT JOIN po p1 ON p1.qid = c.qid AND p1.node = c.subject LEFT JOIN po p2 ON p2.qid = c.qid AND p2.node = c.object
          LEFT JOIN md ON md.qid = c.qid AND c.fs + c.ts = 1 AND md.mid = CASE WHEN c.fs = 1 THEN c.object ELSE c.subject END),
    sc AS (SELECT k.qid, k.subject, k.relation, k.object, inp, round(CASE k.relation WHEN 'belong_to' THEN 3.0 WHEN 'depend_on' THEN 2.0 ELSE 1.0 END::DOUBLE + 3 * (fs + ts) + 4 * contains(txt, lower(k.subject))::INT + 4 * contains(txt, lower(k.object))::INT
           + 2 * (description <> '' AND contains(txt, replace(description, ' ', '')))::INT + 10 * (i1.importance + i2.importance), 6)::DOUBLE AS score
           FROM k JOIN g ON g.subject = k.subject AND g.relation = k.relation AND g.object = k.object JOIN im i1 ON i1.node = k.subject JOIN im i2 ON i2.node = k.object JOIN tx ON tx.qid = k.qid WHERE {kept}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, subject, relation, object)::INT AS rank FROM sc WHERE {cut} QUALIFY rank <= {limit}),
    f AS (SELECT qid, coalesce(a1.canonical, subject) AS subject, relation, coalesce(a2.canonical, object) AS object, score, rank FROM rk LEFT JOIN al a1 ON a1.alias = subject LEFT JOIN al a2 ON a2.alias = object
          WHERE coalesce(a1.canonical, subject) <> coalesce(a2.canonical, object) QUALIFY row_number() OVER (PARTITION BY qid, coalesce(a1.canonical, subject), relation, coalesce(a2.canonical, object) ORDER BY rank) = 1)"""


@query("g17_subgraphs", f"WITH {subgraphs_sql(True, 5, None, 60)} SELECT qid, subject, relation, object, score, rank FROM f")
def g17_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside the pool, and bridges between seeds; the 60 best of a cue."""
    return retrieve_subgraphs(**cue_inputs(spark, sf_dir), most_seeds=5, limit=60)


@query("g17_pruned_subgraphs", f"WITH {subgraphs_sql(False, 5, 16.0, 60)} SELECT qid, subject, relation, object, score, rank FROM f")
def g17_pruned_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any edge beside a seed whose score is 16 or more; the 60 best of a cue."""
    return retrieve_subgraphs(**cue_inputs(spark, sf_dir), most_seeds=5, both_in_pool=False, min_score=16.0, limit=60)


@query("g17_subgraph_entities", f"WITH {subgraphs_sql(True, 5, 4.0, 60)} SELECT qid, node, max(seed) AS seed FROM (SELECT qid, subject AS node, false AS seed FROM f UNION ALL SELECT qid, object, false FROM f UNION ALL SELECT qid, node, true FROM se) GROUP BY qid, node")
def g17_subgraph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of each cue's subgraph, cut at a score of 4."""
    inputs = cue_inputs(spark, sf_dir)
    seeds = capped_seeds(merged_names(inputs["seeds"], inputs["aliases"], "node"), inputs["importance"], 5)
    return subgraph_entities(retrieve_subgraphs(**inputs, most_seeds=5, min_score=4.0, limit=60), seeds)
