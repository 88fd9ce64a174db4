"""Round trips through files of the course formats, and rules of shown names and property sentences, beside their SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.functions import text as T
from lumenkg.functions.rules import first_failure
from lumenkg.operators import graph as G
from lumenkg.operators import retrieval as R
from lumenkg.operators import textbook as B
from lumenkg.plans.rules import pick, pick_sql
from lumenkg.registry import query
from lumenkg.sources import files
from lumenkg.sources.tables import TRIPLETS_SQL, table, triplets


def folder(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, where driver and executors both write."""
    G.shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("s1_s2_json_lines", "SELECT item_id, text FROM benchmark")
def s1_s2_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark)
    files.write_jsonl(table(spark, sf_dir, "benchmark"), at)
    return files.read_jsonl(spark, at, "item_id long, text string").select("item_id", "text")


@query(
    "s5_s7_subtitles",
    """WITH c AS (SELECT event_id AS pos, (event_id * 7) % 80000 AS s, event_type || CASE WHEN event_id % 4 = 0 THEN ' and  more' ELSE '' END AS t FROM events) SELECT s::DOUBLE AS start_sec, (s + 1 + pos % 9)::DOUBLE AS end_sec, regexp_replace(t, '\\s+', ' ', 'g') AS text FROM c""",
)
def s5_s7_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as subtitle blocks and read again, white space normalised."""
    k = F.col("event_id")
    start = (k * 7) % 80000
    cues = table(spark, sf_dir, "events").select(k.cast("int").alias("pos"), start.cast("double").alias("start_sec"), (start + 1 + k % 9).cast("double").alias("end_sec"), F.concat("event_type", F.when(k % 4 == 0, " and  more").otherwise("")).alias("text"))
    at = folder(spark)
    files.srt_lines(cues).select("value").write.text(at)
    return files.read_srt(spark, at).select("start_sec", "end_sec", "text")


@query("s8_time_nodes", "SELECT DISTINCT (p_partkey % 3000)::DOUBLE AS sec FROM part WHERE p_partkey % 10 <> 0")
def s8_time_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 3000).cast("double")
    at = folder(spark)
    table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 0, "# a remark").otherwise(T.minutes_seconds(k)).alias("value")).write.text(at)
    return files.read_time_nodes(spark, at)


IMPORTANCE = "SELECT n_name AS entity, NULL::VARCHAR AS chapter, n_nationkey::DOUBLE AS score FROM nation"


@query(
    "s10_importance_shapes",
    f"WITH g AS ({IMPORTANCE}) FROM g UNION ALL FROM g UNION ALL FROM g UNION ALL FROM g UNION ALL SELECT n_name, 'c' || n_regionkey, n_nationkey + 0.5 FROM nation",
)
def s10_importance_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One importance table written as a map, as pairs, as records and as a bundle with chapters; all four are read alike."""
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("double").alias("s"), F.concat(F.lit("c"), "n_regionkey").alias("c"))  # a fixed table of 25 rows
    at = folder(spark)
    whole = F.map_from_entries(F.collect_list(F.struct("n_name", "s")))
    by = n.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("s") + 0.5))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("chapters"))
    shapes = [
        n.agg(F.to_json(whole).alias("value")),
        n.agg(F.to_json(F.collect_list(F.array("n_name", F.col("s").cast("string")))).alias("value")),
        n.agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("s").alias("score")))).alias("value")),
        n.agg(whole.alias("global")).crossJoin(by).select(F.to_json(F.struct("global", "chapters")).alias("value")),  # one row each
    ]
    for i, shape in enumerate(shapes):
        shape.write.text(f"{at}/{i}")
    return files.importance_rows(spark, f"{at}/*").select("entity", "chapter", "score")


@query(
    "s9_textbook_graph",
    f"""WITH {TRIPLETS_SQL}, e AS (SELECT DISTINCT subject AS name FROM t UNION SELECT object FROM t UNION SELECT 'P' || p_partkey FROM part), l AS (SELECT 'P' || p_partkey AS name, p_size::DOUBLE AS importance FROM part), i AS (SELECT 'P' || p_partkey AS name, max(p_retailprice) AS top FROM part WHERE p_partkey % 3 = 0 GROUP BY p_partkey)
    SELECT name, coalesce(top, importance) AS importance FROM e LEFT JOIN l USING (name) LEFT JOIN i USING (name)""",
)
def s9_textbook_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed entities and all ends of relations; a global importance replaces the listed one."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_size").cast("double").alias("importance"), "p_partkey", "p_retailprice")
    relations = triplets(spark, sf_dir).select("subject", F.col("relation").alias("predicate"), "object")
    top = p.filter("p_partkey % 3 = 0").select(F.col("name").alias("entity"), F.lit(None).cast("string").alias("chapter"), F.col("p_retailprice").alias("score"))
    return files.textbook_graph(p.select("name", "importance"), relations, top)[0].select("name", "importance")


@query("s19_saved_index", "WITH d AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) SELECT term, item_id, count(*) AS tf FROM d GROUP BY ALL")
def s19_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written as a table and loaded again."""
    at = folder(spark)
    R.postings(table(spark, sf_dir, "benchmark"), T.tokens(F.col("text")), "item_id").write.parquet(at)
    return spark.read.parquet(at).select("term", "item_id", "tf")


SHOWN = ["集合论/set theory", "x", "a,b", "下标约定", "转化为范式", "命题的形式化", "推理语言", "abc", "sets and maps", "", "...", "图", "这是一个没有条件的很长的名字"]


@query(
    "f17_unfit_nodes",
    f"""WITH n AS (SELECT p_partkey, trim(split_part(trim({pick_sql(SHOWN, "p_partkey")}), '/', 1)) AS z FROM part), h AS (SELECT *, regexp_matches(z, '[一-鿿]') AS han FROM n)
    SELECT p_partkey, z = '' OR (length(z) = 1 AND NOT han) OR regexp_full_match(lower(replace(z, ' ', '')), '[a-z](,[a-z])+|\\.{{2,}}|…|[a-z]{{1,2}}') OR z IN ('推理语言', '形式化逻辑系统') OR regexp_matches(z, '字母|括号|符号|记号|下标|上标|空白|空格|标点|逗号|句号|自然语言|日常生活|英文|单词|粒度')
      OR (regexp_matches(z, '不能|没有|无需|转化为|翻译成|方式|条件|描述|表示|只能|独立于') AND length(z) <= 8) OR regexp_matches(z, '(转化为|形式化|实例化|约束化|展开|赋值|指派|解释)$') OR (NOT han AND regexp_full_match(z, '[a-zA-Z0-9,.\\s…]{{1,6}}')) AS unfit FROM h""",
)
def f17_unfit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", B.unfit_node(pick(SHOWN, F.col("p_partkey"))).alias("unfit"))


WORDS = ["", "集合有限。后面还有", "  ", "a statement"]
PHRASES = ["", "用…表示", "是集合的属性", "有"]
WAYS = ["subject_to_object", "object_to_subject", "", "odd"]


@query(
    "v8_property_sentences",
    f"""WITH e AS (SELECT p_partkey AS k, {pick_sql(WORDS, "p_partkey // 2")} AS d, {pick_sql(WORDS, "p_partkey // 5 + 2")} AS s, {pick_sql(WORDS, "p_partkey // 7")} AS c, trim({pick_sql(PHRASES, "p_partkey")}) AS f, {pick_sql(WAYS, "p_partkey // 4")} AS w, '基数' || (p_partkey % 3) AS p, ['集合', 'set', '?'][p_partkey % 3 + 1] AS o FROM part),
    x AS (SELECT *, replace(CASE WHEN f = '' THEN '具有属性' ELSE f END, '…', p) AS g, CASE WHEN contains(d, '。') THEN '集合有限。' ELSE trim(d) END AS d1, CASE WHEN contains(c, '。') THEN '集合有限。' ELSE trim(c) END AS c1 FROM e)
    SELECT k AS p_partkey, CASE WHEN d1 <> '' THEN d1 WHEN trim(s) <> '' THEN trim(s) WHEN c1 <> '' THEN c1 WHEN w NOT IN ('subject_to_object', '') THEN o || g || p WHEN ends_with(g, '的属性') OR contains(g, p) THEN p || CASE WHEN contains(g, o) THEN g ELSE '是' || o || '的属性' END ELSE p || g || o END AS sentence FROM x""",
)
def v8_property_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    e = {"description": pick(WORDS, F.floor(k / 2)), "statement": pick(WORDS, F.floor(k / 5) + 2), "context": pick(WORDS, F.floor(k / 7)), "phrase": pick(PHRASES, k), "direction": pick(WAYS, F.floor(k / 4)), "property": F.concat(F.lit("基数"), k % 3), "owner": pick(["集合/set", "set", " "], k)}
    return table(spark, sf_dir, "part").select("p_partkey", B.property_sentence(e).alias("sentence"))


@query(
    "v3_structural_split",
    f"""WITH {TRIPLETS_SQL}, r AS (SELECT row_id, CASE WHEN subject = object THEN 'self_loop' WHEN trim(statement) = '' THEN 'concrete_empty' WHEN length(replace(statement, ' ', '')) > 4 AND lecture > 20 THEN 'concrete_too_long'
    WHEN lecture % 3 = 0 THEN 'bad_direction' WHEN NOT contains(lower(statement), 'line') THEN 'context_not_in_source' END AS reason FROM t) SELECT row_id, CASE WHEN reason IS NULL THEN 'pass' ELSE 'discard' END AS verdict, reason FROM r""",
)
def v3_structural_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in for a model that is not there: the structural rules alone pass or discard."""
    c = F.col
    phrase = F.when(c("statement") == "", "").when(c("lecture") > 20, F.concat("statement", F.lit(" more"))).otherwise(F.lit("is"))
    parts = {"subject": c("subject"), "object": c("object"), "relation": c("relation"), "phrase": phrase, "direction": F.when(c("lecture") % 3 == 0, "sideways").otherwise("subject_to_object"), "context": F.lit("line"), "source": c("statement")}
    return triplets(spark, sf_dir).select("row_id", first_failure(parts).alias("reason")).select("row_id", F.when(c("reason").isNull(), "pass").otherwise("discard").alias("verdict"), "reason")
