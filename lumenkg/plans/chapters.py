"""Rules of chapters, theorems, contents, labels and contexts on sample texts, beside their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.operators import textbook as B
from lumenkg.plans.rules import pick, pick_sql, quoted
from lumenkg.registry import query
from lumenkg.sources.tables import table

TITLES = ["第1章 集合与关系", "第 12 章 图论", "函数", "第3章 树、平面图 和 欧拉图", "第4章"]
NAMES = ["图论/graph theory", "平面图", "集合/sets", "关系", "欧拉图的性质/Euler", "trees", "树", ""]
TEXTS = ["第12章讲图论和集合与关系", "平面图与欧拉图", "Nothing here", "", "树、平面图和欧拉图都是图", "函数 函数", "集合 第4章"]

CLEAN = "regexp_replace(lower({}), '[^一-龥a-z0-9]', '', 'g')"
BARE = "trim(regexp_replace(trim({}), '^第\\s*\\d+\\s*章\\s*', ''))"
KEYS_SQL = f"""t AS (SELECT unnest([{", ".join(map(quoted, TITLES))}]) AS title), b AS (SELECT title, {BARE.format("title")} AS bare FROM t),
    p AS (SELECT title, bare, list_filter(string_split_regex(bare, '[与和及、,，/\\s]+'), lambda x: length(x) >= 2) AS parts FROM b),
    k AS (SELECT title, bare, list_transform(CASE WHEN bare <> '' AND NOT list_contains(parts, bare) THEN list_concat([bare], parts) ELSE parts END, lambda x: {CLEAN.format("x")}) AS keys FROM p)"""


def per_title(df: DataFrame) -> DataFrame:
    return df.withColumn("title", F.explode(F.array(*map(F.lit, TITLES))))


@query(
    "j21_chapter_scores",
    f"""WITH {KEYS_SQL}, x AS (SELECT p_partkey, {pick_sql(TEXTS, "p_partkey")} AS text FROM part), c AS (SELECT *, {CLEAN.format("text")} AS blob FROM x),
    s AS (SELECT p_partkey, title, blob, text, CASE WHEN {CLEAN.format("bare")} <> '' AND contains(blob, {CLEAN.format("bare")}) THEN CASE WHEN length({CLEAN.format("bare")}) <= 2 THEN 1.2 ELSE 5.0 END ELSE 0.0 END::DOUBLE AS whole,
      coalesce(list_sum(list_transform(list_filter(keys, lambda q: q <> '' AND contains(blob, q)), lambda q: CASE WHEN length(q) <= 2 THEN 0.35 ELSE 1.0 + 0.2 * least(length(q), 12) END)), 0)::DOUBLE AS hits, regexp_extract(title, '第\\s*(\\d+)\\s*章', 1) AS no FROM c, k)
    SELECT p_partkey, title, round(CASE WHEN blob = '' THEN 0.0 ELSE whole + hits + CASE WHEN no <> '' AND contains(text, '第' || no || '章') THEN 8.0 ELSE 0.0 END END, 6)::DOUBLE AS score FROM s""",
)
def j21_chapter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_title(table(spark, sf_dir, "part").select("p_partkey", pick(TEXTS, F.col("p_partkey")).alias("text")))
    return rows.select("p_partkey", "title", F.round(B.chapter_text_score(F.col("title"), F.col("text")), 6).alias("score"))


_AFFINITY = "coalesce(list_max(list_transform(list_filter(keys, lambda q: q <> ''), lambda q: CASE WHEN q = own THEN 20.0 + length(q) WHEN contains(own, q) OR contains(q, own) THEN least(length(q), length(own)) ELSE 0.0 END)), 0)"


@query(
    "j21_entity_affinity",
    f"""WITH {KEYS_SQL}, x AS (SELECT p_partkey, {CLEAN.format("trim(split_part(" + pick_sql(NAMES, "p_partkey") + ", '/', 1))")} AS own FROM part), a AS (SELECT p_partkey, title, own, CASE WHEN own = '' THEN 0 ELSE {_AFFINITY} END::DOUBLE AS score FROM x, k)
    SELECT p_partkey, title, score, length(own) > 2 AND max(score) OVER (PARTITION BY p_partkey) > score + 1 AS elsewhere FROM a""",
)
def j21_entity_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_title(table(spark, sf_dir, "part").select("p_partkey", pick(NAMES, F.col("p_partkey")).alias("name")))
    name, title = F.col("name"), F.col("title")
    return rows.select("p_partkey", "title", B.chapter_affinity(name, title).alias("score"), B.prefers_other(name, title, TITLES).alias("elsewhere"))


THEOREMS = ["握手定理", "Euler's formula", " ", "Kuratowski/库拉托夫斯基", "!!!"]


@query(
    "g22_theorem_relations",
    f"""WITH e AS (SELECT p_brand AS name, trim({pick_sql(THEOREMS, "p_partkey")}) AS raw, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS content, p_partkey AS pos FROM part), r AS (SELECT *, lower(replace(trim(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ', '_')) AS word FROM e WHERE raw <> ''),
    f AS (SELECT CASE WHEN contains(raw, '/') THEN raw WHEN word = '' THEN raw || '/theorem' ELSE raw || '/' || word END AS subject, 'belong_to' AS predicate, name AS object, CASE WHEN content <> '' THEN content ELSE raw || '是' || split_part(name, '/', 1) || '中的定理。' END AS description, '教材定理：' || raw AS context, pos FROM r)
    SELECT subject, predicate, object, arg_min(description, pos) AS description, arg_min(context, pos) AS context FROM f GROUP BY subject, predicate, object""",
)
def g22_theorem_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(k.alias("k"), pick(THEOREMS, k).alias("name"), F.when(k % 3 == 0, F.col("p_name")).otherwise("").alias("content"))
    return B.theorem_edges(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_list(one)).alias("theorems")))


LINES = ["# 第1章 集合", "## 1.2 关系", "### 1.2.3 闭包", "plain text", "#no space", "#### 4.", "# Appendix"]


@query(
    "x30_toc_items",
    f"""WITH l AS (SELECT user_id, event_id, trim({pick_sql(LINES, "event_id")}) AS line FROM events), x AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+.+', 1)) AS level FROM l WHERE starts_with(line, '#')),
    r AS (SELECT *, CASE WHEN level > 0 THEN trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1)) ELSE line END AS raw FROM x), t AS (SELECT *, trim(regexp_replace(raw, '^(第\\d+章|[\\d\\.]+)\\s*', '')) AS bare FROM r)
    SELECT user_id, event_id, level::INT AS level, raw, CASE WHEN bare <> '' THEN bare ELSE raw END AS text, CASE WHEN level <= 2 THEN 20 ELSE 10 END AS score, coalesce(last_value(CASE WHEN level <= 2 THEN raw END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), raw) AS chapter FROM t""",
)
def x30_toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.toc_items(table(spark, sf_dir, "events").select("user_id", "event_id", pick(LINES, F.col("event_id")).alias("line")), "user_id", "event_id")


ASKED = ["第三讲讲什么", "Lecture 12 on trees", "第 07 讲", "no lecture", "第十一讲"]
LECTURES = ["L1", "lecture_01", "007", "intro", " ", "L000"]


@query(
    "x28_lecture_labels",
    f"""WITH q AS (SELECT event_id, {pick_sql(ASKED, "event_id")} AS q, trim({pick_sql(LECTURES, "event_id")}) AS l, event_id % 7 - 2 AS a, event_id % 5 AS b FROM events),
    h AS (SELECT *, coalesce(nullif(regexp_extract(q, '第\\s*([0-9一二三四五六七八九十]+)\\s*讲', 1), ''), nullif(regexp_extract(q, '(?i)lecture\\s*([0-9]+)', 1), '')) AS f, regexp_extract(l, '(\\d+)', 1) AS d FROM q),
    o AS (SELECT *, CASE WHEN d <> '' THEN d::BIGINT::VARCHAR WHEN l <> '' THEN l ELSE '?' END AS n FROM h)
    SELECT event_id, CASE f WHEN '一' THEN '1' WHEN '二' THEN '2' WHEN '三' THEN '3' WHEN '四' THEN '4' WHEN '五' THEN '5' ELSE f END AS hint, '第' || n || '讲的第' || greatest(1, a) || '段到第' || greatest(1, a, b) || '段' AS label, true AS is_label FROM o""",
)
def x28_lecture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    label = B.span_label(pick(LECTURES, k), k % 7 - 2, k % 5)
    return table(spark, sf_dir, "events").select("event_id", B.lecture_hint(pick(ASKED, k)).alias("hint"), label.alias("label"), B.is_span_label(label).alias("is_label"))


@query(
    "r11_hit_contexts",
    """WITH h AS (SELECT vec_id AS i, ['entity', 'edge', 'item'][vec_id % 3 + 1] AS type, label / 4.0 AS score, CASE WHEN vec_id % 5 > 0 THEN 'text about e' || (vec_id % 7) END AS t, 'e' || (vec_id % 9) AS e, CASE WHEN vec_id % 2 = 0 THEN 'defined' END AS d, CASE WHEN vec_id % 4 > 0 THEN 's' ELSE '' END AS sub FROM embeddings),
    g AS (SELECT *, trim(coalesce(t, '')) AS x FROM h)
    SELECT i AS vec_id, array_to_string(list_filter([ '[' || type || '] score=' || printf('%.3f', score), CASE WHEN x <> '' THEN '检索文档：' || x END,
      CASE WHEN type = 'entity' AND NOT contains(x, e) THEN '实体：' || e END, CASE WHEN type = 'entity' AND d IS NOT NULL THEN '定义：' || d END,
      CASE WHEN type = 'edge' AND NOT contains(x, e) THEN '关系：' || e END, CASE WHEN type = 'edge' AND sub <> '' THEN '(' || sub || ') --[part_of]--> ()' END,
      CASE WHEN type = 'edge' THEN '课程原文2：second' END, CASE WHEN type = 'edge' AND d IS NOT NULL THEN '摘录：' || d END, CASE WHEN type = 'edge' THEN '字幕：' || repeat('y', 500) END, CASE WHEN type = 'edge' THEN 'cue：c' || i END,
      CASE WHEN type = 'edge' AND sub <> '' THEN '视频证据：s (1.0s–2.5s)' END, CASE WHEN type = 'edge' AND sub <> '' THEN 'PPT证据：s (page 3)' END, CASE WHEN type = 'edge' THEN '音频-文本对齐分：0.250' END], lambda z: z IS NOT NULL AND z <> ''), chr(10)) AS context FROM g""",
)
def r11_hit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    name, kind, d = F.concat(F.lit("e"), i % 9), pick(["entity", "edge", "item"], i), F.when(i % 2 == 0, "defined")
    s, none = F.when(i % 4 > 0, "s").otherwise(""), F.lit("")
    h = {
        "type": kind, "score": F.col("label") / 4.0, "text": F.when(i % 5 > 0, F.concat(F.lit("text about e"), i % 7)), "entity": name, "description": d, "statement": name, "subject": s, "object": none, "relation": F.lit("part_of"),
        "snippets": F.array(F.lit(""), F.lit("second"), F.lit("third")), "context": d, "source_text": F.repeat(F.lit("y"), 600), "cue": F.concat(F.lit("c"), i), "clip": s, "start": F.lit(1.0), "end": F.lit(2.5), "frame": s, "page": F.lit(3),
        "audio": F.lit(0.25), "image": F.lit(None).cast("double"),
    }
    return table(spark, sf_dir, "embeddings").select("vec_id", B.hit_context(h).alias("context"))


@query(
    "r12_answer_images",
    """WITH p AS (SELECT user_id, event_type || (event_id % 4) AS path, 1 AS priority, event_id AS place FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id, 'user' || (event_id % 3), 0, event_id FROM events WHERE event_id % 9 = 0),
    o AS (SELECT user_id, path, min(priority * 100000000 + place) AS o FROM p GROUP BY ALL) SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY o, path)::INT AS place FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY o, path) <= 6""",
)
def r12_answer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's own pictures first, then the evidence's, six at most."""
    e = table(spark, sf_dir, "events")
    own = e.filter("event_id % 9 = 0").select("user_id", F.concat(F.lit("user"), F.col("event_id") % 3).alias("path"), F.lit(0).alias("priority"), F.col("event_id").alias("place"))
    found = e.select("user_id", F.when(F.col("event_type") != "view", F.concat("event_type", F.col("event_id") % 4)).alias("path"), F.lit(1).alias("priority"), F.col("event_id").alias("place"))
    return B.first_paths(found.unionByName(own), "user_id", 6)


@query(
    "j1_filled_provenance",
    """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS cue_id, CASE WHEN l_linenumber % 2 = 0 THEN 'c' ELSE '' END AS context, CASE WHEN l_linenumber % 3 = 0 THEN 'L' || l_linenumber ELSE '' END AS lecture_id, CASE WHEN l_linenumber % 4 = 0 THEN 5.0 END::DOUBLE AS start_sec, 0.0::DOUBLE AS end_sec, NULL::VARCHAR AS clip_path,
      'frame' AS ppt_frame_path, 0 AS ppt_page_index, l_comment AS source_text FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN '' ELSE l_shipmode END AS l_comment FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem))),
    c AS (SELECT o_orderkey, o_orderpriority, (o_custkey % 60)::DOUBLE AS s, (o_custkey % 60 + 9)::DOUBLE AS e, (o_custkey % 5)::INT AS page FROM orders WHERE o_orderkey % 7 > 0),
    f AS (SELECT id, cue_id, context, coalesce(nullif(lecture_id, ''), nullif(o_orderpriority, ''), lecture_id) AS lecture_id, coalesce(nullif(start_sec, 0), s, start_sec) AS start_sec, coalesce(e, end_sec) AS end_sec, o_orderpriority AS clip_path, ppt_frame_path, coalesce(page, ppt_page_index) AS ppt_page_index, coalesce(nullif(source_text, ''), o_orderpriority, source_text) AS source_text FROM p LEFT JOIN c ON o_orderkey = cue_id)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cue_id, context, start_sec, end_sec ORDER BY id) = 1""",
)
def j1_filled_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat an id are taken in the order of the table, as the SQL's engine does on one thread."""
    n, place = F.col("l_linenumber"), [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    p = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("cue_id"), F.when(n % 2 == 0, "c").otherwise("").alias("context"), F.when(n % 3 == 0, F.concat(F.lit("L"), n)).otherwise("").alias("lecture_id"), F.when(n % 4 == 0, 5.0).alias("start_sec"), F.lit(0.0).alias("end_sec"),
        F.lit(None).cast("string").alias("clip_path"), F.lit("frame").alias("ppt_frame_path"), F.lit(0).alias("ppt_page_index"), F.when(n == 1, "").otherwise(F.col("l_returnflag")).alias("source_text"), *place,
    )
    s, text = (F.col("o_custkey") % 60).cast("double"), F.col("o_orderpriority")
    c = table(spark, sf_dir, "orders").filter("o_orderkey % 7 > 0").select(
        F.col("o_orderkey").alias("cue_id"), text.alias("lecture_id"), s.alias("start_sec"), (s + 9).alias("end_sec"), text.alias("clip_path"), text.alias("ppt_frame_path"), (F.col("o_custkey") % 5).cast("int").alias("ppt_page_index"), text.alias("source_text")
    )
    return B.filled_provenance(p, c, "id", "_file", "_row").drop("_file", "_row")
