"""Rules whose words do not occur in the driver tables: each row gets one of a few sample texts by its key, in the query and in its SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.operators import align as A
from lumenkg.operators import cards as C
from lumenkg.operators import course as O
from lumenkg.operators import dialogue as D
from lumenkg.operators import folds
from lumenkg.operators import views as V
from lumenkg.registry import query
from lumenkg.sources.tables import cues, table, triplets


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(texts: list[str], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, texts)), (key % len(texts)).cast("int"))


def pick_sql(texts: list[str], key: str) -> str:
    return f"[{', '.join(map(quoted, texts))}][({key}) % {len(texts)} + 1]"


# Sample cards: names, formulas and evidence that meet each rule, and some that meet none.
FORMULAS = "微积分基本公式|A点谓词 / point A|苏格拉底终有一死|P(x,y)定义为和/P|两数之和/sum|LittleBrother(x)|小红 Embrace(a)|个体常项 a、b|删去顶点/G-v|集合记号|个体记号|边的权值都设为 1|握手定理/handshake|完全图的边数公式|分离规则|平面图".split("|")
LATEX = ["", "x+y", r"\sum d(v) = 2m", "IsRed(x)", "Big(x)", r"n(n-1) / 2", r"p \to q"]
EVIDENCE = ["例如 两个", " 例如", "一般地", ""]
SUMMARY = ["", "讲到牛顿", "陈述", "边数"]


def cards_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 5 == 0, "theorem").otherwise("formula").alias("kind"), pick(FORMULAS, k).alias("name"), pick(LATEX, F.floor(k / 3)).alias("latex"), pick(EVIDENCE, F.floor(k / 7)).alias("evidence"),
        pick(SUMMARY, F.floor(k / 11)).alias("summary"), F.col("p_name").alias("statement"),
    )


CARDS_SQL = f"""c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'theorem' ELSE 'formula' END AS kind, {pick_sql(FORMULAS, "p_partkey")} AS name, {pick_sql(LATEX, "p_partkey // 3")} AS latex,
    {pick_sql(EVIDENCE, "p_partkey // 7")} AS evidence, {pick_sql(SUMMARY, "p_partkey // 11")} AS summary, p_name AS statement FROM part),
    z AS (SELECT *, trim(split_part(name, '/', 1)) AS zh, regexp_matches(trim(split_part(name, '/', 1)), '约定|记号|形式|规则|定理|公式|条件|充要|一般|任意|对所有|对任意|基本形式|易名|握手|完全图|补图|空图|量词|分离') AS general FROM c),
    r AS (SELECT *, CASE WHEN regexp_matches(zh || ' ' || summary, '牛顿|莱布尼茨|流数|微积分|导数积分|积分和式') THEN 'off_topic'
      WHEN regexp_matches(zh, '[ABCD]点|点谓词|程序点|循环不变') THEN 'program_point'
      WHEN regexp_matches(zh, '小弟弟|红气球|抱住|苏格拉底|柏拉图|亚当|夏娃|终有一死|所有人都会死') THEN 'story'
      WHEN contains(zh, '定义为') THEN 'defined_value'
      WHEN starts_with(trim(evidence), '例如') AND NOT general THEN 'said_in_example'
      WHEN NOT general AND (regexp_matches(name || ' ; ' || latex, '(?i)\\b(Embrace|LittleBrother|Balloon|Big|Red|Man|Likes|father|teacher)\\s*\\(') OR regexp_matches(name || ' ; ' || latex, '\\b[A-Z][a-z]+[A-Z][a-zA-Z]*\\s*\\(')) THEN 'example_predicate'
      WHEN NOT general AND regexp_full_match(zh, '个体常项\\s*[a-zA-Z、, ]+') THEN 'example_constants'
      WHEN starts_with(zh, '删去顶点') OR starts_with(zh, '删去边') OR starts_with(zh, '加边') THEN 'operation'
      WHEN contains(zh, '记号') AND NOT regexp_matches(latex, '=|\\\\sum|\\\\forall|\\\\exists|\\\\to|\\\\rightarrow|\\\\land') AND NOT regexp_matches(zh, '个体|谓词|命题|量词') THEN 'bare_notation'
      WHEN regexp_matches(zh, '权值.*设为\\s*1|设为\\s*1.*权值') THEN 'default_value' END AS reason FROM z)"""


@query("f13_formula_rules", f"WITH {CARDS_SQL} SELECT id, reason FROM r")
def f13_formula_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards_of(spark, sf_dir).select("id", C.formula_drop_reason(F.col("name"), F.col("latex"), F.col("evidence"), F.col("summary")).alias("reason"))


@query(
    "q8_generic_formulas",
    f"""WITH {CARDS_SQL}, k AS (SELECT *, CASE WHEN kind = 'formula' THEN nullif(replace(regexp_replace(latex, '\\s+', '', 'g'), '\\,', ''), '') END AS tex, CASE WHEN kind <> 'formula' THEN NULL WHEN contains(zh, '握手') THEN 'h' WHEN regexp_matches(zh, '完全图.*边数|边数.*完全图') THEN 'e'
      WHEN contains(zh, '个体') AND regexp_matches(zh, '字母|记号|常项|变项') THEN 'i' WHEN regexp_matches(zh, '谓词变项|命题与谓词') THEN 'l' END AS family FROM r WHERE kind <> 'formula' OR reason IS NULL),
    a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY coalesce(tex, 'id ' || id) ORDER BY contains(name, '公式') DESC, length(latex) DESC, length(statement) DESC, length(name) DESC, id) = 1)
    SELECT id FROM a QUALIFY row_number() OVER (PARTITION BY coalesce(family, 'id ' || id) ORDER BY contains(name, '公式') DESC, length(latex) DESC, length(statement) DESC, length(name) DESC, id) = 1""",
)
def q8_generic_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.generic_formulas(cards_of(spark, sf_dir)).select("id")


# Sample questions and answers for each sign of a follow-up.
QUESTIONS = "什么是集合|它和关系有什么区别|那呢|第3讲讲了什么|这个定理为什么成立|图论 与 欧拉回路 如何联系|还有别的吗|请解释哈密顿图|  |lecture 4 树的性质|另外一个关于平面图的问题在这里继续往下问一些细节内容|命题|上述集合怎么理解".split("|")
ANSWERS = ["集合是确定的对象的整体，关系是集合", "欧拉回路经过每条边一次", "no ideographs", "平面图 可以画在平面上"]


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") * 5 + F.col("turn") * 3
    u = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", pick(QUESTIONS, k).alias("q"), pick(ANSWERS, F.col("conv_id") + F.col("turn")).alias("a"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return u.withColumn("pq", F.lag("q").over(w)).withColumn("pa", F.lag("a").over(w))


_FIRST = "list_slice(list_filter({0}, lambda x, i: list_position({0}, x) = i), 1, 8)"
_TERMS = lambda text: _FIRST.format(f"regexp_extract_all({text}, '[一-鿿]{{2,}}')")


@query(
    "r6_followup_decision",
    f"""WITH u AS (SELECT conv_id, turn, {pick_sql(QUESTIONS, "conv_id * 5 + turn * 3")} AS q, {pick_sql(ANSWERS, "conv_id + turn")} AS a FROM conversations WHERE role = 'user'),
    l AS (SELECT conv_id, turn, trim(q) AS q, lag(q) OVER w AS pq, lag(a) OVER w AS pa FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    m AS (SELECT *, {_TERMS("q")} AS own, {_TERMS("concat_ws(' ', pq, left(pa, 400))")} AS bef, {_TERMS("pq")} AS lt, {_TERMS("left(coalesce(pa, ''), 300)")} AS la, regexp_matches(q, '它|这个|那个|这些|那些|前者|后者|上述|刚才') AS refers,
      regexp_matches(q, '^(什么|何为|何谓|请介绍|请解释|请说明|定义|简述|概述)') AS alone, regexp_matches(q, '^(那|这|还|另|它)') AND length(q) <= 20 AS opens, regexp_matches(q, '它|这个|那个|这些|那些|前者|后者|上述|刚才|还有|另外|怎么理解|为何|为什么|区别|对比|异同|联系|关系') AS hint FROM l),
    n AS (SELECT *, list_filter(own, lambda x: list_contains(bef, x)) AS shared FROM m),
    s AS (SELECT *, CASE WHEN q = '' OR pq IS NULL THEN 0.0 ELSE (CASE WHEN alone THEN -3.0 ELSE 0 END + CASE WHEN refers THEN 3.0 ELSE 0 END + CASE WHEN opens THEN 2.0 ELSE 0 END + CASE WHEN hint AND NOT alone THEN 1.0 ELSE 0 END
      - CASE WHEN len(own) >= 2 AND NOT refers THEN 2.0 ELSE 0 END - CASE WHEN len(own) > 0 AND len(bef) > 0 AND len(shared) = 0 AND NOT refers AND NOT opens THEN 2.0 ELSE 0 END
      - CASE WHEN regexp_matches(q, '(?i)第\\s*[0-9一二三四五六七八九十]+\\s*讲|lecture\\s*[0-9]+') AND NOT refers THEN 1.5 ELSE 0 END + CASE WHEN length(q) <= 10 AND NOT alone THEN 1.0 ELSE 0 END) END::DOUBLE AS score FROM n),
    c AS (SELECT *, coalesce(score >= 2 AND q <> '' AND pq IS NOT NULL, false) AS use, CASE WHEN len(lt) > 0 THEN lt ELSE la END AS ctx FROM s),
    d AS (SELECT *, CASE WHEN len(shared) > 0 THEN list_slice(list_filter(list_concat(shared, ctx), lambda x, i: list_position(list_concat(shared, ctx), x) = i), 1, 6) ELSE ctx END AS terms FROM c)
    SELECT conv_id, turn, score, use, CASE WHEN use THEN trim(array_to_string(list_filter([pq, q, array_to_string(terms, ' ')], lambda x: x <> ''), ' ')) ELSE q END AS query FROM d""",
)
def r6_followup_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of(spark, sf_dir).select("conv_id", "turn", D.follow_up(F.col("q"), F.col("pq"), F.col("pa")).alias("x")).select("conv_id", "turn", "x.score", "x.use", "x.query")


ASKS = ["这张图片是什么", "show the PPT", "plain words", "视频 里讲了什么", "", "看图说话"]


@query(
    "r10_routes",
    f"""WITH q AS (SELECT conv_id, turn, {pick_sql(ASKS, "conv_id + turn")} AS q, turn % 3 = 0 AS media FROM conversations), v AS (SELECT *, regexp_matches(q, '图片|这张|截图|板书|PPT|ppt|幻灯|视频|画面|图中|看图') AS visual FROM q)
    SELECT conv_id, turn, CASE WHEN media OR visual THEN 'media_augmented_text,text_hybrid,graph_expand' ELSE 'text_hybrid,graph_expand' END AS channels, media AS parse_media, media OR visual AS attach_images, media OR visual AS use_vision,
           CASE WHEN media THEN 'user_media' WHEN visual THEN 'visual_language_cue' ELSE 'default_text_hybrid' END AS reason FROM v""",
)
def r10_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = F.col("turn") % 3 == 0
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.route(pick(ASKS, F.col("conv_id") + F.col("turn")), media, media & (F.col("turn") % 2 == 0)).alias("x"))
    return out.select("conv_id", "turn", F.array_join("x.channels", ",").alias("channels"), "x.parse_media", "x.attach_images", "x.use_vision", "x.reason")


DESCRIPTIONS = ["", "短语", "集合又称为类，这是一个较长的说明。", "图由顶点和边划分为两个部分。", "前者是基础知识的一部分，后者依赖于它。", "两个命题等价于同一个公式。", "没有任何动词可以用在这里的句子。", "具有；分号"]


@query(
    "f23_concrete_relation",
    f"""WITH d AS (SELECT p_partkey, {pick_sql(DESCRIPTIONS, "p_partkey")} AS d, ['part_of', 'belong_to', 'depend_on', 'synonym_of', 'property_of', 'related_with', 'odd'][p_partkey % 7 + 1] AS p FROM part)
    SELECT p_partkey, CASE WHEN d <> '' AND length(d) <= 8 AND NOT regexp_matches(d, '[。；;]') THEN d WHEN regexp_matches(d, '称为|也叫') THEN '称为' WHEN contains(d, '等同于') THEN '等同于' WHEN contains(d, '等价于') THEN '等价于' WHEN contains(d, '是基础') THEN '是基础' WHEN contains(d, '依赖') THEN '依赖'
      WHEN contains(d, '包含') THEN '包含' WHEN contains(d, '划分为') THEN '划分为' WHEN contains(d, '细分为') THEN '细分为' WHEN contains(d, '属于') THEN '属于' WHEN contains(d, '具有') THEN '具有' WHEN contains(d, '表示') THEN '表示' WHEN contains(d, '推出') THEN '推出' WHEN contains(d, '扩展') THEN '扩展'
      ELSE CASE p WHEN 'part_of' THEN '属于' WHEN 'belong_to' THEN '属于' WHEN 'depend_on' THEN '依赖' WHEN 'synonym_of' THEN '同义于' WHEN 'property_of' THEN '具有属性' ELSE '相关' END END AS phrase FROM d""",
)
def f23_concrete_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    predicate = pick(["part_of", "belong_to", "depend_on", "synonym_of", "property_of", "related_with", "odd"], k)
    return table(spark, sf_dir, "part").select("p_partkey", O.concrete_relation(pick(DESCRIPTIONS, k), predicate).alias("phrase"))


POINTS = ["Graph Theory/图论", "sets | SETS", "图论", "trees-and-forests", " ", "Sets／集合", "forest"]


def relations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("kp:"), k % 9).alias("point_id"), pick(POINTS, k).alias("point_name"), F.concat(F.lit("s"), k).alias("segment"), k.alias("place"))


def wanted_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.when(k % 2 == 0, F.concat(F.lit("KP-"), k)).otherwise(F.concat(F.lit("kp:"), k)).alias("point"), pick(POINTS, F.floor(k / 2)).alias("name"))


_ALIAS = "list_filter(list_transform(list_concat([trim({0})], string_split_regex(trim({0}), '[/／|]'), [trim({1})], string_split_regex(trim({1}), '[/／|]')), lambda p: regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')), lambda p: p <> '')"
VIDEO_SQL = f"""r AS (SELECT 's' || p_partkey AS segment, p_partkey AS place, unnest({_ALIAS.format("'kp:' || (p_partkey % 9)", pick_sql(POINTS, "p_partkey"))}) AS alias FROM part),
    w AS (SELECT point, unnest({_ALIAS.format("point", "name")}) AS alias FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'KP-' || n_nationkey ELSE 'kp:' || n_nationkey END AS point, {pick_sql(POINTS, "n_nationkey // 2")} AS name FROM nation)),
    s AS (SELECT point, segment, min(place) AS place FROM w JOIN r USING (alias) GROUP BY ALL)"""


@query("j14_point_segments", f"WITH {VIDEO_SQL} SELECT point, segment FROM s")
def j14_point_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.point_segments(wanted_of(spark, sf_dir), relations_of(spark, sf_dir)).select("point", "segment")


@query(
    "j15_point_references",
    f"""WITH {VIDEO_SQL}, c AS (SELECT 's' || p_partkey AS segment, CASE WHEN p_partkey % 6 > 0 THEN 'v' || (p_partkey % 6) END AS video, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 50)::DOUBLE ELSE 0 END AS start_sec FROM part)
    SELECT point, video, start_sec, arg_min(segment, place) AS segment FROM s JOIN c USING (segment) WHERE video IS NOT NULL GROUP BY ALL""",
)
def j15_point_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    chunks = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), k).alias("segment"), F.when(k % 6 > 0, F.concat(F.lit("v"), k % 6)).alias("video"), F.when(k % 4 > 0, (k % 50).cast("double")).alias("start_sec"))
    return V.point_references(V.point_segments(wanted_of(spark, sf_dir), relations_of(spark, sf_dir)), chunks).select("point", "video", "start_sec", "segment")


def views_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_type", "p_brand")
    return rows.select(
        (k % 3).cast("int").alias("view"), k.alias("pos"), F.when(k % 11 > 0, F.concat(F.lit("n"), k)).alias("id"), F.when(k % 4 == 0, F.upper("p_type")).when(k % 4 == 1, "").alias("zh_name"),
        F.when(k % 2 == 0, F.lower("p_type")).alias("name"), F.when(k % 5 > 0, F.col("p_brand")).alias("en_name"), F.when(k % 3 == 2, F.array(F.concat(F.lit("a"), k % 10))).alias("anchors"),
    )


VIEWS_SQL = """n AS (SELECT (p_partkey % 3)::INT AS view, p_partkey AS pos, CASE WHEN p_partkey % 11 > 0 THEN 'n' || p_partkey END AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_type) WHEN 1 THEN '' END AS zh_name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS name,
      CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS en_name, CASE WHEN p_partkey % 3 = 2 THEN 'a' || (p_partkey % 10) END AS anchor FROM part),
    k AS (SELECT *, lower(regexp_replace(coalesce(nullif(zh_name, ''), nullif(name, ''), nullif(en_name, ''), nullif(id, ''), ''), '\\s+', '', 'g')) AS key, view * 10000000 + pos AS o FROM n),
    f AS (SELECT key, arg_min(id, o) FILTER (id IS NOT NULL) AS id, arg_max(zh_name, o) FILTER (zh_name IS NOT NULL) AS zh_name, arg_max(name, o) FILTER (name IS NOT NULL) AS name, arg_max(en_name, o) FILTER (en_name IS NOT NULL) AS en_name, string_agg(DISTINCT anchor, ',' ORDER BY anchor) AS anchors FROM k WHERE key <> '' GROUP BY key)"""


@query("u1_fused_nodes", f"WITH {VIEWS_SQL} SELECT key, id, zh_name, name, en_name, coalesce(anchors, '') AS anchors FROM f")
def u1_fused_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fused_nodes(views_of(spark, sf_dir))[0].withColumn("anchors", F.array_join("anchors", ","))


@query(
    "u1_fused_edges",
    f"""WITH {VIEWS_SQL}, m AS (SELECT DISTINCT view, k.id, f.id AS canonical FROM k JOIN f USING (key) WHERE k.id IS NOT NULL), e AS (SELECT l_linenumber % 3 AS view, l_orderkey * 10 + l_linenumber AS pos, 'n' || l_partkey AS source, 'n' || (l_partkey + 3) AS target, l_returnflag AS relation FROM lineitem)
    SELECT s.canonical AS source, t.canonical AS target, relation, e.view::INT AS view, pos FROM e JOIN m s ON s.view = e.view AND s.id = e.source JOIN m t ON t.view = e.view AND t.id = e.target
    QUALIFY row_number() OVER (PARTITION BY s.canonical, t.canonical, relation ORDER BY e.view DESC, pos DESC) = 1""",
)
def u1_fused_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("int").alias("view"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("n"), "l_partkey").alias("source"), F.concat(F.lit("n"), F.col("l_partkey") + 3).alias("target"), F.col("l_returnflag").alias("relation")
    )
    return V.fused_edges(e, V.fused_nodes(views_of(spark, sf_dir))[1]).select("source", "target", "relation", "view", "pos")


@query(
    "q1_anchor_chains",
    """WITH RECURSIVE a AS (SELECT user_id, event_id::DOUBLE AS n, floor(abs(value) * 10)::DOUBLE AS o, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    c(user_id, i, o, len) AS (SELECT user_id, i, o, 1 FROM a UNION SELECT a.user_id, a.i, a.o, c.len + 1 FROM c JOIN a ON a.user_id = c.user_id AND a.i > c.i AND a.o > c.o)
    SELECT user_id, max(len)::BIGINT AS length FROM c GROUP BY user_id""",
)
def q1_anchor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many anchors of each lecture ascend on both sides; the chain itself feeds the warp of q2."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.abs("value") * 10).cast("double").alias("o"), F.col("event_id").cast("double").alias("n"))
    return A.chained(e, "user_id").groupBy("user_id").agg(F.count("*").alias("length"))


@query("q1_q4_aligned_units")
def q1_q4_aligned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of each lecture (columns) matched with its earlier cut (rows: half as many, later by a shift) by overlap in time, in order."""
    c = cues(spark, sf_dir).select("lecture", "cue", "start_sec", "end_sec")
    return folds.aligned(c, c.filter("cue % 2 = 0").withColumn("start_sec", F.col("start_sec") + 60).withColumn("end_sec", F.col("end_sec") + 60))


@query("k10_assigned_edges")
def k10_assigned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of a lecture at one cue at most, each cue at least one while there are edges, none above the cap of its length."""
    t = triplets(spark, sf_dir).select("lecture", F.concat_ws(" ", "subject", "relation", "object").alias("edge"), "cue", (F.col("weight") * 10).alias("seconds"), (F.col("weight") / 10).alias("score"))
    return folds.assigned_edges(t)


@query("w5_merged_overlaps")
def w5_merged_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.merge_cues(cues(spark, sf_dir).withColumn("page", F.lit(0)), overlap=(60.0, 0.5))
