"""Lookups, redirects, slices and roll-ups in full, beside their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.operators import cards as C
from lumenkg.operators import course as O
from lumenkg.operators import entities as E
from lumenkg.operators import graph as G
from lumenkg.operators import replies as P
from lumenkg.operators import scoring as S
from lumenkg.plans.rules import pick, pick_sql
from lumenkg.registry import query
from lumenkg.sources.tables import CUES_SQL, TRIPLETS_SQL, cues, table, triplets


@query("j8_alias_table", "WITH n AS (SELECT DISTINCT unnest(list_concat([lower(p_type), p_name], string_split(lower(p_name), ' '))) AS alias FROM part UNION SELECT 'a' UNION SELECT 'th') SELECT alias, doc_id FROM n JOIN (SELECT doc_id, lower(text) AS t FROM documents) ON contains(t, alias) WHERE alias <> ''")
def j8_alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name and word of the parts, and two short ones, against every document."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.explode(F.concat(F.array(F.lower("p_type"), F.col("p_name")), F.split(F.lower("p_name"), " "))).alias("alias")).unionByName(spark.createDataFrame([("a",), ("th",)], "alias string")).filter("alias <> ''").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return O.substring_join(docs, names, "t", "alias").select("alias", "doc_id")


@query(
    "i11_importance_of",
    """WITH s AS (SELECT p_type || '/' || p_brand AS name, max(p_retailprice) AS own FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), n AS (SELECT split_part(name, '/', 1) AS zh, arg_min(own, name) AS near FROM s GROUP BY 1),
    a AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 5 = 1 THEN p_type ELSE p_type || '/' || p_brand END AS name FROM part) SELECT p_partkey, coalesce(own, near, 0.0) AS score FROM a LEFT JOIN s USING (name) LEFT JOIN n ON zh = split_part(a.name, '/', 1)""",
)
def i11_importance_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, full, k = table(spark, sf_dir, "part"), F.concat("p_type", F.lit("/"), "p_brand"), F.col("p_partkey") % 5
    asked = p.select("p_partkey", F.when(k == 0, "none").when(k == 1, F.col("p_type")).otherwise(full).alias("name"))
    return O.importance_lookup(asked, p.filter("p_partkey % 2 = 0").select(full.alias("name"), F.col("p_retailprice").alias("score"))).select("p_partkey", "score")


@query(
    "m9_id_redirects",
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1 WHEN p_partkey % 10 = 4 THEN p_partkey - 1 ELSE p_partkey // 2 END AS dst FROM part), g AS (SELECT p_partkey AS src, p_partkey + 7 AS dst FROM part WHERE p_partkey % 6 = 0),
    m AS (SELECT src, coalesce(g.dst, e.dst) AS dst FROM e LEFT JOIN g USING (src)), k AS (SELECT p_partkey AS id FROM part WHERE p_size % 5 = 0),
    w(src, cur, n) AS (SELECT src, dst, 1 FROM m WHERE src NOT IN (SELECT id FROM k) AND src <> dst UNION SELECT w.src, m.dst, n + 1 FROM w JOIN m ON m.src = w.cur WHERE w.cur NOT IN (SELECT id FROM k) AND n < 60)
    SELECT 'c' || src AS src, 'c' || min(cur) AS dst FROM w WHERE cur IN (SELECT id FROM k) GROUP BY src""",
)
def m9_id_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    c = lambda x: F.concat(F.lit("c"), x.cast("long"))
    old = p.select(c(k).alias("src"), c(F.when(k % 10 == 3, k + 1).when(k % 10 == 4, k - 1).otherwise(F.floor(k / 2))).alias("dst"))
    new = p.filter("p_partkey % 6 = 0").select(c(k).alias("src"), c(k + 7).alias("dst"))
    return O.id_redirects(old, new, p.filter("p_size % 5 = 0").select(c(k).alias("id")))


@query(
    "x29_time_slices",
    f"""WITH {CUES_SQL}, s AS (SELECT lecture, start_sec, start_sec + 40 AS end_sec, text || cue AS text FROM c), w AS (SELECT lecture, cue AS slot, start_sec + 13 AS s, start_sec + 7000 AS e FROM c WHERE cue % 5 = 0),
    b AS (SELECT lecture, slot, start_sec, end_sec, text, floor(length(text) * greatest(0.0, (s - start_sec) / 40))::INT AS a, ceil(length(text) * least(1.0, (e - start_sec) / 40))::INT AS z FROM s JOIN w USING (lecture) WHERE end_sec > s AND start_sec < e)
    SELECT lecture, slot, string_agg(substr(text, a + 1, z - a), '' ORDER BY start_sec, end_sec, substr(text, a + 1, z - a)) AS text FROM b GROUP BY ALL""",
)
def x29_time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    spans = c.select("lecture", "start_sec", (F.col("start_sec") + 40).alias("end_sec"), F.concat("text", "cue").alias("text"))
    return O.text_slices(spans, c.filter("cue % 5 = 0").select("lecture", F.col("cue").alias("slot"), (F.col("start_sec") + 13).alias("s"), (F.col("start_sec") + 7000).alias("e")), "lecture")


@query("s21_may_reuse", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN true ELSE p_size % 3 = 0 AND p_size % 5 > 0 END AS adopting, CASE WHEN p_size % 4 = 0 THEN false ELSE p_size % 3 = 0 AND p_size % 5 > 0 END AS strict FROM part")
def s21_may_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks stored beside an artifact: none, all expected ones and more, one of another value, or one too few."""
    k = F.col("p_size")
    expected = F.create_map(F.lit("model"), F.lit("m"), F.lit("rows"), F.col("p_name"))
    marks = F.create_map(F.lit("model"), F.when(k % 3 == 0, "m").otherwise("other"), F.when(k % 5 > 0, "rows").otherwise("else"), F.col("p_name"), F.lit("more"), F.lit("x"))
    stored = F.when(k % 4 > 0, marks)
    return table(spark, sf_dir, "part").select("p_partkey", O.may_reuse(stored, expected).alias("adopting"), O.may_reuse(stored, expected, False).alias("strict"))


@query("s24_ordered_cues", f"WITH {CUES_SQL} SELECT cue, lecture, row_number() OVER (ORDER BY lecture, start_sec, cue)::INT AS place FROM c")
def s24_ordered_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(cues(spark, sf_dir), ["lecture", "start_sec", "cue"], "place").select("cue", "lecture", "place")


@query(
    "f27_hidden_and_pruned",
    f"""WITH RECURSIVE {TRIPLETS_SQL}, g AS (SELECT DISTINCT subject, object FROM t WHERE relation <> 'related_with'), b AS (SELECT subject AS u, object AS v FROM g UNION SELECT object, subject FROM g), r(node, x) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.x), c AS (SELECT node, min(x) AS c FROM r GROUP BY node),
    d AS (SELECT u AS node, count(*) AS d FROM b GROUP BY u), k AS (SELECT c FROM c JOIN d USING (node) GROUP BY c HAVING count(*) >= 4 AND NOT (max(d) = count(*) - 1 AND sum(d) = 2 * (count(*) - 1))) SELECT subject, object FROM g JOIN c ON node = subject WHERE c IN (SELECT c FROM k)""",
)
def f27_hidden_and_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without related_with, and then without components that have no path of three edges."""
    return G.long_components(triplets(spark, sf_dir).filter("relation <> 'related_with'").select("subject", "object").distinct())


@query(
    "x20_mapped_points",
    f"""WITH p AS (SELECT p_partkey, [{pick_sql(["Graph Theory", "trees and", "no match", " ", "SETS"], "p_partkey")}, {pick_sql(["graph  theory", "planar", "set"], "p_partkey // 3")}] AS points FROM part), a AS (SELECT ['graph theory', 'Trees And Forests', 'sets', 'planar graphs'] AS al),
    u AS (SELECT p_partkey, al, i, lower(replace(points[i], ' ', '')) AS k FROM p, a, range(1, 3) r(i)), m AS (SELECT p_partkey, i, coalesce(list_filter(al, lambda x: lower(replace(x, ' ', '')) = k)[1], list_filter(al, lambda x: contains(lower(replace(x, ' ', '')), k) OR contains(k, lower(replace(x, ' ', ''))))[1]) AS m FROM u WHERE k <> ''),
    d AS (SELECT p_partkey, m, min(i) AS i FROM m WHERE m IS NOT NULL GROUP BY ALL) SELECT p.p_partkey, coalesce(string_agg(m, ',' ORDER BY i), '') AS points FROM p LEFT JOIN d USING (p_partkey) GROUP BY p.p_partkey""",
)
def x20_mapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    points = F.array(pick(["Graph Theory", "trees and", "no match", " ", "SETS"], k), pick(["graph  theory", "planar", "set"], F.floor(k / 3)))
    allowed = F.array(*map(F.lit, ["graph theory", "Trees And Forests", "sets", "planar graphs"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.allowed_points(points, allowed), ",").alias("points"))


@query(
    "a21_course_report",
    f"""WITH {TRIPLETS_SQL}, e AS (SELECT count(DISTINCT n) AS entities FROM (SELECT subject AS n FROM t UNION ALL SELECT object FROM t)), g AS (SELECT count(*) AS edges FROM (SELECT DISTINCT subject, relation, object FROM t)),
    s AS (SELECT count(*) AS triplets, round(avg((relation = 'related_with')::INT), 6) AS related_share, round(avg((statement = '')::INT), 6) AS discard_rate FROM t), r AS (SELECT string_agg(relation || '=' || n, ',' ORDER BY relation) AS relations FROM (SELECT relation, count(*) AS n FROM t GROUP BY relation)),
    v AS (SELECT count(*) AS records FROM embeddings), q AS (SELECT round(avg(quality), 6) AS hit_rate, round(avg(1 - toxic), 6) AS supported_rate FROM labels) SELECT * FROM e, g, s, r, v, q""",
)
def a21_course_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that puts the graph's, the triplets', the index's and the evaluation's figures together; each part is one row."""
    t = triplets(spark, sf_dir)
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    counts = t.groupBy("relation").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("relation", F.lit("="), "n"))), ",").alias("relations"))
    parts = [
        t.select(F.explode(F.array("subject", "object")).alias("n")).agg(F.countDistinct("n").alias("entities")),
        t.select("subject", "relation", "object").distinct().agg(F.count("*").alias("edges")),
        t.agg(F.count("*").alias("triplets"), share(F.col("relation") == "related_with", "related_share"), share(F.col("statement") == "", "discard_rate")),
        counts,
        table(spark, sf_dir, "embeddings").agg(F.count("*").alias("records")),
        table(spark, sf_dir, "labels").agg(F.round(F.avg("quality"), 6).alias("hit_rate"), F.round(F.avg(1 - F.col("toxic")), 6).alias("supported_rate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


# Replies, and what is to be read from each, worked out by hand.
REPLIES = ['{"keep": ["图论/graph", "集合"]}', 'Here: {"seeds": ["树"]} done', '["树/tree", "other", "树"]', '1. 图论\n2) [alias] "集合/sets"\nnothing', '{"keep": "树"}', "", "broken { json", '```json\n{"keep": [" 集合 ", ""]}\n```', '{"other": 1}']
KEPT = ["图论/graph theory,集合/sets", "树/tree", "树/tree", "图论/graph theory,集合/sets", "树/tree", "", "", "集合/sets", ""]


@query("x19_kept_names", f"SELECT event_id, {pick_sql(KEPT, 'event_id')} AS names FROM events")
def x19_kept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ["图论/graph theory", "集合/sets", "树/tree", "树/wood"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(P.kept_names(pick(REPLIES, F.col("event_id")), allowed), ",").alias("names"))


CHECKS = ['{"results": [{"index": 0, "action": "pass"}, {"index": 1, "pass": true}, {"index": "x"}, 5]}', 'so: {"results": [{"index": 2, "pass": false}]}.', "[]", "no", '```\n{"results": []}\n```']
VERDICTS = ["0=pass,1=pass", "2=fix", "", "", ""]


@query("x19_verdicts", f"SELECT event_id, {pick_sql(VERDICTS, 'event_id')} AS verdicts FROM events")
def x19_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(P.verdicts(pick(CHECKS, F.col("event_id"))), lambda v: F.concat(v["index"].cast("string"), F.lit("="), v["action"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("verdicts"))


_ZH = "trim(split_part(root, '/', 1))"
_EN = "CASE WHEN contains(root, '/') THEN trim(regexp_replace(root, '^[^/]*/', '')) ELSE '' END"
_FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_SCORE = "CASE WHEN root IN (FROM tb) THEN 100 ELSE 0 END + CASE WHEN en <> '' THEN 20 ELSE 0 END + CASE WHEN en <> '' AND en = lower(en) THEN 8 ELSE 0 END + CASE WHEN regexp_matches(en, '^[A-Z]') AND substr(en, 2) = lower(substr(en, 2)) THEN 2 ELSE 0 END + least(length(root), 40) * 0.01"
_STAGES = [
    _FOLD.format("root"),
    f"zh || chr(9) || {_FOLD.format('en')}",
    "CASE WHEN length(zh) >= 2 THEN zh END",
    f"CASE WHEN length(regexp_replace({_FOLD.format('en')}, '[\\s\\-_.]+', '', 'g')) >= 4 THEN {_FOLD.format('en')} END",
]
_STEPS = ", ".join(
    f"""k{i} AS (SELECT root, {key} AS key, {_SCORE} AS score, CASE WHEN length(zh) >= 2 THEN zh END AS z FROM (SELECT DISTINCT root, {_ZH} AS zh, {_EN} AS en FROM s{i})),
    b{i} AS (SELECT key, first(root ORDER BY score DESC, root) AS best FROM k{i} WHERE key <> '' GROUP BY key {"HAVING count(DISTINCT z) <= 1" if i == 3 else ""}), s{i + 1} AS (SELECT name, coalesce(best, s.root) AS root FROM s{i} s LEFT JOIN k{i} k ON k.root = s.root LEFT JOIN b{i} b ON b.key = k.key)"""
    for i, key in enumerate(_STAGES)
)
_MADE = "CASE p_partkey % 7 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type || '/' || lower(p_name) WHEN 2 THEN p_type || '/' || upper(p_name) WHEN 3 THEN 'x/' || p_name WHEN 4 THEN p_brand || '/' || p_type WHEN 5 THEN p_type || ' / ' || p_brand ELSE p_type END"


@query("g10_staged_merge", f"WITH s0 AS (SELECT DISTINCT trim({_MADE}) AS name, trim({_MADE}) AS root FROM part), tb AS (SELECT DISTINCT p_type FROM part WHERE p_size > 40), {_STEPS} SELECT name AS alias, root AS canonical FROM s4 WHERE name <> root")
def g10_staged_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 7
    t, n, b = F.col("p_type"), F.col("p_name"), F.col("p_brand")
    slash = lambda *x: F.concat(*x)
    made = F.when(k == 0, F.upper(t)).when(k == 1, slash(t, F.lit("/"), F.lower(n))).when(k == 2, slash(t, F.lit("/"), F.upper(n))).when(k == 3, slash(F.lit("x/"), n)).when(k == 4, slash(b, F.lit("/"), t)).when(k == 5, slash(t, F.lit(" / "), b)).otherwise(t)
    return E.staged_merge(p.select(made.alias("name")), p.filter("p_size > 40").select(t.alias("name")))
