"""Interval and window queries over the cues view of events."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.operators import intervals as I
from lumenkg.registry import query
from lumenkg.sources.tables import CUES_SQL, cues, table

ISLANDS_SQL = f"""{CUES_SQL}, m AS (SELECT *, max(end_sec) OVER (PARTITION BY lecture ORDER BY start_sec, cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sec - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY lecture ORDER BY start_sec, cue) AS island FROM m)"""


@query("w1_gap_merge", f"WITH {ISLANDS_SQL} SELECT lecture, island::BIGINT AS island, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n FROM i GROUP BY lecture, island")
def w1_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_intervals(cues(spark, sf_dir), "lecture", "start_sec", "end_sec", 600.0, "cue")


@query("w8_interval_union", f"WITH {ISLANDS_SQL.replace('> 600', '> 0')} SELECT lecture, island::BIGINT AS island, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n FROM i GROUP BY lecture, island")
def w8_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_intervals(cues(spark, sf_dir), "lecture", "start_sec", "end_sec", 0.0, "cue")


@query(
    "w7_debounce",
    f"""WITH RECURSIVE {CUES_SQL}, k(lecture, moment) AS (SELECT lecture, min(start_sec) FROM c GROUP BY lecture UNION ALL
    SELECT k.lecture, (SELECT min(c.start_sec) FROM c WHERE c.lecture = k.lecture AND c.start_sec >= k.moment + 86400) FROM k
    WHERE EXISTS (SELECT 1 FROM c WHERE c.lecture = k.lecture AND c.start_sec >= k.moment + 86400)) SELECT lecture, moment AS start_sec FROM k""",
)
def w7_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.debounce(cues(spark, sf_dir), "lecture", "start_sec", 86400.0)


@query("w9_pages", f"WITH {CUES_SQL}, d AS (SELECT DISTINCT lecture, start_sec FROM c), p AS (SELECT lecture, start_sec, lead(start_sec) OVER (PARTITION BY lecture ORDER BY start_sec) AS end_sec FROM d) SELECT lecture, (row_number() OVER (PARTITION BY lecture ORDER BY start_sec) - 1)::INT AS page, start_sec, end_sec FROM p WHERE end_sec - start_sec >= 1800")
def w9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.boundaries_to_pages(cues(spark, sf_dir), "lecture", "start_sec", 1800.0)


@query("w10_split_long", f"WITH {CUES_SQL}, n AS (SELECT *, CASE WHEN end_sec - start_sec <= 900 THEN 0 ELSE ceil((end_sec - start_sec - 900) / 840)::INT END AS k FROM c) SELECT cue, piece::INT AS piece, round(start_sec + piece * 840, 4) AS piece_start, round(least(end_sec, start_sec + piece * 840 + 900), 4) AS piece_end FROM n, unnest(range(0, k + 1)) u(piece)")
def w10_split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.split_long(cues(spark, sf_dir), 900.0, 60.0)
    return out.select("cue", "piece", F.round("piece_start", 4).alias("piece_start"), F.round("piece_end", 4).alias("piece_end"))


@query("w12_boundary_context", f"WITH {CUES_SQL} SELECT cue, coalesce(lag(start_sec) OVER w, 0) AS prev, coalesce(lead(start_sec) OVER w, start_sec + 60) AS next FROM c WINDOW w AS (PARTITION BY lecture ORDER BY start_sec, cue)")
def w12_boundary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lecture").orderBy("start_sec", "cue")
    return cues(spark, sf_dir).select("cue", F.lag("start_sec", 1, 0.0).over(w).alias("prev"), F.coalesce(F.lead("start_sec").over(w), F.col("start_sec") + 60).alias("next"))


RUNS_SQL = f"""{CUES_SQL}, f AS (SELECT *, coalesce((text <> lag(text) OVER (PARTITION BY lecture ORDER BY start_sec, cue))::INT, 1) AS fresh FROM c),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY lecture ORDER BY start_sec, cue) AS run FROM f)"""


@query("w14_same_page_runs", f"WITH {RUNS_SQL} SELECT lecture, run::BIGINT AS run, any_value(text) AS text, count(*) AS n, min(start_sec) AS start_sec FROM r GROUP BY lecture, run")
def w14_same_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = I.changed_runs(cues(spark, sf_dir), "lecture", ["start_sec", "cue"], "text")
    return r.groupBy("lecture", "run").agg(F.any_value("text").alias("text"), F.count("*").alias("n"), F.min("start_sec").alias("start_sec"))


@query("w13_drop_false_flips", f"WITH {RUNS_SQL} SELECT cue FROM r QUALIFY count(*) OVER (PARTITION BY lecture, run) > 1 AND row_number() OVER (PARTITION BY lecture, run ORDER BY start_sec DESC, cue DESC) = 1")
def w13_drop_false_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a run its last member stays; a run of one goes entirely."""
    r = I.changed_runs(cues(spark, sf_dir), "lecture", ["start_sec", "cue"], "text")
    w = Window.partitionBy("lecture", "run")
    return r.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(F.desc("start_sec"), F.desc("cue")))).filter("n > 1 AND i = 1").select("cue")


PAGES_SQL = f"{CUES_SQL}, p AS (SELECT d AS page, d * 21600.0 AS ps, (d + 1) * 21600.0 AS pe FROM range(0, 130) r(d))"


def _pages(spark):
    return spark.range(130).select(F.col("id").alias("page"), (F.col("id") * 21600.0).alias("r_start"), ((F.col("id") + 1) * 21600.0).alias("r_end"), F.lit(0).alias("g"))


def _overlaps(spark, sf_dir):
    c = cues(spark, sf_dir).filter("end_sec > start_sec").select("cue", F.col("start_sec").alias("l_start"), F.col("end_sec").alias("l_end"), F.lit(0).alias("g"))
    return I.range_join(c, _pages(spark), "g", 21600.0).withColumn("ov", F.round(I.overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")), 4))


@query("j6_primary_page", f"WITH {PAGES_SQL} SELECT cue, page, round(least(end_sec, pe) - greatest(start_sec, ps), 4) AS ov FROM c JOIN p ON start_sec < pe AND ps < end_sec WHERE end_sec > start_sec QUALIFY row_number() OVER (PARTITION BY cue ORDER BY round(least(end_sec, pe) - greatest(start_sec, ps), 4) DESC, page) = 1")
def j6_primary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).groupBy("cue").agg(F.max_by(F.struct("page", "ov"), F.struct(F.col("ov"), -F.col("page"))).alias("b")).select("cue", "b.page", "b.ov")


@query("j7_covering_pages", f"WITH {PAGES_SQL} SELECT cue, min(page) AS first_page, max(page) AS last_page FROM c JOIN p ON start_sec < pe AND ps < end_sec WHERE end_sec > start_sec GROUP BY cue")
def j7_covering_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).groupBy("cue").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("j13_overlap_fraction", f"WITH {PAGES_SQL} SELECT cue, page FROM c JOIN p ON start_sec < pe AND ps < end_sec WHERE end_sec > start_sec AND round(least(end_sec, pe) - greatest(start_sec, ps), 4) > 0.5 * greatest(1.0, least(end_sec - start_sec, pe - ps))")
def j13_overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    shorter = F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start"))
    return _overlaps(spark, sf_dir).filter(F.col("ov") > 0.5 * F.greatest(F.lit(1.0), shorter)).select("cue", "page")


@query("w4_merge_by_page", f"WITH {PAGES_SQL}, b AS (SELECT lecture, cue, page, start_sec, end_sec FROM c JOIN p ON start_sec >= ps AND start_sec < pe) SELECT lecture, page, min(start_sec) AS start_sec, max(end_sec) AS end_sec, string_agg(cue::VARCHAR, ' ' ORDER BY start_sec, cue) AS cues FROM b GROUP BY lecture, page")
def w4_merge_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("page", F.floor(F.col("start_sec") / 21600.0))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "cue"))), lambda x: x["cue"].cast("string")), " ")
    return c.groupBy("lecture", "page").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), ordered.alias("cues"))


@query("w6_session_pairs", f"WITH {CUES_SQL}, l AS (SELECT DISTINCT lecture FROM c) SELECT a.lecture AS first, b.lecture AS second FROM l a JOIN l b ON b.lecture = a.lecture + 1 WHERE a.lecture % 2 = 1")
def w6_session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = cues(spark, sf_dir).select("lecture").distinct()
    return l.filter("lecture % 2 = 1").select(F.col("lecture").alias("first")).join(l.select(F.col("lecture").alias("second")), F.col("second") == F.col("first") + 1)


@query("w17_minmax", "SELECT vec_id, round(coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0.5), 6) AS score FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) WINDOW w AS (PARTITION BY label)")
def w17_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    lo, span = F.min("x").over(w), F.max("x").over(w) - F.min("x").over(w)
    return e.select("vec_id", F.round(F.when(span == 0, 0.5).otherwise((F.col("x") - lo) / span), 6).alias("score"))


@query("w18_max_norm", "SELECT vec_id, round(x / coalesce(nullif(max(x) OVER w, 0), 1), 6) AS score FROM (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS x FROM embeddings) WINDOW w AS (PARTITION BY label)")
def w18_max_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max("x").over(Window.partitionBy("label"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.abs(F.col("embedding")[0].cast("double")).alias("x"))
    return e.select("vec_id", F.round(F.col("x") / F.when(top == 0, 1.0).otherwise(top), 6).alias("score"))


@query("w19_first_seen", f"WITH {CUES_SQL} SELECT lecture, text, min(start_sec) AS first_sec FROM c GROUP BY lecture, text")
def w19_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).groupBy("lecture", "text").agg(F.min("start_sec").alias("first_sec"))


@query(
    "w20_top_chapters",
    f"WITH {CUES_SQL}, n AS (SELECT lecture, text AS chapter, count(*) AS s FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lecture ORDER BY s DESC, chapter) AS k, max(s) OVER (PARTITION BY lecture) AS top FROM n) SELECT lecture, chapter, k::INT AS rank, round(s / sum(s) OVER (PARTITION BY lecture), 6) AS weight FROM r WHERE k <= 3 AND s >= 0.5 * top",
)
def w20_top_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cues(spark, sf_dir).groupBy("lecture", F.col("text").alias("chapter")).agg(F.count("*").alias("s"))
    w = Window.partitionBy("lecture")
    r = n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("s"), "chapter"))).withColumn("top", F.max("s").over(w)).filter("rank <= 3 AND s >= 0.5 * top")
    return r.select("lecture", "chapter", "rank", F.round(F.col("s") / F.sum("s").over(w), 6).alias("weight"))


@query("w21_percentiles", f"WITH {CUES_SQL} SELECT lecture, median(end_sec - start_sec) AS median_sec, quantile_disc(end_sec - start_sec, 0.9) AS p90 FROM c GROUP BY lecture")
def w21_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cues(spark, sf_dir).withColumn("d", F.col("end_sec") - F.col("start_sec"))
    return d.groupBy("lecture").agg(F.median("d").alias("median_sec"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY d)").alias("p90"))


@query("f1_time_range", f"WITH {CUES_SQL} SELECT cue FROM c WHERE start_sec >= 86400 AND end_sec <= 864000")
def f1_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).filter("start_sec >= 86400 AND end_sec <= 864000").select("cue")


@query("f2_trivial_cues", f"WITH {CUES_SQL} SELECT cue FROM c WHERE NOT regexp_matches(text, '^(view|um+|ok)$') AND length(trim(text)) >= 4 AND end_sec - start_sec >= 3")
def f2_trivial_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).filter(~F.col("text").rlike("^(view|um+|ok)$") & (F.length(F.trim("text")) >= 4) & (F.col("end_sec") - F.col("start_sec") >= 3)).select("cue")


@query("f3_rule_check", f"WITH {CUES_SQL} SELECT cue, CASE WHEN length(text) < 5 THEN 'text_too_short' WHEN end_sec - start_sec < 30 THEN 'clip_missing' ELSE 'pass' END AS verdict FROM c")
def f3_rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.length("text") < 5, "text_too_short").when(F.col("end_sec") - F.col("start_sec") < 30, "clip_missing").otherwise("pass")
    return cues(spark, sf_dir).select("cue", v.alias("verdict"))


@query("x11_sample_times", f"WITH {CUES_SQL} SELECT cue, round(CASE WHEN end_sec <= start_sec THEN start_sec ELSE greatest(start_sec, least(greatest(end_sec - 3, start_sec + 2), end_sec - 0.5)) END, 4) AS at FROM c")
def x11_sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkg.functions.text import sample_time

    return cues(spark, sf_dir).select("cue", F.round(sample_time(F.col("start_sec"), F.col("end_sec")), 4).alias("at"))


@query("s22_lecture_gaps", f"WITH {CUES_SQL}, l AS (SELECT DISTINCT lecture FROM c WHERE lecture % 7 <> 3) SELECT x AS missing FROM (SELECT unnest(range(min(lecture), max(lecture) + 1)) AS x FROM l) WHERE x NOT IN (SELECT lecture FROM l)")
def s22_lecture_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = cues(spark, sf_dir).select("lecture").filter("lecture % 7 <> 3").distinct()
    span = l.agg(F.explode(F.sequence(F.min("lecture"), F.max("lecture"))).alias("missing"))
    return span.join(l, F.col("missing") == F.col("lecture"), "left_anti")
