"""Scalar functions over the driver tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.functions import text as T
from lumenkg.registry import query
from lumenkg.sources.tables import table


@query(
    "x1_clean_text",
    "SELECT doc_id, length(regexp_replace(lower(text), '[^\\x{4e00}-\\x{9fa5}a-z0-9]', '', 'g'))::INT AS n, md5(regexp_replace(lower(text), '[^\\x{4e00}-\\x{9fa5}a-z0-9]', '', 'g')) AS digest FROM documents",
)
def x1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


@query(
    "x2_tokenize",
    "SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tok FROM documents) GROUP BY tok",
)
def x2_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("tok"))
    per_doc = words.groupBy("tok", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("tok").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


@query(
    "x3_normalize_text",
    "SELECT item_id, md5(regexp_replace(lower(text), '[\\s，。！？、；：,.!?;:\"''()（）\\[\\]【】<>《》“”‘’`~\\-_/\\\\|]+', '', 'g')) AS digest FROM benchmark",
)
def x3_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query(
    "x4_ngram_overlap",
    """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part),
    g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS y FROM p),
    n AS (SELECT p_partkey, len(list_intersect(x, y)) AS i, len(x) AS nx, len(list_distinct(list_concat(x, y))) AS u FROM g)
    SELECT p_partkey, round(i / u, 6) AS jaccard, round(i / nx, 6) AS containment FROM n""",
)
def x4_ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "part").select("p_partkey", T.char_ngrams(F.lower("p_name")).alias("x"), T.char_ngrams(F.lower("p_type")).alias("y"))
    return grams.select("p_partkey", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(T.containment(F.col("x"), F.col("y")), 6).alias("containment"))


@query("x8_word_count", "SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9_]+'))::INT AS n FROM documents")
def x8_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


@query(
    "x9_time_conversions",
    """SELECT event_id, printf('%02d:%02d:%02d,000', s // 3600, (s // 60) % 60, s % 60) AS hms, printf('%02d:%02d', s // 60, s % 60) AS ms, s::DOUBLE AS sec
    FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)""",
)
def x9_time_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 100).alias("s"))
    return e.select("event_id", T.hms(F.col("s")).alias("hms"), T.minutes_seconds(F.col("s")).alias("ms"), T.seconds_of(T.minutes_seconds(F.col("s"))).alias("sec"))


@query(
    "x10_cue_ids",
    """WITH c AS (SELECT event_id, concat_ws('_', user_id::VARCHAR, floor(value * 1000)::BIGINT::VARCHAR, floor((value + 5) * 1000)::BIGINT::VARCHAR) AS cue_id FROM events)
    SELECT event_id, cue_id, round(split_part(cue_id, '_', 2)::DOUBLE / 1000, 6) AS start_sec, round(split_part(cue_id, '_', 3)::DOUBLE / 1000, 6) AS end_sec FROM c""",
)
def x10_cue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("event_id", T.cue_id(F.col("user_id"), F.col("value"), F.col("value") + 5).alias("cue_id"))
    t = T.cue_times(F.col("cue_id"))
    return c.select("event_id", "cue_id", F.round(t["start_sec"], 6).alias("start_sec"), F.round(t["end_sec"], 6).alias("end_sec"))


@query("x15_effective_length", "SELECT p_partkey, length(regexp_replace(replace(p_name, '…', ''), '\\s', '', 'g'))::INT AS n FROM part")
def x15_effective_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.effective_length(F.col("p_name")).alias("n"))


@query(
    "x17_slug",
    "SELECT p_partkey, concat_ws('-', nullif(left(trim(regexp_replace(lower(p_name), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '-', 'g'), '-'), 40), ''), left(sha1(p_name), 8)) AS slug FROM part",
)
def x17_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query(
    "x14_sentences",
    """WITH s AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^。！？!?.;；\\n]*[。！？!?.;；\\n]|[^。！？!?.;；\\n]+')), concat(' ', chr(10))) AS s FROM documents)
    SELECT doc_id, count(*) AS n_sentences, count(DISTINCT s) AS n_distinct FROM s WHERE s <> '' GROUP BY doc_id""",
)
def x14_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.split("text", "(?<=[。！？!?.;；\\n])")
    kept = F.filter(F.transform(cut, lambda s: F.btrim(s, F.lit(" \n"))), lambda s: s != "")
    d = table(spark, sf_dir, "documents").select("doc_id", kept.alias("s"))
    return d.filter(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"))


@query(
    "x26_light_importance",
    "SELECT l_partkey, round(0.75 * ln(1 + count(*)) + 0.25 * ln(1 + count(DISTINCT l_suppkey)), 6) AS score FROM lineitem GROUP BY l_partkey",
)
def x26_light_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("m"), F.countDistinct("l_suppkey").alias("d"))
    return g.select("l_partkey", F.round(0.75 * F.log1p("m") + 0.25 * F.log1p("d"), 6).alias("score"))


@query("x27_node_size", "SELECT vec_id, round(10 + 26 * greatest(0, least(1, embedding[1]::DOUBLE)), 4) AS size FROM embeddings")
def x27_node_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(10 + 26 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("size"))


@query(
    "x23_hash_embedding",
    """WITH k AS (SELECT item_id, md5(tok) AS h FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tok FROM benchmark)),
    v AS (SELECT item_id, (('0x' || h)::UHUGEINT % 384)::INT AS dim, sum(CASE WHEN (('0x' || right(h, 1))::INT >> 1) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM k GROUP BY ALL)
    SELECT item_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS v FROM v WHERE x <> 0""",
)
def x23_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenkg.operators.retrieval import hash_embedding

    v = hash_embedding(table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("tok")), "item_id")
    return v.select("item_id", "dim", F.round("v", 6).alias("v"))
