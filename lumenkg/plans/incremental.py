"""Incremental and streaming queries over events and conversations."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.operators import folds
from lumenkg.registry import query
from lumenkg.sources.commits import VersionedTable, rebuild_changed
from lumenkg.sources.tables import cues, table
from lumenkg.streaming import ingest
from lumenkg.streaming.resume import finished_chunks


@query("t1_upsert_chunks", "SELECT user_id AS segment_id, arg_max(event_type, event_id) AS text, max(event_id) AS seq FROM events WHERE event_type <> 'view' GROUP BY user_id")
def t1_upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("segment_id"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("text"), F.col("event_id").alias("seq"))
    early, late = e.filter("seq < 3000"), e.filter("seq >= 3000")
    return ingest.upsert(ingest.upsert(e.limit(0), early), late)


@query("t2_changed_chunks", "SELECT event_id FROM events WHERE event_id % 10 = 0")
def t2_changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    before = e.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
    known = before.select("event_id", ingest.fingerprint(before, ["event_type", "value"]).alias("digest"))
    return ingest.changed(e, known, "event_id", ["event_type", "value"]).select("event_id")


@query(
    "t_windowed_feedback",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id, count(*) AS n, round(sum(CASE event_type WHEN 'error' THEN 1.2 WHEN 'purchase' THEN 1.5 ELSE 1.0 END), 4)::DOUBLE AS weight FROM events GROUP BY ALL",
)
def t_windowed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_feedback(table(spark, sf_dir, "events"))


@query(
    "t_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def t_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"))


@query("t7_trimmed_history", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def t7_trimmed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(w)).filter("i <= 4").select("conv_id", "turn", "role")


@query("w2_w3_merge_cues")
def w2_w3_merge_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.merge_cues(cues(spark, sf_dir).withColumn("page", F.floor(F.col("start_sec") / 21600).cast("int")))


@query("w11_half_windows")
def w11_half_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.half_windows(cues(spark, sf_dir), 60)


@query(
    "t6_finished_chunks",
    """WITH c AS (SELECT user_id AS key, event_id AS seq, 'v' || (event_id // 2500) AS fingerprint, event_id % 9 AS chunk, event_type AS text FROM events),
    n AS (SELECT *, (fingerprint IS DISTINCT FROM lag(fingerprint) OVER (PARTITION BY key ORDER BY seq))::INT AS fresh FROM c), r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY seq) AS run FROM n)
    SELECT key, seq, fingerprint, chunk, text FROM r QUALIFY row_number() OVER (PARTITION BY key, run, chunk ORDER BY seq) = 1""",
)
def t6_finished_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished_chunks(chunk_events(spark, sf_dir))


def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks out of events: a user is a lecture, whose source changes every 2,500 events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.concat(F.lit("v"), F.expr("event_id DIV 2500")).alias("fingerprint"), (F.col("event_id") % 9).alias("chunk"), F.col("event_type").alias("text")
    )


@query("t3_rebuilt_lectures", "SELECT user_id AS lecture, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY user_id")
def t3_rebuilt_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lectures built from the events before the last one of each user's, then rebuilt: only what changed is computed, and the table is that of all events."""
    from lumenkg.operators.graph import shared_checkpoints

    shared_checkpoints(spark)
    out = VersionedTable(spark, f"{spark.sparkContext.getCheckpointDir()}/lectures-{uuid.uuid4().hex}")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("lecture"), "event_id", "value")
    build = lambda rows: rows.groupBy("lecture").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    last = e.filter("lecture % 3 = 0").groupBy("lecture").agg(F.max("event_id").alias("event_id"))
    rebuild_changed(out, e.join(last, ["lecture", "event_id"], "left_anti"), "lecture", build)
    rebuild_changed(out, e, "lecture", build)
    return out.read().drop("_digest")
