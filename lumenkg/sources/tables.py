"""Scans of the driver tables, and the stand-ins that give them course-knowledge meaning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Python workers import this package from here.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets out of order lines: supplier (subject), part (object), a relation, a cue and a lecture."""
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("row_id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("subject"),
        F.concat(F.lit("P"), F.col("l_partkey") % 200).alias("object"),
        F.when(F.col("l_returnflag") == "A", "related_with").when(F.col("l_returnflag") == "N", "depend_on").otherwise("belong_to").alias("relation"),
        (F.col("l_orderkey") % 40).alias("lecture"),
        F.col("l_orderkey").alias("cue"),
        F.col("l_quantity").alias("weight"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("line "), F.col("l_linenumber"))).otherwise("").alias("statement"),
    )


#: The same as triplets(), for an independent engine.
TRIPLETS_SQL = """t AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row_id, 'S' || l_suppkey AS subject, 'P' || (l_partkey % 200) AS object,
    CASE l_returnflag WHEN 'A' THEN 'related_with' WHEN 'N' THEN 'depend_on' ELSE 'belong_to' END AS relation,
    l_orderkey % 40 AS lecture, l_orderkey AS cue, l_quantity AS weight,
    CASE WHEN l_linestatus = 'O' THEN 'line ' || l_linenumber ELSE '' END AS statement FROM lineitem)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed cues out of events: a user is a lecture, seconds count from 2024-01-01, a cue lasts by its value."""
    sec = F.unix_timestamp("ts") - F.lit(1704067200)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("lecture"),
        F.col("event_id").alias("cue"),
        sec.cast("double").alias("start_sec"),
        (sec + F.least(F.lit(3600.0), F.abs("value") * 60)).cast("double").alias("end_sec"),
        F.col("event_type").alias("text"),
    )


CUES_SQL = """c AS (SELECT user_id AS lecture, event_id AS cue, floor(epoch(ts) - 1704067200)::DOUBLE AS start_sec,
    floor(epoch(ts) - 1704067200)::DOUBLE + least(3600.0, abs(value) * 60) AS end_sec, event_type AS text FROM events)"""
