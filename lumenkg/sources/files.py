"""Readers and writers of the course files: JSON lines, subtitles, time nodes, textbook graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.functions.text import hms, seconds_of

CUES = "course_id string, lecture_id string, cue_id string, segment_id string, start_sec double, end_sec double, asr_text string, boundary_type string, clip_path string, keywords array<string>, extra map<string,string>"
TRIPLETS = (
    "lecture_id string, cue_id string, subject string, object string, h string, head string, source string, t string, tail string, target string, abstract_relation string, concrete_relation string, "
    "statement_direction string, description string, context string, source_text string, extract_source string, start_sec double, end_sec double"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cue records; segment_id stands in for a missing cue_id."""
    return read_jsonl(spark, path, CUES).withColumn("cue_id", F.coalesce("cue_id", "segment_id"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Triplet records under any of their names for head and tail."""
    t = read_jsonl(spark, path, TRIPLETS)
    t = t.withColumn("subject", F.coalesce("subject", "head", "h", "source")).withColumn("object", F.coalesce("object", "tail", "t", "target"))
    return t.drop("h", "head", "source", "t", "tail", "target")


#: One subtitle: its number, two times, and text up to a blank line.
SRT = r"(?s)(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})[^\n]*\n(.*?)(?=\n\s*\n|\z)"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, start_sec, end_sec, text) of subtitle files; text lines are joined by a space."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("v"))
    parts = [F.regexp_extract_all("v", F.lit(SRT), F.lit(i)) for i in (1, 2, 3)]
    cue = whole.select("file", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc")])).alias("pos", "x"))
    text = F.trim(F.regexp_replace("x.c", r"\s+", " "))
    return cue.select("file", "pos", seconds_of(F.col("x.a")).alias("start_sec"), seconds_of(F.col("x.b")).alias("end_sec"), text.alias("text")).filter("text <> ''")


def srt_lines(cues: DataFrame, number: str = "pos") -> DataFrame:
    """Subtitle blocks (number, value) ready for a text sink; numbers start at 1."""
    value = F.format_string("%d\n%s --> %s\n%s\n", F.col(number) + 1, hms(F.col("start_sec")), hms(F.col("end_sec")), F.col("text"))
    return cues.select(F.col(number), value.alias("value"))


def read_time_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct seconds of a file with a MM:SS or HH:MM:SS per line, ascending; other lines are skipped."""
    t = spark.read.text(path).select(seconds_of(F.trim("value")).alias("sec"))
    return t.filter(F.col("sec").isNotNull()).distinct().orderBy("sec")


def textbook_graph(entities: DataFrame, relations: DataFrame, importance: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): entities are listed ones and ends of relations; a global importance replaces a listed one."""
    ends = relations.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    out = ends.join(entities, "name", "full")
    if importance is not None:
        top = importance.filter("chapter IS NULL").groupBy(F.col("entity").alias("name")).agg(F.max("score").alias("_score"))
        out = out.join(top, "name", "left").withColumn("importance", F.coalesce("_score", "importance")).drop("_score")
    return out, relations.dropDuplicates(["subject", "predicate", "object"])


def importance_rows(spark: SparkSession, path: str) -> DataFrame:
    """(entity, chapter, score) of an importance file in any of four shapes: a map, [name, score] pairs, records, or a bundle of these."""
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    as_map = v.select(F.explode(F.try_variant_get("v", "$", "map<string,double>")).alias("entity", "score"), F.lit(None).cast("string").alias("chapter"))
    pairs = v.select(F.explode(F.try_variant_get("v", "$", "array<array<string>>")).alias("x")).select(F.col("x")[0].alias("entity"), F.col("x")[1].try_cast("double").alias("score"), F.lit(None).cast("string").alias("chapter"))
    records = v.select(F.explode(F.try_variant_get("v", "$", "array<struct<name:string,entity:string,score:double,importance:double>>")).alias("x"))
    records = records.select(F.coalesce("x.name", "x.entity").alias("entity"), F.coalesce("x.score", "x.importance").alias("score"), F.lit(None).cast("string").alias("chapter"))
    top = v.select(F.explode(F.try_variant_get("v", "$.global", "map<string,double>")).alias("entity", "score"), F.lit(None).cast("string").alias("chapter"))
    by = v.select(F.explode(F.try_variant_get("v", "$.chapters", "map<string,map<string,double>>")).alias("chapter", "m")).select(F.explode("m").alias("entity", "score"), "chapter")
    all_ = as_map.select("entity", "chapter", "score")
    for part in (pairs, records, top, by):
        all_ = all_.unionByName(part.select("entity", "chapter", "score"))
    return all_.filter(F.col("entity").isNotNull() & F.col("score").isNotNull())
