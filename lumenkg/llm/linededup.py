"""Line dedup across documents by range-partitioned line hashes, in DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Scans
turn every line into a narrow row: two 64-bit hashes of its key, its document and its
position.  The rows are range-partitioned by hash and sorted by document and position
behind it, so each task streams over its hashes in order and sees where every document
first holds a line.  The range key ends with the number of the input split: a line that
a third of all documents hold is cut into as many runs as there are splits, and what
leaves a run is one row (documents in it, first occurrence).  Runs of a hash are then
added up.  What comes back to a document is a bitmap of its lines, run-length coded, never a text.

Cases: a null or empty text is one empty line; keys of fewer than min_chars code points
are never repeated lines; every row is a document of its own, whether its id is null or
repeated, so ten equal rows are ten documents; rows with one id and one text share a
bitmap; a line that recurs inside one document counts once; of ties for the first
occurrence (keep_first) the smallest id (null first), then the smaller text hash, then the
earlier line stays, in every row that repeats both; an empty table gives an empty result;
texts of any length are read whole, in linear time.  Other columns are not read, whatever their names.  Two keys are
taken for one if both 64-bit hashes agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table

#: ASCII white space, and the letters that are lower-cased.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LineRules:
    #: A line that at least so many documents hold is a repeated one.
    min_docs: int = 10
    #: Keys shorter than this (code points) are never repeated lines.
    min_chars: int = 1
    #: Whether the first occurrence of a repeated line stays.
    keep_first: bool = False
    #: Repeated lines are broadcast up to this many rows (about 40 bytes each), beyond it joined by shuffle.
    broadcast_rows: int = 300_000


def lowered(line: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, UPPER.lower()))


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))


def line_rows(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(h1, h2, split, doc, th, row, pos): every line that may be a repeated one; row tells rows of one run apart."""
    numbered = _texts(docs, text, key).withColumns({"split": F.spark_partition_id(), "row": F.monotonically_increasing_id()})  # before a row's lines part
    lines = numbered.select("doc", "th", "split", "row", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    # Lower-casing keeps the length, so short lines go before it, and ends are cut once.
    cut = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).filter(F.length("line") >= max(rules.min_chars, 1))
    keyed = cut.withColumn("line", lowered(F.col("line")))
    return keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(13), "line").alias("h2"), "split", "doc", "th", "row", "pos")


def repeated_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(h1, h2, n_docs, first): lines that at least min_docs documents hold, with their first occurrence."""
    ranged = line_rows(docs, rules, text, key).repartitionByRange("h1", "h2", "split")
    stream = Window.partitionBy("h1", "h2", "split").orderBy("doc", "row", "pos")
    enters = F.coalesce(F.lag("row").over(stream) != F.col("row"), F.lit(True))
    runs = ranged.withColumn("enters", enters).filter("enters").groupBy("h1", "h2", "split").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "pos")).alias("first"))
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first")).filter(F.col("n_docs") >= rules.min_docs)


def _runs(gone: Column) -> Column:
    """Sorted positions of dropped lines as lengths of alternating runs: kept, dropped, kept, dropped, ..."""
    starts = F.filter(F.sequence(F.lit(0), F.size(gone) - 1), lambda i: (i == 0) | (F.get(gone, i) - F.get(gone, i - 1) > 1))
    ends = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(gone))

    def run(s: Column, i: Column, j: Column) -> Column:
        before = F.when(i == 0, F.get(gone, i)).otherwise(F.get(gone, i) - F.get(gone, i - 1) - 1)
        return F.array(before, ends(s, j) - i)

    return F.flatten(F.transform(F.array(starts), lambda s: F.flatten(F.transform(s, lambda i, j: run(s, i, j)))))


def keep_bitmaps(spark: SparkSession, docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, th, n_dropped, runs) per id and text hash with a dropped line: runs are lengths of kept and dropped lines in turn."""
    prepare(spark)
    repeated = checkpointed(repeated_lines(docs, rules, text, key))
    few = repeated.count() <= rules.broadcast_rows
    met = line_rows(docs, rules, text, key).join(F.broadcast(repeated) if few else repeated, ["h1", "h2"])
    if rules.keep_first:
        met = met.filter(~F.struct("doc", "th", "pos").eqNullSafe(F.col("first")))
    dropped = met.groupBy("doc", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return dropped.select("doc", "th", F.size("gone").alias("n_dropped"), _runs(F.col("gone")).alias("runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept text) per row of docs."""
    own = _texts(docs, text, key).alias("d")
    marks = bitmaps.alias("b")
    rows = own.join(marks, F.col("d.doc").eqNullSafe(F.col("b.doc")) & (F.col("d.th") == F.col("b.th")), "left")
    lines = rows.select(
        F.col("d.doc").alias(key),
        F.col("d.t").alias("t"),
        F.split("d.t", "\n").alias("lines"),
        F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.flatten(F.transform("b.runs", lambda n, i: F.array_repeat(i % 2 == 0, n))).alias("bits"),
    )
    kept = F.array_join(F.filter("lines", lambda x, i: F.coalesce(F.get("bits", i), F.lit(True))), "\n")
    return lines.select(key, F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.when(F.col("n_dropped") == 0, F.col("t")).otherwise(kept).alias("kept"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(spark, docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT r, p, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
hot AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*)::BIGINT AS n, count(*) FILTER (WHERE hot.k IS NOT NULL)::BIGINT AS gone,
             string_agg(line, chr(10) ORDER BY p) FILTER (WHERE hot.k IS NULL) AS kept
      FROM k LEFT JOIN hot ON k.k = hot.k GROUP BY r)
SELECT doc_id, n AS n_lines, gone AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN o USING (r)
"""
