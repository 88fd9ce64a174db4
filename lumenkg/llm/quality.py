"""Document quality rules with a cross-document line-frequency rule, in DataFrame functions only.

Words are runs of characters other than ASCII white space; lines are split at a
line feed.  Everything a document needs for itself is computed inside its row by
array functions, so texts are never shuffled.  Only line hashes are: one
(host, line) row per distinct text and distinct line, counted with partial
aggregation, so a host or a line with a third of all rows spreads over all tasks.

Cases: a null text counts as empty (all counts 0, base_failed); a null host is a host
of its own; repeated rows are judged alike, since a verdict depends on text and host
alone; exact copies count as one document in line frequencies; an empty table gives
an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table

#: ASCII white space as the word pattern excludes it, and the characters that count as symbols.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WHITE_RUN = r"[ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: A line is above its host's limit if more distinct texts than both of these hold it.
    line_min_docs: int = 20
    line_max_percent: float = 1.0
    #: A line that more distinct texts of a host than this hold is above the limit too, whatever the host's size (none: no such limit).
    line_max_docs: int | None = None
    #: Whether exact copies count as so many documents in line frequencies; if not, as one, so that copies of a clean text never make its lines hot.
    copies_count: bool = False
    #: Lines above limits are broadcast up to this many rows (about 50 bytes each), beyond it joined by shuffle.
    broadcast_rows: int = 200_000


def _let(value: Column, body) -> Column:
    """Evaluate value once and use it in body, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def _drop_chars(value: Column, chars: str) -> Column:
    return F.translate(value, chars, "")


def _trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def _line_hash(value: Column) -> Column:
    return F.xxhash64(F.lower(_trimmed(value)))


def _words(value: Column) -> Column:
    """Words of a text, as an array; value is mentioned twice only."""
    return _let(_trimmed(value), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WHITE_RUN)))


def _covered(hashes: Column, window: int) -> Column:
    """How many words lie in windows whose hash occurs at least twice in hashes.

    Windows sorted by hash have their equals as neighbours; the starts of repeated ones,
    sorted, each cover the words up to the next start, window at most.
    """

    def starts(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        repeated = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)))
        return F.array_sort(F.transform(repeated, lambda i: F.get(pairs, i)["p"]))

    def total(s: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(s, first, step, lambda a: a["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(_let(pairs, starts), total))


def document_features(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: its id, host, text hash, own counts, and its lines with a word as (h, n) structs."""
    k = rules.window

    def repeat_words(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
        return F.when(F.size(words) <= k, 0).otherwise(_let(grams, lambda h: _covered(h, k)))

    def line(x: Column) -> Column:
        return F.struct(_line_hash(x).alias("h"), F.size(_words(x)).alias("n"))

    own = docs.select(F.col(key), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counted = own.select(
        key,
        "host",
        F.xxhash64("t").alias("text_hash"),
        _let(_words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("w"),
        _let(_drop_chars(F.col("t"), WHITE), lambda b: F.struct(F.length(b).alias("n"), F.length(_drop_chars(b, SYMBOLS)).alias("plain"))).alias("b"),
        _let(
            F.filter(F.split("t", "\n"), lambda x: _trimmed(x) != ""),
            lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"), F.transform(ls, line).alias("lines")),
        ).alias("l"),
    )
    return counted.select(
        key,
        "host",
        "text_hash",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("b.n").cast("long").alias("word_chars"),
        (F.col("b.n") - F.col("b.plain")).cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"),
        F.col("l.lines").alias("lines"),
    )


def lines_above_limit(features: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(host, h) of lines that more distinct texts of the host hold than its limit allows."""
    lines = F.array_distinct(F.col("lines.h"))
    texts = features.select("host", lines.alias("hs")) if rules.copies_count else features.groupBy("host", "text_hash").agg(F.first(lines).alias("hs"))
    totals = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    held = texts.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > rules.line_min_docs)
    return (
        held.alias("a")
        .join(totals.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
        .filter((F.col("n") * 100.0 > F.col("n_texts") * rules.line_max_percent) | (F.lit(False) if rules.line_max_docs is None else F.col("n") > rules.line_max_docs))
        .select("a.host", "a.h")
    )


def judge_documents(spark: SparkSession, docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """Verdict per document.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in
    repeated windows.  Other documents lose the lines above their host's limit and are
    rejected as depleted if fewer than min_words words remain (column kept).  removed_lines
    holds the hashes of the lines that are lost, for without_lines().
    """
    prepare(spark)
    features = checkpointed(document_features(docs, rules, text, host, key).withColumn("_row", F.monotonically_increasing_id()))
    hot = checkpointed(lines_above_limit(features, rules))
    few = hot.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows
    mine = features.select("_row", "host", F.explode("lines").alias("x")).select("_row", "host", "x.h", "x.n")
    hit = mine.alias("m").join(
        F.broadcast(hot.alias("t")) if few else hot.alias("t"),
        (F.col("m.h") == F.col("t.h")) & F.col("m.host").eqNullSafe(F.col("t.host")),
    )
    lost = hit.groupBy(F.col("m._row").alias("_row")).agg(F.sum("m.n").alias("n_removed_words"), F.collect_set("m.h").alias("removed_lines"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return (
        features.drop("lines")
        .join(lost, "_row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("n_removed_words") >= rules.min_words))
        .drop("_row")
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is in removed; other lines, blank ones too, stay as they are."""
    stays = lambda x: (_trimmed(x) == "") | ~F.array_contains(removed, _line_hash(x))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def clean_documents(spark: SparkSession, docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """The kept documents, without the lines above limits; all columns of docs, n_chars (if there) as the length of what is left.

    Verdicts depend on text and host, so rows that repeat an id, a text and a host share one;
    the id is in the join to spread copies.  Texts with neither a loss nor a rejection meet no verdict.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # other columns may have any name
    t, h, k = (f"c{names.index(c)}" for c in (text, host, key))
    touched = judge_documents(spark, plain, rules, t, h, k).filter("NOT kept OR size(removed_lines) > 0")
    touched = touched.select(F.col(k).alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_th"), F.col("kept").alias("_kept"), F.col("removed_lines").alias("_gone")).dropDuplicates(["_id", "_host", "_th"])
    same = F.col(k).eqNullSafe(F.col("_id")) & F.col(h).eqNullSafe(F.col("_host")) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col("_th"))
    rows = plain.join(touched, same, "left").filter("_kept IS NULL OR _kept")
    changed = F.col("_gone").isNotNull()
    out = rows.withColumn(t, F.when(changed, without_lines(F.col(t), F.col("_gone"))).otherwise(F.col(t)))
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        out = out.withColumn(n, F.when(changed, F.length(t).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(plain.columns).toDF(*names)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_documents(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i+4], ' ')) AS gs FROM w),
gp AS (SELECT r, unnest(gs) AS gram, generate_subscripts(gs, 1) AS p FROM g),
rep AS (SELECT r, p FROM gp QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
cov AS (SELECT r, count(DISTINCT p + o) AS n FROM rep, range(0, 5) AS x(o) GROUP BY r),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              lower(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS norm FROM l),
lk AS (SELECT * FROM lw WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lk GROUP BY r),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
hot AS (SELECT k.source, k.norm FROM lk k GROUP BY k.source, k.norm
        HAVING count(DISTINCT k.t) > 20 AND count(DISTINCT k.t) * 100.0 > (SELECT h.n FROM hosts h WHERE h.source IS NOT DISTINCT FROM k.source)),
gone AS (SELECT k.r, sum(k.n)::BIGINT AS n FROM lk k JOIN hot h ON k.norm = h.norm AND k.source IS NOT DISTINCT FROM h.source GROUP BY k.r),
m AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words,
             length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)) AND n_words - n_removed_words >= 10 AS kept
FROM m
"""
