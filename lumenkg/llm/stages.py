"""Stages of the corpus pipeline: each applies one operator and lets its decisions take effect."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table
from lumenkg.llm.neardup import near_duplicates
from lumenkg.llm.packing import pack_documents
from lumenkg.llm.pii import base_spans, find_personal_data
from lumenkg.llm.quality import QualityRules, clean_documents
from lumenkg.llm.toxicity import ToxicityRules, learned_toxicity, score_toxicity

#: A line in more distinct texts of a source is boilerplate, also where 1 % of the source's texts is more.
LINE_MAX_DOCS = 1000


def numbered(docs: DataFrame, *columns: str) -> tuple:
    """docs with columns named c0, c1, ... since others may have any name, and the new names of some."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), *[f"c{docs.columns.index(c)}" for c in columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their lines above limits; null and empty texts are rejected as too short, repeated rows are judged alike."""
    return clean_documents(spark, docs, QualityRules(line_max_docs=LINE_MAX_DOCS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut; the model is fitted on the labelled ones among docs.

    Null and empty texts hold no toxic token and stay unless toxic documents prevail among
    the labelled ones; equal texts get equal verdicts; long texts are scored whole.
    """
    prepare(spark)
    rules = ToxicityRules()
    model = learned_toxicity(docs, table(spark, sf_dir, "labels"), rules)
    plain, text = numbered(docs, "text")
    return score_toxicity(spark, plain, model, rules, text, carry=tuple(plain.columns)).filter("predicted = 0").select(plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Of rows that repeat an id, those of different groups are judged apart; near or exact
    copies under one id leave one row, of the text with the smallest hash.  Rows with a null id and documents without words are copies of nothing and stay.
    """
    near = near_duplicates(spark, docs).filter("doc_id IS NOT NULL AND n_shingles > 0")
    near = checkpointed(near.groupBy("doc_id", "text_hash").agg(F.first("part").alias("part"), F.bool_and("kept").alias("kept"), F.count("*").alias("n")))
    stays = near.filter("kept").groupBy("doc_id", "part").agg(F.min("text_hash").alias("stays"))
    gone = near.join(stays, ["doc_id", "part"], "left").filter("NOT kept OR text_hash != stays").select("doc_id", "text_hash")
    plain, key, text = numbered(docs, "doc_id", "text")
    rows = plain.join(gone, (F.col(key) == F.col("doc_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("text_hash")), "left_anti")
    repeated = near.filter("n > 1").select(F.col("doc_id").alias(key)).distinct()
    if not repeated.isEmpty():
        twice = rows.join(repeated, key, "left_semi").select(plain.columns)
        rows = rows.join(repeated, key, "left_anti").select(plain.columns).unionByName(twice.dropDuplicates([key, text]))
    return rows.toDF(*docs.columns)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans, overlapping ones joined, replaced by the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, max_broadcast: int = 100_000) -> DataFrame:
    """Texts with every span of personal data replaced by its kind in brackets; n_chars follows.

    Rows of equal id and text have equal spans, so spans found by context are joined by a
    hash of both; they are broadcast up to max_broadcast rows and joined by shuffle beyond
    it.  Null and empty texts, and texts without a span, stay as they are, whatever their
    length; no row goes.
    """
    names = docs.columns
    plain, key, text = numbered(docs, "doc_id", "text")
    keyed = plain.withColumn("_h", F.xxhash64(key, text))
    extra = find_personal_data(spark, keyed, text=text, key="_h").filter(F.size("extra") > 0).select("_h", "extra").dropDuplicates(["_h"])
    extra = checkpointed(extra)
    few = extra.limit(max_broadcast + 1).count() <= max_broadcast
    rows = keyed.join(F.broadcast(extra) if few else extra, "_h", "left").select("extra", *plain.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, more in zip(batch.column(at + 1).to_pylist(), batch.column(0).to_pylist()):
                spans = base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in more or ()]
                texts.append(masked(t, spans) if spans else t)
            columns = batch.columns[1:]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    out = rows.mapInArrow(run, plain.schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids; null and empty texts give their end id alone, a long text several pieces, repeated rows are each packed."""
    import public_tokenizers

    return pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
