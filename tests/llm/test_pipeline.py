"""Stages of the corpus pipeline: their decisions take effect and clean documents stay as they are."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lumenkg.llm.stages import mask_stage, masked, near_duplicate_stage, quality_stage, toxicity_stage  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiou") + rng.choice("bcdfg") for _ in range(3)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(30, 90)), "en", "s") for i in range(200)]
    labels = [(i, int(i % 5 == 0)) for i in range(200)]
    for i in range(0, 200, 5):
        rows[i] = (i, rows[i][1] + " vexquib vexquob vexquab", "en", "s")
    rows += [(300, "too short", "en", "s"), (301, None, "en", None), (302, rows[1][1], "en", "s"), (303, rows[2][1] + " more", "en", "t"), (304, text(40) + " mail me@x.org", "en", "s"), (None, text(40), "en", "s")]
    return [(*r, len(r[1] or "")) for r in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    kept = quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(text) - {300, 301}
    clean = toxicity_stage(spark, kept, str(tmp_path))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i in text if i not in (300, 301) and not (i is not None and i < 200 and i % 5 == 0)}
    unique = near_duplicate_stage(spark, clean, str(tmp_path))
    ids = {r.doc_id for r in unique.collect()}
    assert unique.columns == docs.columns and {302, 303} & ids == set() and {1, 2, None} <= ids and len(ids) == 162
    hidden = {r.doc_id: r for r in mask_stage(spark, unique, str(tmp_path)).collect()}
    assert hidden[304].text.endswith("mail [EMAIL]") and hidden[304].n_chars == len(hidden[304].text) and hidden[1].text == text[1]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == ids and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "personal data", "packing"]


def test_masked_joins_overlaps():
    assert masked("ab cd ef", [("ip", 0, 5), ("phone", 3, 8)]) == "[IP]" and masked("ab", []) == "ab"
