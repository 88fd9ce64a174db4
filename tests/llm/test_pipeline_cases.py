"""Stages of the pipeline on odd tables: clashing names, repeated ids, long and empty texts, no rows; and run() against a plain reckoning."""

import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lumenkg.llm import neardup  # noqa: E402
from lumenkg.llm.pii import base_spans  # noqa: E402
from lumenkg.llm.stages import mask_stage, masked, near_duplicate_stage, quality_stage, toxicity_stage  # noqa: E402

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, extra int, _h long, _id int, _th int, predicted int, n_spans int, removed_lines string, kept int, `a.b` int, Text_hash long"


def words(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfg") for _ in range(3)) for _ in range(n))


def table(rows):
    return [(i, t, "en", s, len(t or ""), 0.1, "s", 1, 2, 3, 4, 5, 6, "r", 7, 8, 9) for i, t, s in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(5)
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, words(rng, 40), "s") for i in range(60)]
    for i in range(0, 60, 4):
        rows[i] = (i, rows[i][1] + " vexquib vexquob vexquab", "s")
    rows += [(70, rows[1][1], "s"), (71, words(rng, 40), "s"), (71, words(rng, 40), "t"), (72, rows[3][1], "s"), (72, words(rng, 50), "s"), (73, words(rng, 30), "s"), (73, None, "s")]
    rows += [(74, None, None), (75, "", "s"), (76, words(rng, 100_000) + " me@mail.example.org", "s"), (None, words(rng, 40), "s")]
    rows += [rows[5], rows[5]]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(table(rows), ODD).repartition(2).write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_stages_bear_any_columns(spark, odd):
    at, rows = odd
    docs = spark.read.parquet(f"{at}/documents.parquet")
    text = dict(enumerate(rows))
    good = quality_stage(spark, docs, at)
    assert good.columns == docs.columns and sorted(str(r[0]) for r in good.collect()) == sorted(str(i) for i, t, _ in rows if t)
    clean = toxicity_stage(spark, good, at)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t, _ in rows if t and not (i is not None and i < 60 and i % 4 == 0)}
    kept = near_duplicate_stage(spark, clean, at)
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert kept.columns == docs.columns and len(got) == len(set(got))
    ids = [i for i, _ in got]
    assert "70" not in ids and ids.count("5") == 1 and ids.count("72") == 1 and ids.count("71") == 2 and "None" in ids and "1" in ids
    assert next(t for i, t in got if i == "72") == text[len(rows) - 9][1]
    hidden = mask_stage(spark, kept, at)
    long = next(r for r in hidden.collect() if r.doc_id == 76)
    assert hidden.columns == docs.columns and long.text.endswith(" [EMAIL]") and long.n_chars == len(long.text) > 600_000 and long["Text_hash"] == 9


def test_no_rows(spark, odd):
    at, _ = odd
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.count() == 0
        if out.columns == docs.columns:
            docs = out


def test_run_equals_a_plain_reckoning(spark, odd):
    """Kept documents, masked by the base patterns, give exactly the pieces' ids."""
    from tokenizers import Tokenizer

    at, rows = odd
    encode = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode
    first: dict[str, int] = {}
    for i, t, _ in rows:
        if t and i is not None and not (i < 60 and i % 4 == 0):
            first.setdefault(t, i)
            first[t] = min(first[t], i)
    want = {(i, t) for t, i in first.items()} | {(None, t) for i, t, _ in rows if i is None}
    pieces: dict[tuple, list] = {}
    for p in corpus_pipeline.run(spark, at).collect():
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    plain = {}
    for i, t in want:
        ids = [*encode(masked(t, base_spans(t)), add_special_tokens=False).ids, 1]
        plain.setdefault((i, len(ids)), []).append(ids)
    assert {k: len(v) for k, v in plain.items()} == {k: sum(p.length for p in v) // k[1] for k, v in pieces.items()}
    for key, texts in plain.items():
        if len(texts) == 1:
            got = b"".join(bytes(p.ids_le) for p in sorted(pieces[key], key=lambda p: p.start))
            assert got == b"".join(x.to_bytes(4, "little") for x in texts[0])


def test_near_duplicates_of_different_hubs(spark, monkeypatch):
    """Two groups that share half of their texts, each class its own hub: few pairs of both groups are left to confirm, and one document of each group stays."""
    rng = random.Random(9)
    drawn = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = drawn(120), []
    for g in range(2):
        base = passage + drawn(90)
        for i in range(30):
            at = rng.randrange(len(base))
            rows.append((100 * g + i, " ".join([*base[:at], f"n{g}x{i}", *base[at + 1 :]])))
    tiles, compared, counts = neardup.tiles, neardup.compared, []
    none = F.array().cast("array<bigint>")
    monkeypatch.setattr(neardup, "tiles", lambda *args: tiles(*args).withColumns({"hub": F.col("node"), "inside": F.col("n"), "rest": none, "gone": none}))
    monkeypatch.setattr(neardup, "compared", lambda pairs, *rest: counts.append(pairs.count()) or compared(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicate_stage(spark, docs, "").collect()) == [0, 100]
    assert counts[1] <= 10
