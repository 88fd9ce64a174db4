"""Packing and SentencePiece: chunked encoding equals the libraries' own, and no id is lost."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from lumenkg.llm.packing import PackRules, WordEncoder, pack_documents, pack_lengths, step_groups  # noqa: E402
from lumenkg.llm.spm import ChunkTable, encode_decode  # noqa: E402

ALPHABET = list("ab cd  eE'sé́\n\t\r  ▁<>|\x1c\x85ßİΣ1,.") + ["'re", "<s>", "<|endoftext|>", "\U0001f600", "the ", "\x00", "你好"]


def odd_texts(n=300):
    rng = random.Random(5)
    fixed = ["", " ", "  ", " a", "a ", "\n", "▁", "a▁b", "x" * 5000, "Ab  c\n\n d", "<|endoftext|> a"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path, texts = P.path("word_bpe_49k.json"), odd_texts()
    own = Tokenizer.from_file(path)
    for t, b in zip(texts, WordEncoder(path, 50).encode(texts)):
        assert np.frombuffer(b, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunk_table_equals_sentencepiece():
    import sentencepiece

    path, texts = P.path("piece_bpe_32k.model"), odd_texts(800)
    sp, chunks = sentencepiece.SentencePieceProcessor(model_file=path), ChunkTable(path)
    assert chunks.cuts
    for t, b in zip(texts, chunks.encode(texts)):
        assert np.frombuffer(b, "<i4").tolist() == sp.encode(t), repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_every_id_is_packed_once_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, rng.randrange(1, 300), rng.randrange(1, 9000)]) for _ in range(rng.randrange(0, 200))]
    rules = PackRules(context=2048)
    sequences = pack_lengths(lengths, rules)
    seen = sorted(p for s in sequences for p in s)
    at = {d: 0 for d in range(len(lengths))}
    for doc, start, n in seen:
        assert start == at[doc] and n > 0
        at[doc] += n
    assert [at[d] for d in range(len(lengths))] == lengths
    sizes = [sum(p[2] for p in s) for s in sequences]
    assert all(0 < x <= 2048 and x & (x - 1) == 0 for x in sizes)
    groups = step_groups(sequences, 65536)
    assert len(groups) == len(sequences)


def test_pack_documents_rows(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "The the cat", "x"), (2, None, "y"), (2, "", "y"), (None, "a b", "z"), (3, "word " * 5000, "w")], "doc_id long, text string, sequence_id string")
    rows = pack_documents(spark, docs, path).collect()
    own = Tokenizer.from_file(path)
    three = sorted((r for r in rows if r.doc_id == 3), key=lambda r: r.start)
    ids = np.array(own.encode("word " * 5000, add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert b"".join(r.ids_le for r in three) == ids and zlib.crc32(ids) == zlib.crc32(b"".join(r.ids_le for r in three))
    assert sum(r.length for r in rows if r.doc_id == 2) == 2
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
    assert pack_documents(spark, docs.limit(0), path).count() == 0


def test_round_trip_rows(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n x", 5), (2, None, 6), (None, "é", 7)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in encode_decode(spark, docs, P.path("piece_bpe_32k.model")).collect()}
    assert rows[1].decoded == "Hello  world\n x" and rows[2].ids == [] and rows[2].decoded == "" and rows[None].decoded == "é"
