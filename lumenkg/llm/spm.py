"""SentencePiece encoding and decoding through a table of distinct marked words.

The model normalises nothing but the space, which becomes a marker, and no piece holds a
marker after another character.  So pieces never cross the start of a run of markers: a
text is cut there into parts (markers and the word after them).  The parts of the whole
corpus are counted; the distinct ones that occur more than once make a table in the shared
folder, in which each is segmented once; ids are joined back by position inside each task, so neither texts nor
positions are shuffled.  The join looks parts up in the most frequent rows of the table,
broadcast within a bound (table_rows of at most part_chars characters); parts beyond it,
rare ones and those that occur once, are segmented where they occur, with the same ids.  A model whose pieces
do cross markers is encoded whole.

Cases: null texts count as empty and give no ids and an empty text; repeated rows are each
kept; a null id is carried along; an empty table gives an empty result; a text of any
length is encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table

MARK = "▁"
PART = re.compile(" +[^ ]*")


@dataclass(frozen=True)
class ChunkRules:
    #: Bounds of what is broadcast: rows of the table, the most frequent ones, and characters of a part.
    table_rows: int = 300_000
    part_chars: int = 48
    #: Parts that a task counts, or segments beyond the table, before it starts anew.
    task_chunks: int = 400_000


class ChunkTable:
    """Ids of texts from a table of parts; parts that it lacks are segmented and kept while they are few."""

    def __init__(self, model_path: str, known: dict[str, bytes] | None = None, max_chunks: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.max_chunks, self.known = max_chunks, known or {}
        self.memo = dict(self.known)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        # What the cut relies on: no marker inside a piece, a marker added in front, all else left as it is.
        odd = "x  \t\ny 　é"
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.normalize(odd) == MARK + odd.replace(" ", MARK)

    def _ids(self, part: str) -> bytes:
        ids = [self.sp.piece_to_id(MARK)] if part == " " else self.sp.encode(part[1:], out_type=int, num_threads=1)
        return np.array(ids, "<i4").tobytes()

    def parts(self, text: str) -> list[str]:
        """A text cut in front of each run of spaces, its first part preceded by one."""
        if not text:
            return []
        marked = " " + text.replace(MARK, " ")
        if "  " in marked or marked[-1] == " ":
            return PART.findall(marked)
        return [" " + w for w in marked[1:].split(" ")]

    def segmented(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, in blocks."""
        out = []
        for i in range(0, len(parts), 20_000):
            block = parts[i : i + 20_000]
            made = iter(self.sp.encode([p[1:] for p in block if p != " "], out_type=int, num_threads=1))
            out += [self._ids(p) if p == " " else np.array(next(made), "<i4").tobytes() for p in block]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(x, "<i4").tobytes() for x in self.sp.encode(texts, out_type=int, num_threads=1)]
        if len(self.memo) > len(self.known) + self.max_chunks:
            self.memo = dict(self.known)
        memo, cut = self.memo, [self.parts(t) for t in texts]
        missing = list({p for parts in cut for p in parts if p not in memo})
        memo.update(zip(missing, self.segmented(missing)))
        return [b"".join(map(memo.__getitem__, parts)) for parts in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1)


def distinct_chunks(spark: SparkSession, docs: DataFrame, model_path: str, rules: ChunkRules = ChunkRules(), text: str = "text") -> DataFrame:
    """(part, n, ids) of every distinct part of the corpus within part_chars that occurs n > 1 times, segmented once; in the shared folder."""
    prepare(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, n = ChunkTable(model_path), Counter()

        def told() -> pa.RecordBatch:
            kept = {p: c for p, c in n.items() if len(p) <= rules.part_chars}
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["part", "n"])

        for batch in batches:
            for t in batch.column(0):
                n.update(chunks.parts(t.as_py() or ""))
                if len(n) > rules.task_chunks:
                    yield told()
                    n.clear()
        yield told()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks.segmented(batch.column(0).to_pylist()), pa.binary())], ["part", "n", "ids"])

    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).filter("n > 1")
    return checkpointed(counted.mapInArrow(segment, "part string, n long, ids binary"))


def encode_decode(spark: SparkSession, docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", rules: ChunkRules = ChunkRules()) -> DataFrame:
    """(key, ids array<int>, decoded string) per row."""
    prepare(spark)
    known = {}
    if ChunkTable(model_path).cuts:
        found = distinct_chunks(spark, docs, model_path, rules, text)
        # The least count whose parts, with all more frequent ones, keep within the bound; no sort of the table is needed.
        room, least = rules.table_rows, None
        for r in sorted(found.groupBy("n").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.n):
            if r.rows > room:
                break
            room, least = room - r.rows, r.n
        if least is not None:
            got = found.filter(F.col("n") >= least).select("part", "ids").toArrow()
            known = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_path, shared.value, rules.task_chunks)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = chunks.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(b) // 4 for b in raw)], dtype=np.int32)
                flat = np.frombuffer(b"".join(raw), "<i4")
                decoded = chunks.decode([flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())], ["k", "ids", "decoded"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "k long, ids array<int>, decoded string").withColumnRenamed("k", key)


def op3_sentencepiece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
