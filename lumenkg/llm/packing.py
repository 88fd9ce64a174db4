"""Hierarchical multi-length packing of tokenized documents.

A document's ids (its tokens and one end id) are cut at the context size; full windows
are sequences of their own.  What remains is routed to the smallest tier (a power of two)
that holds it.  Tiers are packed from the longest down: each window takes one remainder of
its tier, then whole remainders of shorter tiers by best fit, and a last gap is filled by
cutting a shorter remainder.  Windows that nothing is left for are cut into powers of two,
so no sequence holds padding unless the smallest tier forbids it.  Sequences are then
dealt to step groups of equal token budget, the costliest (sum of squared lengths) first,
to the group with the least cost so far.

Documents are packed in pools of bounded size inside a partition: nothing is shuffled, a
task holds one pool, and a lost task is packed again alone.  Null texts count as empty and
give the end id alone; repeated rows are packed each; null ids are carried along.
"""

from __future__ import annotations

import bisect
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import prepare, table


@dataclass(frozen=True)
class PackRules:
    context: int = 2048
    smallest_tier: int = 1
    end_id: int = 1
    #: A pool is closed at this many ids or documents.
    pool_ids: int = 1_500_000
    pool_docs: int = 4_000
    #: Sequences of a pool go to step groups of about this many ids.
    step_ids: int = 65_536
    #: Encoded words kept by a worker before its table starts anew.
    memo_words: int = 1_200_000


#: Words that the tokenizer takes as one part and leaves as they are: lower-case Latin-1 letters.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
def byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordEncoder(dict):
    """Ids of texts as little-endian 32-bit bytes; each distinct word is encoded once.

    The tokenizer drops white space, so parts between spaces or line feeds never interact
    and their ids can be put together.  It lower-cases, so texts in Latin-1 are lower-cased
    first to have fewer distinct words.  Words of plain letters go to its merge model
    directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str, memo_words: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo_words = Tokenizer.from_file(path), memo_words
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        probe = "théßÿ"  # the short way is taken only if it agrees with the library
        self.direct = self._direct(probe) == self._whole([probe])[0]
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self[""] = b""

    def _direct(self, word: str) -> bytes:
        shown = word if word.isascii() else word.translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __missing__(self, word: str) -> bytes:
        if self.direct and PLAIN.fullmatch(word):
            ids = self._direct(word)
        elif self.direct and word[-1:] in (".", ",") and PLAIN.fullmatch(word, 0, len(word) - 1):
            ids = self[word[:-1]] + self[word[-1]]  # the tokenizer always cuts between a letter and a stop
        else:
            ids = self._whole([word])[0]
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            try:
                t.encode("latin-1")
                t = t.lower()
            except UnicodeEncodeError:
                pass
            out.append(b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))))
            if len(self) > self.memo_words:
                self._forget()
        return out


def pack_lengths(lengths: list[int], rules: PackRules = PackRules()) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces; every id of every document lies in exactly one piece."""
    full, out = rules.context, []
    tiers = [full >> i for i in range(full.bit_length()) if full >> i >= rules.smallest_tier]
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), shortest first

    def route(doc: int, start: int, length: int) -> None:
        tier = max(tiers[-1], 1 << (length - 1).bit_length())
        bisect.insort(pools[tier], (length, doc, start))

    first: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        cut = n - n % full
        out += [[(doc, s, full)] for s in range(0, cut, full)]
        if n > cut:
            first[max(tiers[-1], 1 << (n - cut - 1).bit_length())].append((n - cut, doc, cut))
    for t in tiers:
        pools[t] = sorted(first[t])
    loose: list[tuple[int, int, int]] = []
    for at, tier in enumerate(tiers):
        shorter = tiers[at + 1 :]
        while pools[tier]:
            length, doc, start = pools[tier].pop()
            window, gap = [(doc, start, length)], tier - length
            while gap:
                best = max(((pool[i - 1][0], t) for t in shorter if (pool := pools[t]) and (i := bisect.bisect_right(pool, (gap, len(lengths), 0)))), default=None)
                if best:
                    pool = pools[best[1]]
                    n, d, s = pool.pop(bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1)
                    window.append((d, s, n))
                    gap -= n
                    continue
                donor = next((pools[t] for t in reversed(shorter) if pools[t]), None)
                if donor is None:
                    break
                n, d, s = donor.pop()
                window.append((d, s, gap))
                route(d, s + gap, n - gap)
                gap = 0
            if gap and tier > 1:
                loose += window
            else:
                out.append(window)
    return out + _cut_to_powers(loose, rules)


def _cut_to_powers(pieces: list[tuple[int, int, int]], rules: PackRules) -> list[list[tuple[int, int, int]]]:
    """Lay pieces end to end and cut them into full contexts, the rest into powers of two."""
    left, sizes = sum(p[2] for p in pieces), []
    sizes = [rules.context] * (left // rules.context)
    rest = left % rules.context
    sizes += [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1 and 1 << i >= rules.smallest_tier]
    if sum(sizes) < left:
        sizes.append(left - sum(sizes))
    out, queue = [], list(reversed(pieces))
    for size in sizes:
        window = []
        while size:
            doc, start, n = queue.pop()
            take = min(n, size)
            window.append((doc, start, take))
            if take < n:
                queue.append((doc, start + take, n - take))
            size -= take
        out.append(window)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step_ids: int) -> list[int]:
    """Group of each sequence: equal token budgets, attention costs balanced, costliest sequences first."""
    sizes = [sum(p[2] for p in s) for s in sequences]
    costs = [sum(p[2] ** 2 for p in s) for s in sequences]
    n = max(1, -(-sum(sizes) // step_ids))
    heap, room, group = [(0, g) for g in range(n)], [step_ids] * n, [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-costs[i], i)):
        skipped = []
        while heap and room[heap[0][1]] < sizes[i]:
            skipped.append(heapq.heappop(heap))
        if heap:
            cost, g = heapq.heappop(heap)
        else:  # no group has room: the budget gives way
            cost, g = skipped.pop(0)
        group[i], room[g] = g, room[g] - sizes[i]
        heapq.heappush(heap, (cost + costs[i], g))
        for x in skipped:
            heapq.heappush(heap, x)
    return group


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier long, step_group long, ids_le binary"


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, rules: PackRules = PackRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece, with its ids (ids_le, unsigned little-endian 32-bit), its sequence, place, tier and step group."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = WordEncoder(tokenizer_path, rules.memo_words), rules.end_id.to_bytes(4, "little")
        sequence = step = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step
            sequences = pack_lengths([len(b) // 4 for b in ids], rules)
            groups, rows = step_groups(sequences, rules.step_ids), []
            for window, g in zip(sequences, groups):
                offset, tier = 0, sum(p[2] for p in window)
                tier = tier if tier & (tier - 1) == 0 else rules.context
                for doc, start, n in window:
                    rows.append((keys[doc], start, n, len(ids[doc]) // 4, sequence, offset, tier, step + g, ids[doc][4 * start : 4 * (start + n)]))
                    offset += n
                sequence += 1
            step += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 8 + [pa.binary()]
            for i in range(0, len(rows), 8_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 8_000]), kinds)], [f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                new = [b + end for b in encoder.encode(part.column(1).to_pylist())]
                ids += new
                keys += part.column(0).to_pylist()
                held += sum(map(len, new)) // 4
                if held >= rules.pool_ids or len(ids) >= rules.pool_docs:
                    yield from packed()
                    ids, keys, held = [], [], 0
        if ids:
            yield from packed()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
