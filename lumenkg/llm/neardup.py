"""Near-duplicate groups by a signature-coordinate inverted join, links confirmed on full shingle sets.

1. Each text gives its set of distinct 5-word shingles (64-bit hashes) and a signature of
   32 minima.  Texts with one and the same set (128-bit hash) form a class; classes stand
   for their copies from here on, so a group of copies costs one row.
2. A class is posted under each (coordinate, value) of its signature.  Two sets of
   similarity 0.75 collide in 24 of 32 postings on average and in fewer than 12 with a
   probability of about two in a million.  So a partner needs min_matches = 12 collisions:
   values held once are skipped, a class with fewer shared values than that is skipped
   whole, and of the rest only the rarest 32 - 12 + 1 postings (its prefix) are joined,
   since two lists with 12 common entries meet in their prefixes.
3. In each posting every class is compared with one hub, the class whose values are shared
   most (in a group of near copies that is the text they vary): collisions are counted,
   and pairs with enough of them are confirmed on their full sets.  Links to common hubs
   join classes; postings that still hold classes not known to be joined go on.
4. There, all such pairs are compared, tile by tile: postings are cut into tiles of bounded
   size, and each pair of tiles is compared in one block of a task.  A pair is met under
   the first value that both prefixes hold; its collisions are counted, and a bound from
   the hub (two classes share at most the smaller of their parts inside one hub, and what
   their parts outside it share) rules out most members of a large group without a test.
   Pairs of different hubs are held against a bitmap of their sets, 4 to 8 bits a shingle:
   each bit that only one of them sets is a shingle that the other lacks, so it bounds
   what they can share, and only pairs that may still reach a link leave their tile.
   Pairs that remain are confirmed on their full sets.  No pair known to be joined is
   compared, so n near copies of one text cost about n pairs; no other pair is left out.

Cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; a row with a null id is returned with a null component and kept as null; rows
that repeat an id are each returned, and with different texts they are different nodes
that share a name, so links of one do not pull in the other's; ties do not arise, since a
component is named by its smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table
from lumenkg.llm.graph import connected_components


@dataclass(frozen=True)
class NearDupRules:
    shingle_words: int = 5
    coordinates: int = 32
    min_matches: int = 12
    #: A link needs 100 * intersection >= percent * union.
    percent: int = 75
    #: Word hashes kept by a worker before it starts anew.
    memo_words: int = 600_000
    #: Least bits a shingle in the bitmap of a set.
    bits: int = 4
    #: Classes, and bytes of their sets outside hubs and bitmaps, in one tile of a posting.
    tile_rows: int = 2_048
    tile_bytes: int = 16_000_000


class WordHashes(dict):
    """64-bit hash of a word, kept while the table is small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, memo: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (A-Z lower-cased, ASCII white space splits)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, 1469598103934665603 + n, np.uint64)
    for j in range(n):
        h = _mixed(h + ids[j : len(ids) - n + 1 + j])
    return np.unique(h)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    low = np.full(len(a), 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), block):
        low = np.minimum(low, ((shingles[i : i + block, None] * a + b) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def bitmap(shingles: np.ndarray, bits: int = 4) -> np.ndarray:
    """The low bits of each hash set in a bitmap of a power of two; its halves, joined by or, are the bitmap of half the width."""
    flags = np.zeros(max(64, 1 << (bits * len(shingles) - 1).bit_length()), bool)
    flags[shingles & np.uint64(len(flags) - 1)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, rules: NearDupRules = NearDupRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, text_hash, n_shingles, cid, sig) per row; cid names the shingle set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo, (a, b) = WordHashes(), _coefficients(rules.coordinates)
        for batch in batches:
            n, cid, sig = [], [], []
            for t in batch.column(2).cast(pa.binary()):
                s = shingle_set(t.as_py(), memo, rules.shingle_words)
                n.append(len(s))
                cid.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, a, b).view(np.int32) if len(s) else None)
                if len(memo) > rules.memo_words:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["id", "text_hash", "n_shingles", "cid", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, cid binary, sig array<int>")


def full_sets(texts: DataFrame, rules: NearDupRules) -> DataFrame:
    """(node, shingles, bits) of (node, cid, t) rows whose text has the set that cid names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo = WordHashes()
        for batch in batches:
            nodes, sets, bits = [], [], []
            for node, cid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                s = shingle_set(t.as_py(), memo, rules.shingle_words)
                if xxhash.xxh128_digest(s.tobytes()) == cid:
                    nodes.append(node)
                    sets.append(_signed(s))
                    bits.append(bitmap(s, rules.bits))
                if len(memo) > rules.memo_words:
                    memo.clear()
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (sets, bits))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *lists], ["node", "shingles", "bits"])

    return texts.select("node", "cid", "t").mapInArrow(run, "node long, shingles array<long>, bits array<long>").dropDuplicates(["node"])


def prefixed(classes: DataFrame, rules: NearDupRules) -> DataFrame:
    """classes that can have a partner, with ks (postings of the prefix, rarest first), mask (their coordinates as bits) and reach (how widely the values are shared)."""
    posted = classes.select("node", F.posexplode("sig").alias("i", "v")).select("node", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v")).alias("k"))
    shared = posted.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    entries = posted.join(shared, "k").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("e")).filter(F.size("e") >= rules.min_matches)
    # Values held once take the first places of the prefix and meet nobody; the last min_matches - 1 places are skipped.
    prefix = F.transform(F.slice("e", F.lit(1), F.size("e") - (rules.min_matches - 1)), lambda x: x["k"])
    reach = F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(k + F.lit(2**31), 32).cast("int"))
    found = entries.select("node", reach.alias("reach"), prefix.alias("ks"))
    return found.withColumn("mask", F.aggregate("ks", F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(bit(k)))).join(classes, "node")


def hub_pairs(entries: DataFrame, rules: NearDupRules) -> DataFrame:
    """Distinct (node, hub, hub_reach): classes with the hub of each of their postings, if sizes allow a link and collisions suffice."""
    posted = entries.select(F.explode("ks").alias("k"), "node", "reach", F.struct("node", "n_shingles", "sig").alias("x"))
    hubs = posted.groupBy("k").agg(F.max_by(F.struct("x", "reach"), F.struct("reach", "node")).alias("h"))
    collisions = F.aggregate(F.zip_with("x.sig", "h.x.sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    n, m = F.col("x.n_shingles"), F.col("h.x.n_shingles")
    fits = (F.col("node") != F.col("h.x.node")) & (100 * F.least(n, m) >= rules.percent * F.greatest(n, m)) & (collisions >= rules.min_matches)
    return posted.join(hubs, "k").filter(fits).select("node", F.col("h.x.node").alias("hub"), F.col("h.reach").alias("hub_reach")).distinct()


def compared(pairs: DataFrame, sets: DataFrame, rules: NearDupRules) -> DataFrame:
    """Pairs (node, hub, ...) with rest (node's shingles outside the hub's), gone (the hub's outside node's), common (size of the intersection) and linked."""
    both = pairs.join(sets.select("node", F.col("shingles").alias("_x")), "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("_y")), "hub")
    both = both.withColumn("rest", F.array_except("_x", "_y")).withColumn("gone", F.array_except("_y", "_x")).withColumn("common", F.size("_x") - F.size("rest"))
    linked = 100 * F.col("common") >= rules.percent * (F.size("_x") + F.size("_y") - F.col("common"))
    return both.withColumn("linked", linked).drop("_x", "_y")


def known_parts(links: DataFrame) -> DataFrame:
    """(node, part): classes with equal parts are joined by links (node, hub); joined ones may still differ."""
    low = links.groupBy("hub").agg(F.min("node").alias("m")).select("hub", F.least("hub", "m").alias("part"))
    return links.join(low, "hub").select("node", "part").unionByName(low.withColumnRenamed("hub", "node")).groupBy("node").agg(F.min("part").alias("part"))


def tiles(entries: DataFrame, tested: DataFrame, sets: DataFrame, rules: NearDupRules) -> DataFrame:
    """Classes of postings that hold several parts, copied to each pair (a, b) of tiles that they belong to; slot groups tiles for tasks."""
    own = tested.groupBy("node").agg(F.max_by(F.struct("hub", "common", "rest", "gone"), F.struct("hub_reach", "hub")).alias("h"))
    info = entries.join(known_parts(tested.filter("linked")), "node", "left").join(own, "node", "left").join(sets.select("node", "bits"), "node")
    none = F.array().cast("array<bigint>")
    info = checkpointed(
        info.select(
            "node", "ks", "mask", "sig", "bits", F.col("n_shingles").alias("n"), F.coalesce("part", "node").alias("part"),
            F.coalesce("h.hub", "node").alias("hub"), F.coalesce("h.common", "n_shingles").alias("inside"), F.coalesce("h.rest", none).alias("rest"), F.coalesce("h.gone", none).alias("gone"),
        )
    )
    size = info.select(F.explode("ks").alias("k"), "part", (F.size("rest") + F.size("gone") + F.size("bits")).alias("r")).groupBy("k").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m"), F.sum("r").alias("r"))
    cut = F.greatest(F.ceil(F.col("m") / rules.tile_rows), F.ceil(8 * F.col("r") / rules.tile_bytes), F.lit(1))
    mixed = checkpointed(size.filter("lo < hi").select("k", cut.alias("cut"), "m"))
    rows = mixed.agg(F.sum(F.col("m") * F.col("cut"))).first()[0] or 0
    mine = F.pmod(F.xxhash64("node"), "cut")
    held = info.withColumn("k", F.explode("ks")).drop("ks").join(mixed, "k").withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    held = held.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))
    slot = F.pmod(F.xxhash64("k", "a", "b"), F.lit(max(1, rows // rules.tile_rows)))
    return held.select(slot.alias("slot"), "k", "a", "b", "tile", "node", "part", "n", "mask", "sig", "bits", "hub", "inside", "rest", "gone")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and starts (one more than rows) of a list column."""
    array = column.combine_chunks()
    array = array if isinstance(array, pa.ListArray) else array.chunk(0)
    ends = array.offsets.to_numpy()
    return array.values.to_numpy(zero_copy_only=False), ends


def tile_pairs(rows: pa.Table, rules: NearDupRules) -> pa.Table:
    """Pairs (node, hub, sure) of the tiles of one slot: links, as a spanning forest of each tile, and pairs that are still to be confirmed."""
    rows = rows.sort_by([("k", "ascending"), ("a", "ascending"), ("b", "ascending"), ("tile", "ascending"), ("node", "ascending")])
    col = {c: rows.column(c).to_numpy() for c in ("k", "a", "b", "tile", "node", "part", "n", "mask", "hub", "inside")}
    sig = _lists(rows.column("sig"))[0].reshape(rows.num_rows, -1)
    rest, gone, bits = (_lists(rows.column(c)) for c in ("rest", "gone", "bits"))
    n_rest, n_gone = np.diff(rest[1]), np.diff(gone[1])
    key = np.stack([col["k"], col["a"], col["b"]])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    found: list[tuple[int, int, bool]] = []
    for at, to in zip([0, *cuts], [*cuts, rows.num_rows]):
        if col["part"][at:to].min() == col["part"][at:to].max():
            continue
        alone = col["a"][at] == col["b"][at]
        middle = to if alone else at + int(np.searchsorted(col["tile"][at:to], col["b"][at]))
        coordinate = np.uint64((int(col["k"][at]) + 2**31) >> 32)
        xs, ys = np.arange(at, middle), np.arange(at if alone else middle, to)
        root: dict[int, int] = {}

        def find(p: int, root: dict[int, int] = root) -> int:
            while (up := root.get(p, p)) != p:
                root[p] = root.get(up, up)
                p = up
            return p

        open_pairs = []
        for i in range(0, len(xs), 128):
            x = xs[i : i + 128]
            ok = col["part"][x][:, None] != col["part"][ys]
            if alone:
                ok &= x[:, None] < ys
            nx, ny = col["n"][x][:, None], col["n"][ys]
            ok &= 100 * np.minimum(nx, ny) >= rules.percent * np.maximum(nx, ny)
            collisions = np.zeros(ok.shape, np.uint8)
            for c in range(sig.shape[1]):
                collisions += sig[x, c][:, None] == sig[ys, c]
            ok &= collisions >= rules.min_matches
            u, v = np.nonzero(ok)
            u, v = x[u], ys[v]
            # Met here only: the first coordinate that both prefixes post under one value.
            both = (sig[u] == sig[v]) & ((col["mask"][u] & col["mask"][v])[:, None] >> np.arange(sig.shape[1]) & 1).astype(bool)
            mine = both.argmax(axis=1) == coordinate
            u, v = u[mine], v[mine]
            least = -(-rules.percent * (col["n"][u] + col["n"][v]) // (100 + rules.percent))
            same = col["hub"][u] == col["hub"][v]
            p, q = u[~same], v[~same]
            may = least[~same] <= _most_shared(*bits, col["n"], p, q)
            open_pairs += zip(p[may].tolist(), q[may].tolist())
            u, v = u[same], v[same]
            # All of the hub's set that neither lacks, and what both have outside it.
            need = least[same] - (col["inside"][u] - n_gone[v])
            fits = need <= np.minimum(n_gone[u], n_gone[v]) + np.minimum(n_rest[u], n_rest[v])
            u, v, need = u[fits], v[fits], need[fits]
            if len(u):
                linked = _shared(*gone, u, v) + _shared(*rest, u, v) >= need
                for p, q in zip(u[linked].tolist(), v[linked].tolist()):
                    r, s = find(int(col["part"][p])), find(int(col["part"][q]))
                    if r != s:
                        root[max(r, s)] = min(r, s)
                        found.append((p, q, True))
        found += [(p, q, False) for p, q in open_pairs if find(int(col["part"][p])) != find(int(col["part"][q]))]
    p, q = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
    return pa.table({"node": pa.array(col["node"][p]), "hub": pa.array(col["node"][q]), "sure": pa.array([x[2] for x in found], pa.bool_())})


def _most_shared(values: np.ndarray, ends: np.ndarray, n: np.ndarray, u: np.ndarray, v: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """For each pair of rows, how many values their sets of n values can share at most, by their bitmaps."""
    out, words, width = np.zeros(len(u), np.int64), values.view(np.uint64), np.diff(ends)
    for wide in np.unique(np.stack([width[u], width[v]]), axis=1).T.tolist() if len(u) else ():
        at, low = np.flatnonzero((width[u] == wide[0]) & (width[v] == wide[1])), min(wide)
        step = max(1, block // max(wide))
        for i in range(0, len(at), step):
            pairs = at[i : i + step]
            x, y = (np.bitwise_or.reduce(words[ends[r][:, None] + np.arange(w)].reshape(len(r), -1, low), axis=1) for r, w in zip((u[pairs], v[pairs]), wide))
            lacks = (np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64) for a, b in ((x, y), (y, x)))
            out[pairs] = np.minimum(*(n[r] - k for r, k in zip((u[pairs], v[pairs]), lacks)))
    return out


def _shared(values: np.ndarray, ends: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each pair of rows, how many values their lists share; u is ascending, values of a list are distinct."""
    rows = np.unique(np.concatenate([u, v]))
    spans = [values[ends[r] : ends[r + 1]] for r in rows]
    starts = np.cumsum([0, *map(len, spans)])
    number, width = np.unique(np.concatenate(spans), return_inverse=True)[1], 0
    width = int(number.max()) + 1 if len(number) else 0
    mark, out = np.zeros(width, bool), np.zeros(len(u), np.int64)
    place_u, place_v = np.searchsorted(rows, u), np.searchsorted(rows, v)
    for at, to in zip(*(lambda c: ([0, *c], [*c, len(u)]))(np.flatnonzero(np.diff(u)) + 1)):
        own = number[starts[place_u[at]] : starts[place_u[at] + 1]]
        mark[own] = True
        hits = np.concatenate([[0], np.cumsum(mark[number])]) if to - at > 32 else None
        for i in range(at, to):
            s, e = starts[place_v[i]], starts[place_v[i] + 1]
            out[i] = hits[e] - hits[s] if hits is not None else np.count_nonzero(mark[number[s:e]])
        mark[own] = False
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, rules: NearDupRules = NearDupRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: id, text_hash (xxhash64), part (number of its component, null for an empty set), n_shingles, component_id (smallest id linked with it, itself included), kept."""
    prepare(spark)
    rows = checkpointed(signatures(docs, rules, text, key))
    named = rows.filter("cid IS NOT NULL AND id IS NOT NULL").groupBy("cid").agg(F.min("id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = checkpointed(named.withColumn("node", F.monotonically_increasing_id()))
    entries = checkpointed(prefixed(classes, rules))
    wanted = entries.select(F.col("first_id").alias("_id"), "node", "cid")
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("t")).join(wanted, "_id")
    sets = checkpointed(full_sets(texts, rules))
    tested = checkpointed(compared(hub_pairs(entries, rules), sets, rules))
    slots = tiles(entries, tested, sets, rules)
    met = checkpointed(slots.groupBy("slot").applyInArrow(lambda t: tile_pairs(t, rules), "node long, hub long, sure boolean"))
    confirmed = compared(met.filter("NOT sure").select("node", "hub"), sets, rules).filter("linked")
    links = reduce(DataFrame.unionByName, (df.select("node", "hub") for df in (tested.filter("linked"), met.filter("sure"), confirmed)))
    parts = connected_components(links, "node", "hub").select("node", "component")
    first = parts.join(classes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    moved = parts.join(first, "component").join(classes.select("node", "cid"), "node").select("cid", "component", "component_id")
    out = rows.select("id", "text_hash", "n_shingles", "cid").join(classes.select("cid", "first_id", "node"), "cid", "left").join(moved, "cid", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "first_id", "id"))
    return out.select(F.col("id").alias(key), "text_hash", F.coalesce("component", "node").alias("part"), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("text_hash", "part")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT n.doc_id, n_shingles, min(r) AS component_id, min(r) = n.doc_id AS kept FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n_shingles
"""
