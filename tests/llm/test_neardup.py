"""Near-duplicate groups against all pairs of exact sets."""

import math
import random

import numpy as np
import pyarrow as pa

from lumenkg.llm import neardup
from lumenkg.llm.neardup import NearDupRules, WordHashes, near_duplicates, shingle_set


def brute(rows):
    memo = WordHashes()
    sets = [(i, set(shingle_set((t or "").encode(), memo).tolist())) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark, docs).collect() if r.doc_id is not None}
    want = brute(rows)
    assert {i: g[:2] for i, g in got.items()} == want
    assert all(g[2] == (g[1] == i) for i, g in got.items())


def test_groups_chains_and_odd_texts(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "one two three four five"), (8, "ONE two\tthree four five"), (9, "é" * 9), (None, "a b")]
    n = 10
    for size in (1, 2, 5, 60):  # groups of near copies, some of which are too far from their base
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(8):  # each is near its neighbour, the ends are not near each other
        rows.append((n, " ".join(chain)))
        n += 1
        chain = chain[6:] + [rng.choice(vocabulary) for _ in range(6)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(30):  # a shared passage does not link
        rows.append((n, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))))
        n += 1
    rows += [(n, rows[-1][1]), (n + 1, rows[-1][1])]
    check(spark, rows)


def test_empty_table(spark):
    assert near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_misses_are_rare():
    r = NearDupRules()
    missed = sum(math.comb(r.coordinates, i) * 0.75**i * 0.25 ** (r.coordinates - i) for i in range(r.min_matches))
    assert missed < 5e-6


def test_pairs_of_different_hubs():
    """Of two classes with different hubs and enough collisions, only those that may be linked leave their tile."""
    rules, (a, b) = NearDupRules(), neardup._coefficients(32)
    rng = np.random.default_rng(5)
    left = {0.4: 0, 0.8: 0}
    for alike in left:
        for _ in range(40):
            n, m = 200, round(400 * alike / (1 + alike))
            drawn = rng.integers(0, 2**63, 2 * n - m, np.uint64) * np.uint64(2)
            sets = [np.sort(drawn[:n]), np.sort(drawn[n - m :])]
            sig = [neardup.signature(s, a, b).view(np.int32) for s in sets]
            same = np.flatnonzero(sig[0] == sig[1])
            if len(same) < rules.min_matches:
                continue
            k = (int(same[0]) << 32) + int(sig[0][same[0]])
            none = pa.array([[], []], pa.list_(pa.int64()))
            ones = {"k": k, "a": 0, "b": 0, "tile": 0, "n": n, "mask": 2**32 - 1, "inside": n}
            rows = pa.table({c: pa.array([v, v], pa.int64()) for c, v in ones.items()} | {c: pa.array([1, 2], pa.int64()) for c in ("node", "part", "hub")} | {"sig": pa.array(sig, pa.list_(pa.int32())), "rest": none, "gone": none, "bits": pa.array([neardup.bitmap(s) for s in sets], pa.list_(pa.int64()))})
            found = neardup.tile_pairs(rows, rules).to_pylist()
            assert alike < 0.75 or found == [{"node": 1, "hub": 2, "sure": False}]
            left[alike] += len(found)
    assert left == {0.4: 0, 0.8: 40}


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool[:most], rng.integers(1, most), replace=False)) for most in (2, 60, 300, 3000) for _ in range(12)]
    maps = [neardup.bitmap(s) for s in sets]
    u, v = np.triu_indices(len(sets), 1)
    bound = neardup._most_shared(np.concatenate(maps), np.cumsum([0, *map(len, maps)]), np.array([len(s) for s in sets]), u, v)
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(u, v)])
    assert (true <= bound).all() and (bound <= [min(len(sets[a]), len(sets[b])) for a, b in zip(u, v)]).all()
    alike = u // 12 == v // 12
    assert (bound - true)[alike].mean() < 0.2 * np.array([len(sets[a]) for a in u])[alike].mean()
