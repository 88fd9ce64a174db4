"""The same results with blocks, tiles and leaves so small that every path is taken."""

import random

import numpy as np

from lumenkg.llm.ann import TreeRules, search
from lumenkg.llm.neardup import NearDupRules, near_duplicates


def test_tiny_leaves_give_every_query_its_neighbours(spark):
    x = np.random.default_rng(8).normal(size=(600, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rules = TreeRules(leaf_rows=4, first_rows=5, block_rows=16, block_queries=3, target_recall=0.5, calibration_queries=5)
    found = {}
    for r in search(spark, rows, lambda i: i % 20 == 0, rules).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == set(range(0, 600, 20))
    assert all([k for k, _ in sorted(v)] == list(range(1, 21)) and len({i for _, i in v}) == 20 for v in found.values())


def test_tiles_of_a_few_rows_find_the_same_groups(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(70):  # variants of one text that is not there, many of them near each other and many not
        own = list(base)
        for _ in range(rng.randrange(2, 7)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide, narrow = ({r.doc_id: r.component_id for r in near_duplicates(spark, docs, rules).collect()} for rules in (NearDupRules(), NearDupRules(tile_rows=5, tile_bytes=2_000)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    plain = {i: min([j for j in sets if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]) for i in sets}
    for _ in sets:
        near = {i: min(plain[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in sets}
        plain = {i: min(plain[i], near[i]) for i in sets}
    assert wide == narrow == plain and 1 < len(set(plain.values())) < 70
