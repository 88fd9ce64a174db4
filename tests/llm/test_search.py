"""Nearest neighbours against a full scan."""

import numpy as np

from lumenkg.llm.ann import TreeRules, search


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    x[300:500] = x[300]  # a large group of equal vectors
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    rows += [(2000, None, 0.0), (2020, [0.0] * 16, 0.0), (2040, [float("nan")] * 16, 0.0), (2060, [1.0], 0.0), (2080, [None] * 16, 0.0), (None, [1.0] * 16, 0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    rules = TreeRules(leaf_rows=60, block_rows=100, block_queries=20, calibration_queries=40)
    out = search(spark, table, lambda i: i % 20 == 0, rules).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, near in found.items():
        assert len(near) == 20 and near == sorted(near, key=lambda p: (-p[1], p[0])) and q not in {i for i, _ in near}
        scores = (x * x[q]).sum(axis=1)
        assert all(abs(scores[i] - s) < 1e-9 for i, s in near)
        scores[q] = -np.inf
        hits += len({i for i, _ in near} & set(np.lexsort((np.arange(1500), -scores))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_few_and_no_rows(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in search(spark, three, lambda i: i % 20 == 0).collect()] == [(1, 1), (2, 2)]
    assert search(spark, three.limit(0), lambda i: i % 20 == 0).count() == 0
