"""Searches in tiles equal brute force, and ask every hundredth row."""

import numpy as np

from lumenkg import registry
from lumenkg.operators import retrieval as R


def test_tiles_equal_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(300, 8))
    x[7] = x[8] = x[9]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>")
    asked = rows.filter("doc_id % 10 = 0").selectExpr("doc_id AS qid", "v AS q")
    got = {(r.qid, r["rank"]): r.doc_id for r in R.dense_top_k(rows, asked, 6, tile_rows=40, question_rows=7).collect()}
    want = {(q, i + 1): int(d) for q in range(0, 300, 10) for i, d in enumerate(np.lexsort((np.arange(300), -np.round(x @ x[q], 9)))[:6])}
    assert got == want
    assert R.dense_top_k(rows, asked.limit(0), 6).count() == 0


def test_questions_are_every_hundredth_row(spark):
    got = registry.queries()["k1_vector_topk_all"](spark, "/root/testdata/sf0.001")
    assert {r.qid for r in got.select("qid").distinct().collect()} == {0, 100, 200, 300, 400}
