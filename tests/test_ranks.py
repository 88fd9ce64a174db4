"""PageRank to a tolerance against a plain power iteration."""

import numpy as np
import pytest

from lumenkg.operators import graph as G

EDGE = "subject string, object string, weight double"


def plain_ranks(edges, p, alpha=0.85):
    nodes = sorted({x for e in edges for x in e[:2]})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, o, w in edges:
        m[at[o], at[s]] += w
    total = m.sum(axis=0)
    m[:, total > 0] /= total[total > 0]
    jump = np.array([p.get(n, 0.0) for n in nodes]) if p else np.full(len(nodes), 1 / len(nodes))
    r = jump.copy()
    for _ in range(400):
        x = m @ r
        r = alpha * (x + (1 - x.sum()) * jump) + (1 - alpha) * jump
    return dict(zip(nodes, r))


@pytest.mark.parametrize("p", [None, {"n1": 0.75, "n4": 0.25}])
def test_ranks_to_a_tolerance(spark, p):
    rng = np.random.default_rng(5)
    edges = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 9, 16), rng.integers(0, 12, 16), rng.integers(1, 4, 16))] + [("n1", "n2", 1.0), ("n4", "n1", 2.0)]
    seeds = None if p is None else spark.createDataFrame(list(p.items()), "node string, p double")
    got = {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, EDGE), 60, seeds=seeds, tolerance=1e-3).collect()}
    want = plain_ranks(edges, p)
    assert got.keys() == want.keys()
    assert sum(abs(got[n] - want[n]) for n in want) < 1e-3 * 0.85 / 0.15  # what a step below the tolerance leaves open


def test_ranks_that_do_not_settle_are_an_error(spark):
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], EDGE)
    with pytest.raises(RuntimeError, match="still move"):
        G.pagerank(ring, 2, tolerance=1e-9)
    assert G.pagerank(ring.limit(0), 3, tolerance=1e-9).count() == 0
