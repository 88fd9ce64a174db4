"""Queries over the whole table: nothing is left out, and those without SQL equal brute force."""

import random
from itertools import permutations

import pytest

from lumenkg import registry
from lumenkg.operators import graph as G


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Order lines of many lectures; parts 1-4, 5-9 and 10-12 hang together, with a star and a triangle-free path among them."""
    rng, pairs = random.Random(4), [(1, 1), (1, 2), (2, 2), (2, 3), (5, 5), (5, 6), (5, 7), (5, 8), (10, 10), (11, 10), (11, 11), (20, 21)]
    rows = [(39 + 40 * i + i % 7, 1, s, p, rng.choice("ANR"), rng.choice("OF"), float(rng.randrange(1, 50))) for i, (s, p) in enumerate(pairs)]
    path = tmp_path_factory.mktemp("whole")
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")
    return str(path), {(f"S{s}", f"P{p}") for s, p in pairs}


def parts(edges):
    of = {n: {n} for e in edges for n in e}
    for a, b in edges:
        both = of[a] | of[b]
        for n in both:
            of[n] = both
    return of


def has_path(edges, nodes):
    both = edges | {(b, a) for a, b in edges}
    return any({(a, b), (b, c), (c, d)} <= both for a, b, c, d in permutations(nodes, 4))


def test_components_of_all_triplets(spark, lines):
    path, edges = lines
    got = {r.node: r.component for r in registry.queries()["g5_components_all"](spark, path).collect()}
    assert got == {n: min(c) for n, c in parts(edges).items()}


def test_long_components_of_all_triplets(spark, lines):
    path, edges = lines
    of = parts(edges)
    got = {tuple(r) for r in registry.queries()["g6_long_components_all"](spark, path).select("subject", "object").collect()}
    assert got == {e for e in edges if has_path(edges, of[e[0]])} and 0 < len(got) < len(edges)


def test_long_components_of_small_graphs(spark):
    rng = random.Random(5)
    for n in range(6):
        edges = {(a, b) for a, b in ((rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH")) for _ in range(3 + n)) if a != b} | {("X", "Y"), ("Y", "Z"), ("Z", "X")}
        of = parts(edges)
        got = {tuple(r) for r in G.long_components(spark.createDataFrame(sorted(edges), "subject string, object string")).collect()}
        assert got == {e for e in edges if has_path(edges, of[e[0]])}


def test_no_lecture_is_left_out(spark, lines):
    path, edges = lines
    ends = {n for e in edges for n in e}
    assert {r.node for r in registry.queries()["g4_pagerank_all"](spark, path).collect()} == ends
    assert registry.queries()["s13_graphml_all"](spark, path).count() == len(edges)
    assert {r.node for r in registry.queries()["g11_core_numbers"](spark, path).collect()} == ends


def peeled(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        a = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[a]))
        core[a] = k
        for b in near.pop(a):
            near[b].discard(a)
    return core


def test_core_numbers_have_no_cap(spark):
    rng = random.Random(8)
    clique = {(f"c{i}", f"c{j}") for i in range(14) for j in range(i)}
    chain = {(f"p{i}", f"p{i + 1}") for i in range(12)} | {("p12", "c0"), ("c1", "c1")}
    rest = {(f"r{rng.randrange(30)}", f"r{rng.randrange(30)}") for _ in range(120)}
    edges = clique | chain | rest
    got = {r.node: r.core for r in G.core_numbers(spark.createDataFrame(sorted(edges), "subject string, object string")).collect()}
    assert got == peeled(edges) and got["c5"] == 13 and got["p6"] == 1


def test_fusion_of_pagerank_and_cores(spark):
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("x", 0.1)], "node string, rank double")
    cores = spark.createDataFrame([("a", 2), ("b", 4)], "node string, core int")
    got = {r.node: (round(r.final, 6), r.k_core) for r in G.fuse_with_cores(ranks, cores).collect()}
    assert got == {"a": (0.85, 2.0), "b": (0.65, 4.0), "x": (0.14, 0.0)}
