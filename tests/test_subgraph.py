"""Subgraphs against a plain walk over dictionaries, on random graphs and with every option."""

import itertools
import random
import re

import pytest

from lumenkg.operators import subgraph as S

CLEAN = re.compile("[^一-龥a-z0-9]")


def clean(x):
    return CLEAN.sub("", (x or "").lower())


def plain(edges, seeds, pool, text, importance, aliases, most, both, floor, limit):
    """One text: (subject, relation, object) -> (score, rank)."""
    name = lambda n: aliases.get(n, n)
    best = {}
    for n, m in seeds:
        best[name(n)] = max(best.get(name(n), 0), m)
    own = sorted(best, key=lambda n: (-best[n], -importance.get(n, 0.0), n))[:most]
    pool, text = {name(n) for n in pool}, clean(text)
    beside = [e for e in edges if e[0] in own or e[2] in own]
    landings = {}
    for s, _, o, *_ in beside:
        for mid, end in ((s, o), (o, s)):
            if mid not in own and end in own:
                landings.setdefault(mid, set()).add(end)
    chosen = []
    for s, r, o, about in beside:
        inside = s in pool and o in pool
        bridge = any(len(landings.get(n, ())) > 1 for n in (s, o))
        if both and not inside and not bridge:
            continue
        score = S.RELATION_WEIGHTS.get(r, 1.0) + 3 * ((s in own) + (o in own)) + 10 * (importance.get(s, 0.0) + importance.get(o, 0.0))
        score += 2 * sum(bool(clean(x)) and clean(x) in text for x in (s, o, about))
        score += 2 * sum(any(len(clean(p)) > 1 and clean(p) in text for p in [*n.split("/"), n]) for n in (s, o))
        if floor is not None and (score < floor or both and not inside):
            continue
        chosen.append((-round(score, 6), s, r, o))
    out = {}
    for rank, (score, s, r, o) in enumerate(sorted(chosen)[:limit], 1):
        if name(s) != name(o):
            out.setdefault((name(s), r, name(o)), (-score, rank))
    return out


NAMES = ["图/graph", "树/tree", "graph", "a", "cut set", "边/edge", "点/vertex", "path", "circle/圈", "x9"]


@pytest.mark.parametrize("both,floor,limit", [(True, None, None), (True, 8.0, None), (False, None, 4), (False, 9.0, 3), (True, None, 2)])
def test_against_plain_walk(spark, both, floor, limit):
    rng = random.Random(f"{both}{floor}{limit}")
    relations = ["part_of", "related_with", "depend_on", "other"]
    triples = rng.sample(list(itertools.product(NAMES, relations, NAMES)), 70)
    edges = [(*e, rng.choice(["", None, "a tree", "edge of a graph"])) for e in triples]
    importance = {n: round(rng.random(), 3) for n in NAMES[:7]}
    aliases = {"graph": "图/graph", "x9": "path"}
    asked = {}
    for q in range(12):
        seeds = [(n, rng.randint(1, 3)) for n in rng.choices(NAMES + ["unknown"], k=rng.randint(0, 5))]
        asked[q] = seeds, [n for n, _ in seeds] + rng.sample(NAMES, 2), rng.choice([None, "", "The graph has an EDGE, a tree", "点 and vertex; cut-set x9"])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = S.retrieve_subgraphs(
        frame(edges, "subject string, relation string, object string, description string"),
        frame([(q, n, m) for q, (s, _, _) in asked.items() for n, m in s] + [(None, "a", 1), (3, None, 1)], "qid long, node string, matched int"),
        frame([(q, n) for q, (_, p, _) in asked.items() for n in p] + [(3, None)], "qid long, node string"),
        frame([(q, t) for q, (_, _, t) in asked.items()], "qid long, text string"),
        frame(list(importance.items()), "node string, importance double"),
        frame(list(aliases.items()), "alias string, canonical string"),
        most_seeds=3, both_in_pool=both, min_score=floor, limit=limit,
    ).collect()
    rows = {}
    for r in got:
        assert rows.setdefault(r.qid, {}).setdefault((r.subject, r.relation, r.object), (r.score, r["rank"])) == (r.score, r["rank"])
    assert len(got) == sum(map(len, rows.values()))
    for q, (seeds, pool, text) in asked.items():
        want = plain(edges, seeds, pool, text, importance, aliases, 3, both, floor, limit)
        assert {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == rows.get(q, {}), q


def test_empty_tables_and_hooks(spark):
    edges = spark.createDataFrame([("a", "part_of", "b"), ("b", "part_of", "c")], "subject string, relation string, object string")
    seeds = spark.createDataFrame([(1, "a", 1), (1, "c", 1)], "qid long, node string, matched int")
    pool, texts = seeds.select("qid", "node"), spark.createDataFrame([], "qid long, text string")
    importance = spark.createDataFrame([], "node string, importance double")
    got = S.retrieve_subgraphs(edges, seeds, pool, texts, importance)
    assert {(r.subject, r.object, r.score) for r in got.collect()} == {("a", "b", 6.0), ("b", "c", 6.0)}  # b is a bridge
    assert {(r.node, r.seed) for r in S.subgraph_entities(got, pool).collect()} == {("a", True), ("b", False), ("c", True)}
    assert S.retrieve_subgraphs(edges, seeds, pool, texts, importance, keep=lambda rows: rows.filter("subject = 'a'")).count() == 1
    assert S.retrieve_subgraphs(edges, seeds.limit(0), pool, texts, importance).count() == 0
    assert S.retrieve_subgraphs(edges.limit(0), seeds, pool, texts, importance).count() == 0
