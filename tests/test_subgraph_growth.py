"""What retrieval of subgraphs makes of many texts about the same hubs: the same rows as a plain count, without a row for every text and edge."""

import itertools
import random

import pytest

from lumenkg.operators import subgraph as S


def shuffled_rows(spark, work, broadcast="-1"):
    """What work() returns, and the rows that its stages wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)  # -1: as where no side is small
    try:
        return work(), written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def hubs(spark):
    """Two hubs with 2,000 neighbours each, 1,500 of them in common; 300 texts about both."""
    ends = "explode(CASE WHEN id < 1500 THEN array('hub1', 'hub2') WHEN id < 2000 THEN array('hub1') ELSE array('hub2') END)"
    edges = spark.range(2500).selectExpr("concat('n', id) AS subject", "IF(id % 3 = 0, 'part_of', 'related_with') AS relation", f"{ends} AS object", "IF(id % 2 = 0, 'told', 'said') AS description")
    seeds = spark.range(300).selectExpr("id AS qid", "explode(array('hub1', 'hub2')) AS node", "4 AS matched")
    pool = seeds.select("qid", "node").unionByName(spark.range(300).selectExpr("id AS qid", "concat('n', id) AS node"))
    texts = spark.range(300).selectExpr("id AS qid", "concat('about HUB1: ', IF(id % 5 = 0, 'told n', 'n'), id * 9) AS text")
    importance = spark.range(2500).selectExpr("concat('n', id) AS node", "(id % 40) / 400.0D AS importance")
    inputs = {"edges": edges, "seeds": seeds, "pool": pool, "texts": texts, "importance": importance}
    return {k: v.localCheckpoint() for k, v in inputs.items()}


def plainly(hubs, both, floor, limit):
    """{text: its edges (subject, relation, object, score) in order} from a walk over all edges at every seed."""
    importance = dict(hubs["importance"].collect())
    edges, pool, out = hubs["edges"].collect(), {(r.qid, r.node) for r in hubs["pool"].collect()}, {}
    at = {}
    for e in edges:
        at.setdefault(e.subject, set()).add(e.object)
    for qid, text in hubs["texts"].collect():
        clean, rows = "".join(c for c in text.lower() if c.isalnum()), []
        for e in edges:
            inside = (qid, e.subject) in pool
            if both and not inside and (floor is not None or len(at[e.subject]) < 2):
                continue
            score = S.RELATION_WEIGHTS[e.relation] + 3 + 10 * importance[e.subject] + 4 * (e.subject in clean) + 4 * (e.object in clean) + 2 * (e.description in clean)
            if floor is None or round(score, 6) >= floor:
                rows.append((-round(score, 6), e.subject, e.relation, e.object))
        out[qid] = sorted(rows)[:limit]
    return out


def check(spark, hubs, both, floor, limit, most):
    got, rows = shuffled_rows(spark, lambda: S.retrieve_subgraphs(**hubs, both_in_pool=both, min_score=floor, limit=limit).collect())
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.qid, []).append((-r.score, r.subject, r.relation, r.object))
    assert found == {q: [(pytest.approx(x[0]), *x[1:]) for x in v] for q, v in plainly(hubs, both, floor, limit).items() if v}
    assert rows < most, rows


def test_best_beside_hubs(spark, hubs):
    check(spark, hubs, False, 8.0, 7, 200_000)  # 300 texts x 4,000 edges are 1,200,000


def test_pool_beside_hubs(spark, hubs):
    check(spark, hubs, True, 4.0, 60, 60_000)


def test_bridges_between_hubs(spark, hubs):
    check(spark, hubs, True, None, 7, 600_000)


@pytest.mark.parametrize("hub,limit", [(0, 3), (1, 2), (2, 5), (3, 1)])
def test_hubs_of_any_size_choose_alike(spark, monkeypatch, hub, limit):
    rng = random.Random(f"{hub}{limit}")
    nodes = [f"n{i}" for i in range(14)]
    edges = spark.createDataFrame([(*e, rng.choice(["", "n3 and", "told"])) for e in rng.sample(list(itertools.product(nodes, ["part_of", "related_with", "x"], nodes)), 130)], "subject string, relation string, object string, description string")
    rows = [(q, n) for q in range(25) for n in rng.sample(nodes, 4)]
    seeds = spark.createDataFrame([(q, n, rng.randint(1, 2)) for q, n in rows], "qid long, node string, matched int")
    pool = spark.createDataFrame(rows + [(q, rng.choice(nodes)) for q in range(25)], "qid long, node string")
    texts = spark.createDataFrame([(q, " ".join(["told"] * rng.randint(0, 1) + rng.sample(nodes, 2))) for q in range(25)], "qid long, text string")
    importance = spark.createDataFrame([(n, rng.randint(0, 3) / 7) for n in nodes[2:]], "node string, importance double")
    inputs = {"edges": edges, "seeds": seeds, "pool": pool, "texts": texts, "importance": importance, "most_seeds": 3}
    every = S.retrieve_subgraphs(**inputs)  # no limit: all edges are scored
    monkeypatch.setattr(S.best_bridges, "__defaults__", (hub,))
    assert sorted(S.retrieve_subgraphs(**inputs, limit=limit).collect()) == sorted(every.filter(every["rank"] <= limit).collect())
