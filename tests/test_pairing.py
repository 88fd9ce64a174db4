"""Choices in rounds against choices in turn, subsumed names, and grounded evidence against a plain search."""

import random

import pytest

from lumenkg.operators import pairing as P
from lumenkg.operators.grounding import ground, grounded


def in_turn(scores, enough):
    ranked = {}
    for v, lecture, s in scores:
        ranked.setdefault(v, []).append((-s, lecture))
    taken, out = set(), {}
    for best, v in sorted(((-min(r)[0], v) for v, r in ranked.items()), reverse=True):
        order = sorted(ranked[v])
        free = [x for i, (s, x) in enumerate(order) if x not in taken and (i == 0 or -s >= enough)]
        out[v] = (free[0] if free else order[0][1], bool(free))
        taken.update(free[:1])
    return out


@pytest.mark.parametrize("seed,enough", [(1, 0), (2, 5), (3, 8)])
def test_lectures_in_rounds(spark, seed, enough):
    rng = random.Random(seed)
    scores = [(v, x, rng.randrange(1, 12)) for v in range(40) for x in range(30) if rng.random() < 0.3]
    got = P.chosen_lectures(spark.createDataFrame(scores, "video int, lecture int, score int"), enough).collect()
    assert {r.video: (r.lecture, r.held) for r in got} == in_turn(scores, enough)


def test_confidence(spark):
    scores = [(1, 1, 200), (1, 2, 100), (2, 1, 150), (2, 3, 90), (3, 4, 7), (4, 1, 85), (4, 2, 70)]
    got = {r.video: (r.lecture, r.held, r.score, r.runner_up, r.margin, r.confidence) for r in P.lecture_matches(spark.createDataFrame(scores, "video int, lecture int, score int")).collect()}
    assert got == {1: (1, True, 200, 2, 2.0, "high"), 2: (3, True, 90, 1, 0.6, "low"), 3: (4, True, 7, None, 7.0, "low"), 4: (1, False, 85, 2, 1.21, "medium")}


@pytest.mark.parametrize("seed", [1, 2])
def test_absorbed_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, rng.choice([0.5, 0.6, 0.7, 0.9])) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2]
    taken, want = set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in taken and b not in taken:
            taken.add(b)
            want.add((a, b, -s))
    assert {tuple(r) for r in P.absorbed_pairs(spark.createDataFrame(pairs, "a int, b int, similarity double")).collect()} == want


def test_cards(spark):
    cards = spark.createDataFrame([(1, "一元谓词公式", "用到 算法 与 集合"), (2, "x", "算法"), (3, "算法 图", "")], "card int, name string, text string")
    entities = spark.createDataFrame([(z, z) for z in ["谓词", "一元谓词", "算法", "集合", "公式", "图"]], "entity string, zh string")
    got = {(r.card, r.entity, round(r.score, 3), r.place) for r in P.relinked_cards(cards, entities).collect()}
    assert got == {(1, "一元谓词", 0.85, 1), (1, "公式", 0.85, 2), (3, "算法", 0.85, 1)}


def test_grounding(spark):
    source = "首先 我们\n讲一元谓词 的定义,它 是 一个性质。then the second  part follows here and ends"
    cases = {
        "讲一元谓词": "讲一元谓词", "我们讲一元谓词的定义": "我们\n讲一元谓词 的定义", "x the second part fxllows": "the second  part f", "": None, "nothing like it": None,
    }
    for quote, want in cases.items():
        span = ground(quote, source)
        assert (span and source[span[0] : span[1]]) == want, quote
    start, end, how = ground("谓词定义性质", source)
    assert how == "hints" and source[start:end].startswith("们\n讲一元谓词 的定义")
    rng = random.Random(4)
    text = "".join(rng.choice("ab  \nc") for _ in range(3000))
    rows = [(i, text, "".join(rng.choice([c, c, c + " "]) for c in text[j : j + 40].replace("\n", " "))) for i, j in enumerate(rng.sample(range(2900), 60))]
    dense = "".join(text.split())
    for r in grounded(spark.createDataFrame([*rows, (99, None, "a"), (98, "a", None)], "i int, s string, e string"), "e", "s", keep=("i",)).collect():
        if r.i >= 98:
            assert r.start is None and r.how is None
            continue
        wanted = "".join(rows[r.i][2].split())
        assert "".join(text[r.start : r.end].split()) == wanted and not text[r.start].isspace() and not text[r.end - 1].isspace()
        assert len("".join(text[: r.start].split())) == dense.find(wanted) or r.how == "exact"
