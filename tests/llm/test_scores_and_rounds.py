"""Scores from all marginals, and the pattern graph against a plain reckoning of its rounds."""

from collections import defaultdict

import numpy as np
import pytest

from lumenkg.llm import pii, toxicity


def test_figures_cover_every_token():
    p = np.array([0.1, 0.2, 0.6])
    total, top = toxicity.document_figures(np.stack([1 - p, p], axis=1))
    assert total == pytest.approx(np.log1p(0.9)) and top == pytest.approx(0.6)
    assert toxicity.document_figures(np.zeros((0, 2))) == (0.0, 0.0)


def test_logistic_orders_and_drops_negative_slopes():
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    y = (x[:, 0] + 0.1 * rng.standard_normal(400) > 0.5).astype(int)
    slopes, bias = toxicity._logistic(x, y)
    assert slopes[0] > 5 and slopes[1] >= 0
    score = x @ np.array(slopes) + bias
    assert score[y == 1].mean() > score[y == 0].mean()
    flipped, _ = toxicity._logistic(np.stack([x[:, 0], -x[:, 0]], axis=1), y)
    assert min(flipped) >= 0
    none, bias = toxicity._logistic(-x[:, :1], y)
    assert none == (0.0,) and bias == pytest.approx(np.log(y.mean() / (1 - y.mean())), abs=1e-3)


def plain_patterns(texts, rules):
    """The same graph with dictionaries: rounds until the trusted set repeats."""
    seeds, near, kinds = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        base = pii.base_spans(t)
        sure, unsure = pii.tokens(t, base, rules)
        strong = [("secret", *x) for x in sure]
        loose = pii.loose_spans(t, base + strong)
        loose += [(["secret"], *x) for x in pii._apart(unsure, loose)]
        around = pii.Contexts(t)
        for ks, s, e, seed in [([k], s, e, True) for k, s, e in base + strong] + [(*x, False) for x in loose]:
            for k in ks:
                for p in around.of(s, e):
                    near[p, k].add(t[s:e].lower())
                    kinds[p].add(t[s:e].lower())
                    if seed:
                        seeds[p, k].add(t[s:e].lower())
    plain = defaultdict(int)
    for t in texts:
        words = pii.DIGIT.sub("0", t.lower()).split()
        ordinary = [not ("@" in w or "0" in w) for w in words]
        for i, w in enumerate(words):
            if i + 1 < len(words) and ordinary[i + 1]:
                plain[w] += 1
                if i:
                    plain[f"{words[i - 1]} {w}"] += 1
            if i and ordinary[i - 1]:
                plain[f" {w}"] += 1
    wide = {x for x, v in near.items() if len(v) >= rules.min_seeds}
    score, trusted = {(k, v): 1.0 for (p, k), vs in seeds.items() for v in vs if (p, k) in wide}, None
    fixed = {(p, k): vs for (p, k), vs in seeds.items()}
    while True:
        now = {}
        for p, k in wide:
            own = [1.0 if v in fixed.get((p, k), ()) else score.get((k, v), 0.0) if trusted is not None else 0.0 for v in near[p, k]]
            c = sum(own) / (len(kinds[p]) + plain[p])
            if c >= rules.min_confidence and sum(x > 0 for x in own) >= rules.min_seeds:
                now[p, k] = c
        if not now or now.keys() == trusted:
            return now
        trusted, score = now.keys(), {}
        for (p, k), c in now.items():
            for v in near[p, k]:
                score[k, v] = max(score.get((k, v), 0.0), c)


TEXTS = (
    [f"please write to: user{i}@example.org today" for i in range(6)]
    + [f"please write to: person{i} (at) example.org today" for i in range(3)]
    + [f"call me under +49 30 12345{i}0 soon" for i in range(5)]
    + [f"call me under 030 98765{i}1 soon" for i in range(4)]
    + ["nothing to see here", "", "they went under water and under stones", "version 1.2.3.4 of the tool", "call me under pressure"]
)


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_pattern_graph_against_plain_rounds(spark, least):
    rules = pii.PiiRules(min_confidence=least)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = pii.mentions(docs, rules=rules)
    got = {(r.pattern, r.kind): round(r.confidence, 9) for r in pii.learned_patterns(spark, docs, found, rules).collect()}
    want = plain_patterns(TEXTS, rules)
    assert got == {x: round(c, 9) for x, c in want.items()} and got


def test_unsettled_rounds_are_an_error(spark):
    rules = pii.PiiRules(max_rounds=1, min_confidence=0.3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    with pytest.raises(RuntimeError):
        pii.learned_patterns(spark, docs, pii.mentions(docs, rules=rules), rules)
