"""The random fields: exact marginals, held-out accuracy, defined results for odd rows."""

import itertools
import random

import numpy as np

from lumenkg.llm.crf import Crf, FeatureRules
from lumenkg.llm.langid import LanguageRules, fit_languages, predict_languages, training_sample
from lumenkg.llm.toxicity import ToxicityRules, fit_toxicity, score_toxicity
from lumenkg.llm.toxicity import training_sample as toxic_sample


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    k = 3
    model = Crf(list("abc"), FeatureRules(), np.zeros((4, k)), np.empty(0, np.uint64), np.empty(0, int), np.zeros((k + 1, k)), rng.normal(size=(k, k)).astype(np.float32), rng.normal(size=k).astype(np.float32))
    sequences = [rng.normal(size=(n, k)).astype(np.float32) for n in (4, 0, 1, 6, 4)]
    for e, got in zip(sequences, model.marginals(sequences)):
        want = np.zeros((len(e), k))
        for path in itertools.product(range(k), repeat=len(e)):
            s = sum(e[t, y] for t, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])) + (model.start[path[0]] if path else 0)
            for t, y in enumerate(path):
                want[t, y] += np.exp(s)
        if len(e):
            want /= want.sum(axis=1, keepdims=True)
        assert got.shape == (len(e), k) and np.allclose(got, want, atol=1e-4)


def language_rows(n=120):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "tion", "sh", "and"], "fr": ["eux", "ré", "çon", "elle", "oi"], "de": ["sch", "keit", "ung", "ver", "ß"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = [word(lang if rng.random() < 0.9 else rng.choice(list(parts))) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words) + ".", lang))
    return rows


def test_language_of_held_out_and_odd_texts(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(training_sample(docs.filter("doc_id < 80"), LanguageRules(), "text", "lang", "doc_id"))
    got = {r.doc_id: r for r in predict_languages(spark, docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if i >= 80) >= 39
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 34 --", 1), (3, "the tion", 1), (None, "eux", 1)], "doc_id long, text string, score int")
    out = predict_languages(spark, odd, model).collect()
    assert [r.lang_pred for r in out][:3] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out) and len(out) == 5
    none = training_sample(docs.filter("false"), LanguageRules(), "text", "lang", "doc_id")
    assert none == [] and {r.lang_pred for r in predict_languages(spark, docs, fit_languages(none)).collect()} == {"und"}
    assert predict_languages(spark, docs.limit(0), model).count() == 0


def toxic_rows(n=400):
    rng = random.Random(6)
    clean = ["".join(rng.choice("aeiou") + rng.choice("bcdfgl") for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(8, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), "vexqu" + rng.choice(clean))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxic_spans_scores_and_odd_texts(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 250] + [(None, 1), (999, None)], "doc_id long, toxic int")
    rules = ToxicityRules()
    model = fit_toxicity(toxic_sample(docs, labels, rules), rules)
    got = {r.doc_id: r for r in score_toxicity(spark, docs, model, rules).collect()}
    held = [r for r in rows if r[0] >= 250]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    i, t, _ = next(r for r in held if r[2])
    assert got[i].n_spans >= 2 and all(t[s.start : s.end].startswith("vexqu") for s in got[i].spans)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "vexquab"), (None, "ab " * 3000)], "doc_id long, text string")
    out = score_toxicity(spark, odd, model, rules).collect()
    assert len(out) == 4 and out[0].score == out[1].score and all(0 <= r.score <= 1 for r in out)
    assert score_toxicity(spark, docs.limit(0), model, rules).count() == 0
    empty = fit_toxicity(toxic_sample(docs, labels.limit(0), rules), rules)
    assert score_toxicity(spark, docs, empty, rules).filter("predicted = 1").count() == 0
