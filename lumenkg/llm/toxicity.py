"""Toxic spans by a linear-chain conditional random field; marginals give scores and offsets.

Labels are given per document, so tokens are labelled first: a word or word beginning
that occurs in labelled toxic documents far more often than their share explains (exact
binomial test) marks its occurrences in toxic documents as toxic tokens; all tokens of
clean documents are clean.  The field learns emissions (affixes and words) and
transitions from windows of such tokens.  At use, forward-backward over each whole text
gives every token's marginal; tokens above span_threshold are offending spans.  The score
is a logistic function, fitted on the labelled sample, of two figures over all marginals:
the expected number of toxic tokens and the largest marginal.

The fit sees a bounded sample of the labelled rows (ToxicityRules) and runs in one task;
scores cover every row and whole texts.

Cases: a null id is held out from nothing and learned from by nothing; null and empty texts have no token and get the score of a document without spans;
without toxic (or clean) labelled rows the score is their share; repeated rows are each
scored; labels without a document, and null labels, are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumenkg.llm.common import bucket_of_id, checkpointed, fitted_in_task, fresh_name, in_bucket, prepare, table, within_bytes
from lumenkg.llm.crf import Crf, FeatureRules, WordTable, blocks_of, fit
from lumenkg.llm.langid import clean_word


@dataclass(frozen=True)
class ToxicityRules:
    #: Bounds of the fitting sample: toxic and clean labelled documents, and bytes of all their texts.
    toxic_docs: int = 1500
    clean_docs: int = 4500
    max_bytes: int = 64_000_000
    #: Of sample documents of one label that share so many first or last words, one is learned from: near copies would count one text many times.
    edge_words: int = 8
    #: A word or beginning is a toxic unit if chance explains its documents with less than this probability.
    chance: float = 1e-5
    min_docs: int = 5
    prefixes: tuple[int, ...] = (4, 5, 6)
    window: int = 24
    #: Bounds of the field's windows: of all, of one toxic document and of one clean document.
    windows: int = 6_000
    toxic_windows: int = 6
    clean_windows: int = 2
    rounds: int = 40
    span_threshold: float = 0.5
    cut: float = 0.3


SPACE = re.compile(r"\S+")


def sampled_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(y, t) of about toxic_docs and clean_docs labelled rows, picked by a hash of the id, in the shared folder.

    Labels that repeat an id count once, as toxic if one of them says so; rows that repeat
    an id give their smallest text.  The bounded table of picked ids is broadcast.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col("toxic").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    quota = {0: rules.clean_docs, 1: rules.toxic_docs}
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("_y") == y) & (F.pmod(F.xxhash64("_k"), F.lit(n)) < quota[y]))
    picked = known.filter(keep).groupBy("_k").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).filter("_t IS NOT NULL")
    rows = texts.join(F.broadcast(picked), "_k").groupBy("_k").agg(F.max("_y").alias("y"), F.min("_t").alias("t"))
    return within_bytes(checkpointed(rows), "t", "_k", rules.max_bytes).select("y", "t")


def training_sample(docs: DataFrame, labels: DataFrame, rules: ToxicityRules, text: str = "text", key: str = "doc_id") -> list[tuple[int, str]]:
    """sampled_rows() on the driver, to look at or to fit with other rules."""
    return sorted((r.y, r.t) for r in sampled_rows(docs, labels, rules, text, key).collect())


def _units(word: str, rules: ToxicityRules) -> set[str]:
    return {f"={word}"} | {word[:n] for n in rules.prefixes if len(word) > n}


def toxic_units(tokens: list[tuple[int, list[str]]], rules: ToxicityRules) -> set[str]:
    """Words (marked =) and beginnings whose documents are toxic beyond chance."""
    n = Counter(y for y, _ in tokens)
    if not n[0] or not n[1]:
        return set()
    seen = {0: Counter(), 1: Counter()}
    for y, words in tokens:
        seen[y].update({u for w in set(words) for u in _units(w, rules)})
    share, out = n[1] / (n[0] + n[1]), set()
    for unit, a in seen[1].items():
        b = seen[0][unit]
        if a >= rules.min_docs and a >= 4 * b and sum(math.comb(a + b, i) * share**i * (1 - share) ** (a + b - i) for i in range(a, a + b + 1)) < rules.chance:
            out.add(unit)
    return out


def fit_toxicity(sample: list[tuple[int, str]], rules: ToxicityRules = ToxicityRules()) -> Crf:
    rng = random.Random(3)
    tokens, opened, closed = [], set(), set()
    once: dict[str, str] = {}  # one string per distinct word, however often it occurs
    for y, t in rng.sample(sample, len(sample)):
        words = [once.setdefault(w, w) for w in map(clean_word, t.lower().split()) if w]
        head, tail = (y, *words[: rules.edge_words]), (y, *words[-rules.edge_words :])
        if words and head not in opened and tail not in closed:
            tokens.append((y, words))
        opened.add(head)
        closed.add(tail)
    units = toxic_units(tokens, rules)
    hit = {}

    def tag(word: str) -> int:
        if word not in hit:
            hit[word] = int(bool(_units(word, rules) & units))
        return hit[word]

    size, windows, tags = rules.window, [], []
    lexicon: dict[str, int] = {}
    for y, words in tokens:
        marks = [y and tag(w) for w in words]
        lexicon.update({w: 1 for w, m in zip(words, marks) if m and f"={w}" in units})
        if len(words) < size:
            words, marks = words + [""] * (size - len(words)), marks + [0] * (size - len(words))
        if y and any(marks):
            starts = sorted({min(max(0, i - size // 2), len(words) - size) for i in range(len(words)) if marks[i]})
            starts = rng.sample(starts, min(len(starts), rules.toxic_windows))
        elif y:
            continue
        else:
            starts = [rng.randrange(len(words) - size + 1) for _ in range(rules.clean_windows)]
        windows += [words[s : s + size] for s in starts]
        tags += [marks[s : s + size] for s in starts]
    chosen = rng.sample(range(len(windows)), min(len(windows), rules.windows))
    if chosen:
        model = fit([windows[i] for i in chosen], np.array([tags[i] for i in chosen]), [0, 1], FeatureRules((3, 4, 5, 6, 7), True), lexicon, rules.rounds)
    else:
        model = fit([[""] * size], np.zeros((1, size), int), [0, 1], FeatureRules((3, 4, 5, 6, 7), True), {}, 1)
    table_, x, y = WordTable(model, clean_word), [], []
    for label, words in tokens:
        x.append(document_figures(model.marginals([table_.rows[a] for a in table_.blocks([words])])[0]))
        y.append(label)
    share = sum(y) / len(y) if y else sum(label for label, _ in sample) / max(1, len(sample))
    model.extra = {"logistic": _logistic(np.array(x), np.array(y)) if 0 < sum(y) < len(y) else ((0.0, 0.0), math.log((share + 1e-4) / (1 - share + 1e-4)))}
    return model


def learned_toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), text: str = "text", key: str = "doc_id") -> Crf:
    """The model of the labelled rows among docs, fitted by one task from a bounded sample."""
    return fitted_in_task(sampled_rows(docs, labels, rules, text, key), lambda rows: fit_toxicity(rows, rules))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[tuple[float, ...], float]:
    """Slopes of the columns of x, and the bias, by Newton's method; a column whose slope is negative is left out (slope 0) and the rest fitted again."""
    used = list(range(x.shape[1]))
    while True:
        a = np.concatenate([x[:, used], np.ones((len(x), 1))], axis=1)
        w, weight = np.zeros(len(used) + 1), ridge * 0.01 * len(x) * np.array([1.0] * len(used) + [0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
            h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(weight) + 1e-9 * np.eye(len(w))
            step = np.linalg.solve(h, a.T @ (y - p) - weight * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if not used or w[:-1].min() >= 0:
            slopes = dict(zip(used, w.tolist()))
            return tuple(slopes.get(i, 0.0) for i in range(x.shape[1])), float(w[-1])
        del used[int(np.argmin(w[:-1]))]


def document_figures(marginals: np.ndarray) -> tuple[float, float]:
    """Of all tokens of a document: log(1 + expected number of toxic ones), and the largest marginal; a text without a token has (0, 0)."""
    p = marginals[:, 1] if len(marginals) else np.zeros(1)
    return math.log1p(float(p.sum(dtype=np.float64))), float(p.max())


ADDED = {"score": "double", "n_spans": "long", "spans": "array<struct<start:int,end:int,p:double>>", "predicted": "int"}


def score_toxicity(spark: SparkSession, docs: DataFrame, model: Crf, rules: ToxicityRules = ToxicityRules(), text: str = "text", carry: tuple[str, ...] = ("doc_id",), added: dict[str, str] | None = None) -> DataFrame:
    """The columns carry, and score, n_spans, spans and predicted; spans are code points of offending tokens, end exclusive.

    Where carried columns have the names of added ones, added gives those other names.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed table of 2**18 buckets
    names = [(added or {}).get(c, c) for c in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        slopes, bias = crf.extra["logistic"]
        words_of = WordTable(crf, clean_word)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            scores, spans = [], []
            for first, documents in blocks_of(texts):
                at = words_of.blocks(documents)
                for i, p in enumerate(crf.marginals([words_of.rows[a] for a in at])):
                    x = sum(a * b for a, b in zip(slopes, document_figures(p))) + bias
                    scores.append(1 / (1 + math.exp(-min(50.0, max(-50.0, x)))))
                    hits = np.flatnonzero(p[:, 1] >= rules.span_threshold) if len(p) else ()
                    if len(hits):
                        places = [m.span() for m in SPACE.finditer(texts[first + i])]
                        spans.append([{"start": places[h][0], "end": places[h][1], "p": float(p[h, 1])} for h in hits])
                    else:
                        spans.append([])
            verdicts = pa.array([int(s >= rules.cut) for s in scores], pa.int32())
            made = [pa.array(scores, pa.float64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, kind), verdicts]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*carry, *names])

    schema = docs.select(*[F.col(f"`{c}`") for c in carry]).schema
    schema = StructType(schema.fields + [StructField(name, f.dataType) for name, f in zip(names, StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in ADDED.items())))])
    rows = docs.select(F.col(text).cast("string").alias(fresh_name("_text", list(carry))), *[F.col(f"`{c}`") for c in carry])
    return rows.mapInArrow(run, schema)


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels, rules = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ToxicityRules()
    model = learned_toxicity(docs, labels.filter(bucket_of_id("doc_id", 4) != 2), rules)
    out = score_toxicity(spark, docs, model, rules)
    return out.select("doc_id", in_bucket("doc_id", 4, 2).alias("held_out"), "score", "predicted", "n_spans", "spans")
