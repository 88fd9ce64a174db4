"""Language of whole texts by a conditional random field over words.

Words of code-switched text are labelled by forward-backward over affix, n-gram and
lexicon features with learned transitions; the posterior mass of the words with a letter
decides the document.  The model is fitted on a bounded sample of labelled documents,
rearranged into windows that switch language now and then, so transitions are learned too.

Cases: a null text, or one without a letter, gives und with score 0; a tie goes to the
label that sorts first; repeated rows are each judged; a row with a null id is judged,
held out from nothing and learned from by nothing; without a labelled row every text
is und.  Language, source and id columns are not inputs of a prediction.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import bucket_of_id, checkpointed, fitted_in_task, in_bucket, prepare, table, within_bytes
from lumenkg.llm.crf import Crf, FeatureRules, WordTable, blocks_of, fit

#: Punctuation stripped from both ends of a word.
PUNCTUATION = ".,;:!?()[]{}\"'|/\\<>*#%&$=+-_–—…«»“”‘’¿¡"


@dataclass(frozen=True)
class LanguageRules:
    #: Bounds of the fitting sample: documents per language, bytes of all their texts, and words per language (whole documents until it is reached; of a longer one, so many words from a random place).
    docs_per_language: int = 300
    max_bytes: int = 64_000_000
    words_per_language: int = 40_000
    #: Beyond so many languages each has fewer documents in the sample; none is left out.
    max_languages: int = 64
    window: int = 40
    rounds: int = 40


def clean_word(word: str) -> str:
    return word.strip(PUNCTUATION)


def sampled_rows(docs: DataFrame, rules: LanguageRules, text: str, lang: str, key: str) -> DataFrame:
    """(l, t) of about docs_per_language texts of each label, fewer beyond max_languages labels, chosen by a hash of the id without a sort.

    A label that the hash passes over gives its smallest text that has a letter, if it has one, so every label is learned.
    """
    labelled = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL AND l IS NOT NULL")
    counts = {r[0]: r[1] for r in labelled.groupBy("l").count().collect()}
    each = max(1, rules.docs_per_language * min(len(counts), rules.max_languages) // max(1, len(counts)))
    share = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("l")] if counts else F.lit(1)
    picked = checkpointed(labelled.filter(F.pmod(F.xxhash64("k"), share) < each))
    picked = within_bytes(picked, "t", "k", rules.max_bytes).select("l", "t")
    letter = F.col("t").rlike(r"\p{L}")
    missing = sorted(set(counts) - {r.l for r in picked.filter(letter).select("l").distinct().collect()})
    if missing:
        rest = labelled.filter(F.col("l").isin(missing) & letter).groupBy("l").agg(F.min_by("t", F.struct(F.length("t"), "t")).alias("t"))
        picked = checkpointed(picked.unionByName(rest))
    return picked


def training_sample(docs: DataFrame, rules: LanguageRules, text: str, lang: str, key: str) -> list[tuple[str, str]]:
    """sampled_rows() on the driver, to look at or to fit with other rules."""
    return sorted((r.l, r.t) for r in sampled_rows(docs, rules, text, lang, key).collect())


def learned_languages(docs: DataFrame, rules: LanguageRules = LanguageRules(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Crf | None:
    """The model of the labelled rows of docs, fitted by one task from a bounded sample."""
    return fitted_in_task(sampled_rows(docs, rules, text, lang, key), lambda rows: fit_languages(rows, rules))


def fit_languages(sample: list[tuple[str, str]], rules: LanguageRules = LanguageRules()) -> Crf | None:
    by: dict[str, list[str]] = {}
    rng, once = random.Random(11), {}  # one string per distinct word
    for lang, text in random.Random(7).sample(sample, len(sample)):
        words = [once.setdefault(w, w) for w in map(clean_word, text.lower().split()) if any(map(str.isalpha, w))]
        if len(by.setdefault(lang, [])) < rules.words_per_language:
            at = rng.randrange(max(1, len(words) - rules.words_per_language + 1))
            by[lang] += words[at : at + rules.words_per_language]
    labels = sorted(lang for lang, words in by.items() if words)
    if not labels:
        return None
    counts = [Counter(by[lang]) for lang in labels]
    total = Counter()
    for c in counts:
        total.update(c)
    lexicon = {w: k for k, c in enumerate(counts) for w, n in c.items() if n >= 3 and n >= 0.8 * total[w]}
    windows, tags = [], []
    left = {k: 0 for k in range(len(labels))}
    while left:
        words: list[str] = []
        tag: list[int] = []
        k = rng.choice(list(left))
        while len(words) < rules.window and left:
            if k not in left or rng.random() < 0.3:
                k = rng.choice(list(left))
            n = min(rng.randrange(4, rules.window), rules.window - len(words))
            span = by[labels[k]][left[k] : left[k] + n]
            words, tag, left[k] = words + span, tag + [k] * len(span), left[k] + n
            if left[k] >= len(by[labels[k]]):
                del left[k]
        if len(words) == rules.window:
            windows.append(words)
            tags.append(tag)
    if not windows:  # a handful of words: repeat them up to one window
        flat = [(w, k) for k, lang in enumerate(labels) for w in by[lang]]
        flat = (flat * rules.window)[: rules.window]
        windows, tags = [[w for w, _ in flat]], [[k for _, k in flat]]
    return fit(windows, np.array(tags), labels, FeatureRules(), lexicon, rules.rounds)


def predict_languages(spark: SparkSession, docs: DataFrame, model: Crf | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, n_words, spans) per row; spans is the number of label changes along the text."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed table of 2**18 buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        words_of = crf and WordTable(crf, clean_word)
        letters: dict[str, bool] = {}
        for batch in batches:
            lang, score, n, switches = [], [], [], []
            for _, documents in blocks_of(batch.column(1).to_pylist()):
                if len(letters) > 500_000:
                    letters.clear()
                for words in documents:
                    for w in words:
                        if w not in letters:
                            letters[w] = any(map(str.isalpha, w))
                kept = [[w for w in words if letters[w]] for words in documents]
                n += map(len, kept)
                if crf is None:
                    posteriors = [np.zeros((0, 1))] * len(kept)
                else:
                    at = words_of.blocks(kept)
                    posteriors = crf.marginals([words_of.rows[a] for a in at])
                for p in posteriors:
                    if not len(p):
                        lang.append("und"), score.append(0.0), switches.append(0)
                        continue
                    mass = p.sum(axis=0, dtype=np.float64)
                    best = int(mass.argmax())
                    lang.append(crf.labels[best])
                    score.append(min(1.0, float(mass[best] / len(p))))
                    switches.append(int((np.diff(p.argmax(axis=1)) != 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(switches, pa.int64())], ["k", "lang_pred", "score", "n_words", "n_switches"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, lang_pred string, score double, n_words long, n_switches long").withColumnRenamed("k", key)


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = table(spark, sf_dir, "documents"), LanguageRules()
    prepare(spark)
    model = learned_languages(docs.filter(bucket_of_id("doc_id", 5) != 0), rules)
    out = predict_languages(spark, docs, model)
    return out.select("doc_id", in_bucket("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
