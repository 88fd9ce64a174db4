"""A linear-chain conditional random field over words, trained and applied with numpy.

A word's features are its own hash, its character n-grams with word borders (so affixes
too), and the label lexicon that holds it.  Features are hashed into a fixed table.
Training follows the gradient of the likelihood from forward-backward; inference runs
forward-backward over whole documents, all documents of a block side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

START, END = 2, 3
CONTROL = re.compile("[\x02\x03]")
U = np.uint64


@dataclass(frozen=True)
class FeatureRules:
    orders: tuple[int, ...] = (2, 3, 4)
    #: Keep only n-grams that touch a border of the word.
    affixes_only: bool = False
    bits: int = 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def word_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, np.diff([*starts, len(codes)])).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(codes.astype(np.uint64) * U(0x9E3779B1) + place * U(0x85EBCA77C2B2AE63)), starts))


def features(words: list[str], rules: FeatureRules):
    """(list of (bucket, valid) arrays over the joined words, start of each word, word hashes)."""
    joined = "".join(f"\x02{CONTROL.sub(' ', w)}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(codes == START)
    owner = np.cumsum(codes == START)
    mask = U((1 << rules.bits) - 1)
    wide, out = codes.astype(np.uint64), []
    whole = word_hashes(codes, starts)
    for n in rules.orders:
        m = len(codes) - n + 1
        bucket, valid = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        if m > 0:
            h = np.full(m, 0x51ED27 + n, np.uint64)
            for j in range(n):
                h = _mix(h + wide[j : j + m] * U(0x9E3779B97F4A7C15))
            ok = owner[:m] == owner[n - 1 :]
            if rules.affixes_only:
                ok &= (codes[:m] == START) | (codes[n - 1 :] == END)
            bucket[:m], valid[:m] = (h & mask).astype(np.int64), ok
        out.append((bucket, valid))
    own = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    own[0][starts], own[1][starts] = (whole & mask).astype(np.int64), True
    out.append(own)
    return out, starts, whole


@dataclass
class Crf:
    labels: list
    rules: FeatureRules
    weights: np.ndarray  # buckets x labels
    lexicon: np.ndarray  # sorted word hashes
    lexicon_label: np.ndarray
    lexicon_weights: np.ndarray  # labels + 1 x labels, the last row for words in no lexicon
    transitions: np.ndarray
    start: np.ndarray
    extra: dict = field(default_factory=dict)

    def _in_lexicon(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(len(whole), len(self.labels))
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, self.lexicon_label[at], len(self.labels))

    def emissions(self, words: list[str]) -> np.ndarray:
        """words x labels"""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        grams, starts, whole = features(words, self.rules)
        out = self.lexicon_weights[self._in_lexicon(whole)].astype(np.float32)
        for bucket, valid in grams:
            at = np.flatnonzero(valid)
            if len(at):
                word = np.searchsorted(starts, at, "right") - 1
                for k in range(len(self.labels)):
                    out[:, k] += np.bincount(word, self.weights[bucket[at], k], len(words)).astype(np.float32)
        return out

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Posterior of each label at each position, for each sequence, by forward-backward side by side."""
        sizes = np.array([len(e) for e in emissions])
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return [np.zeros((0, len(self.labels)), np.float32) for _ in emissions]
        n = sizes[order]
        doc = np.concatenate([emissions[i] for i in order])
        active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")  # sequences longer than t
        at = np.concatenate([[0], np.cumsum(active)])
        rank = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        place = at[t] + rank
        p = np.empty_like(doc)
        p[place] = np.exp(doc - doc.max(axis=1, keepdims=True))
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        alpha = np.empty_like(p)
        a = p[: at[1]] * np.exp(self.start - self.start.max()).astype(np.float32)
        ones = np.ones((len(self.labels), 1), np.float32)
        for i in range(len(active)):
            if i:
                a = (a[: active[i]] @ step) * p[at[i] : at[i + 1]]
            a /= a @ ones
            alpha[at[i] : at[i + 1]] = a
        back = np.ones((0, len(self.labels)), np.float32)
        turned = np.ascontiguousarray(step.T)
        for i in range(len(active) - 1, -1, -1):
            if len(back) < active[i]:
                back = np.concatenate([back, np.ones((active[i] - len(back), len(self.labels)), np.float32)])
            alpha[at[i] : at[i + 1]] *= back
            if i:
                back = (back * p[at[i] : at[i + 1]]) @ turned
                back /= back @ ones
        alpha /= alpha @ ones
        alpha = alpha[place]
        out: list[np.ndarray] = [alpha[:0]] * len(emissions)
        for i, x in zip(order, np.split(alpha, np.cumsum(n)[:-1])):
            out[i] = x
        return out


def fit(windows: list[list[str]], tags: np.ndarray, labels: list, rules: FeatureRules, lexicon: dict[str, int], rounds: int = 40, rate: float = 0.25, l2: float = 1e-4) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam over all windows at once.

    windows all have one length; tags is windows x length, of label numbers.  Only buckets
    that the windows meet have weights while fitting; the others stay 0.
    """
    k = len(labels)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in windows for w in s))}
    words = list(vocabulary)
    grams, starts, whole = features(words, rules)
    bucket, word = [], []
    for b, valid in grams:
        at = np.flatnonzero(valid)
        bucket.append(b[at])
        word.append(np.searchsorted(starts, at, "right") - 1)
    met, bucket = np.unique(np.concatenate(bucket), return_inverse=True)
    word, size = np.concatenate(word), len(met)
    lex_words = list(lexicon)
    lex_hash = features(lex_words, rules)[2] if lex_words else np.empty(0, np.uint64)
    rank = np.argsort(lex_hash)
    model = Crf(labels, rules, np.zeros((size, k)), lex_hash[rank], np.array([lexicon[lex_words[i]] for i in rank], np.int64), np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    lex = model._in_lexicon(whole)
    seq = np.array([[vocabulary[w] for w in s] for s in windows])
    b, length = seq.shape
    hot = np.eye(k)[tags]
    seen_step = np.einsum("btk,btj->kj", hot[:, :-1], hot[:, 1:])
    names = ("weights", "lexicon_weights", "transitions", "start")
    moment = {n: (np.zeros_like(getattr(model, n)), np.zeros_like(getattr(model, n))) for n in names}
    for r in range(1, rounds + 1):
        e = model.lexicon_weights[lex]
        for j in range(k):
            e[:, j] += np.bincount(word, model.weights[bucket, j], len(words))
        p = np.exp(e - e.max(axis=1, keepdims=True))[seq]
        step = np.exp(model.transitions - model.transitions.max())
        alpha, beta = np.empty_like(p), np.ones_like(p)
        for t in range(length):
            x = p[:, t] * (np.exp(model.start - model.start.max()) if t == 0 else alpha[:, t - 1] @ step)
            alpha[:, t] = x / x.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            x = (p[:, t + 1] * beta[:, t + 1]) @ step.T
            beta[:, t] = x / x.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        expected = np.zeros((k, k))
        for t in range(1, length):
            right = p[:, t] * beta[:, t]
            norm = np.einsum("bk,kj,bj->b", alpha[:, t - 1], step, right)
            expected += step * ((alpha[:, t - 1] / norm[:, None]).T @ right)
        miss = (hot - gamma).reshape(-1, k)
        flat = seq.ravel()
        by_word = np.stack([np.bincount(flat, miss[:, j], len(words)) for j in range(k)], axis=1)
        grad = {
            "weights": np.stack([np.bincount(bucket, by_word[word, j], size) for j in range(k)], axis=1),
            "lexicon_weights": np.stack([np.bincount(lex, by_word[:, j], k + 1) for j in range(k)], axis=1),
            "transitions": seen_step - expected,
            "start": (hot[:, 0] - gamma[:, 0]).sum(axis=0),
        }
        for n in names:
            value, (m, v) = getattr(model, n), moment[n]
            g = grad[n] / b - l2 * value
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8) * (np.abs(g) > 0)
    for n in names:
        setattr(model, n, getattr(model, n).astype(np.float32))
    fitted, model.weights = model.weights, np.zeros((1 << rules.bits, k), np.float32)
    model.weights[met] = fitted
    return model


class WordTable:
    """Emissions of distinct words, kept while the table is small."""

    def __init__(self, model: Crf, clean, limit: int = 500_000):
        self.model, self.clean, self.limit = model, clean, limit
        self._reset()

    def _reset(self):
        self.at, self.rows, self.used = {}, np.zeros((1024, len(self.model.labels)), np.float32), 0

    def blocks(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Row numbers into rows for each document's words."""
        if self.used > self.limit:
            self._reset()
        at = self.at
        missing = list({w for words in documents for w in words if w not in at})
        if missing:
            new = np.concatenate([self.model.emissions([self.clean(w) for w in missing[i : i + 50_000]]) for i in range(0, len(missing), 50_000)])
            while self.used + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(missing)] = new
            at.update(zip(missing, range(self.used, self.used + len(missing))))
            self.used += len(missing)
        return [np.fromiter(map(at.__getitem__, words), np.int64, len(words)) for words in documents]


def blocks_of(texts: list[str], max_words: int = 600_000):
    """Split texts into words, (first index, word lists) per block of about max_words."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        words = t.lower().split() if t else []
        if held and n + len(words) > max_words:
            yield first, held
            first, held, n = i, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held
