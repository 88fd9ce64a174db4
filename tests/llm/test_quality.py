"""Quality rules against a plain count, with odd rows."""

import random
import re
from collections import Counter

from lumenkg.llm.quality import QualityRules, judge_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, rules):
    texts = {}
    for _, t, h in rows:
        texts.setdefault(h, set()).add(t or "")
    limits, hot = {h: len(x) for h, x in texts.items()}, set()
    for h, x in texts.items():
        n = Counter()
        for t in x:
            n.update({line.strip(" \t\n\x0b\f\r").lower() for line in t.split("\n") if WORD.search(line)})
        hot |= {(h, line) for line, c in n.items() if c > rules.line_min_docs and c * 100 > limits[h] * rules.line_max_percent}
    out = []
    for i, t, h in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        n = Counter(grams)
        covered = {j + k for j, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        removed = sum(len(WORD.findall(x)) for x in lines if (h, x.strip(" \t\n\x0b\f\r").lower()) in hot)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and len(words) - removed >= 10))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rules = QualityRules(line_min_docs=3, line_max_percent=5.0)
    boiler = "This line is on every page of the site and is long"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "x " * 30, "a"), (5, "é #1 " * 3, "b"), (6, "a\x0bb\u00a0c d\u2028e f g h i j k l", "b")]
    for i in range(7, 60):
        lines = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(lines + [boiler.upper() if i % 2 else boiler + " "]), rng.choice(["a", "b", None])))
    rows += [rows[-1], (None, rows[-1][1], rows[-1][2])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_words int")
    out = judge_documents(spark, docs, rules).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out), key=repr)
    assert got == brute(rows, rules)
    assert judge_documents(spark, docs.limit(0), rules).count() == 0
