"""Ordinary uses of patterns are the same however many patterns there are."""

from collections import Counter

from lumenkg.llm.pii import PiiRules, ordinary_uses

TEXTS = ["In 2024 we met, v2 works and Room 12 is open", "in 1999 we left v7 behind", "room 0 is shut", "call 12 34 now x@y.z 5 v2", "", None, "v2", "a\u00a0v3\tb 2024 me@x.org in 2024 1"]
PATTERNS = ["0000", "in 0000", "v0", "00", "room 00", "room 0", "we", "absent 0", "00 00"]


def test_both_paths_count_patterns_that_hold_digits(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    few, many = ({r.pattern: r.n for r in ordinary_uses(spark, docs, patterns, PiiRules(max_broadcast=m)).collect()} for m in (100, 2))
    want = Counter()
    for t in TEXTS:
        words = ["".join("0" if c in "0123456789" else c for c in w) for w in (t or "").lower().split()]
        for i, after in enumerate(words[1:]):
            if "0" not in after and "@" not in after:
                want.update(p for p in (words[i], " ".join(words[i - 1 : i + 1]) if i else None) if p in PATTERNS)
    assert few == many == dict(want) and want["0000"] == 2 and want["v0"] == 3
