"""Personal data: base patterns, and a bootstrapped extractor that learns their contexts.

Base patterns find emails, IP addresses, card and phone numbers in whole texts; together
with long tokens that mix letters and digits (kind secret) they are the seeds.  The words
around a seed are lexical patterns: the last word before it, the last two, and the first
one after it.  Loosely shaped candidates (numbers without a plus sign, spelled-out
addresses, shorter tokens) are the unseen instances.

Patterns and instances form a bipartite graph over the corpus, scored round by round in
Spark: a pattern's confidence for a kind is the score of its distinct instances over their
number plus the times that it stands beside an ordinary word; it is trusted with at least
min_confidence and min_seeds accepted instances.  An instance is accepted if it is a seed
or stands beside a trusted pattern, and scores that pattern's confidence.  So instances
accepted in one round make further patterns eligible in the next, until a round trusts no
new pattern.  Candidates beside trusted patterns are reported beside the base spans.

Only spans, contexts and hashes are shuffled, never texts.  Ordinary uses are counted by a
scan that looks for patterns in a bitmap of bounded size; what passes it by chance is
removed by a semi join, so counts are the same whatever the bitmap's size.

Cases: null and empty texts have no span; repeated rows are each searched, but count once
as instances; ties between kinds go to the more confident pattern, then to the kind later
in the alphabet; base spans are never dropped, and found ones do not overlap them; very
long texts and words are searched whole, in time in proportion to their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed, prepare, table

# The base patterns, in the order of report.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]


class Runs:
    """Leftmost non-overlapping matches of a pattern that begins with one or more characters of a class.

    Where the pattern fails at the start of a run of the class it fails at every later
    character of the run, too, since only what follows the run decides.  So it is tried at
    starts of runs (and where a match ended) alone, and time is in proportion to the text.
    """

    def __init__(self, kind: str, rest: str):
        self.here, self.at_start = re.compile(f"[{kind}]++{rest}"), re.compile(f"(?<![{kind}])[{kind}]++{rest}")

    def finditer(self, text: str) -> Iterator[re.Match]:
        m = self.at_start.search(text)
        while m:
            yield m
            m = self.here.match(text, m.end()) or self.at_start.search(text, m.end())


# The base patterns again, in forms of linear time.
EMAILS = Runs("A-Za-z0-9._%+-", r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IPS = Runs("0-9", r"\.[0-9]++\.[0-9]++\.[0-9]++")
CARDS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONES = re.compile(PHONE)

SECRETS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
LOOSE_NUMBER = re.compile(r"\(?[0-9][\x20().0-9-]{5,}[0-9]")
LOOSE_EMAILS = Runs("A-Za-z0-9._%+-", r"\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)*+")
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(dot\)|\[dot\]|[-_:])\x20?[0-9]{1,3}){3}(?![0-9])")
WORD = re.compile(r"\S+")
DIGIT = re.compile("[0-9]")
DIGITS = re.compile("[0-9]+")
NOT_DIGIT = re.compile("[^0-9]+")


@dataclass(frozen=True)
class PiiRules:
    #: Rounds after which a loop that still changes what it trusts is an error.
    max_rounds: int = 50
    #: A pattern needs so many distinct accepted instances, and this confidence.
    min_seeds: int = 3
    min_confidence: float = 0.6
    #: A seed of the kind secret has so many characters, letters and digits at least.
    secret_chars: int = 32
    secret_each: int = 6
    #: Patterns that the bitmap has room for (64 bits each); with more of them more words pass it by chance, and the semi join removes those.
    max_broadcast: int = 100_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then by start; failing matches are dropped without a retry."""
    if not text:
        return []
    out = [("email", *m.span()) for m in EMAILS.finditer(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IPS.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    for m in CARDS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONES.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _apart(found: list[tuple], taken: list[tuple]) -> list[tuple]:
    """Those of found (..., start, end) that touch no span of taken; one pass over both, sorted."""
    edges, i, last, out = sorted((s, e) for *_, s, e in taken), 0, -1, []
    for x in sorted(found, key=lambda x: x[-2]):
        while i < len(edges) and edges[i][0] < x[-1]:
            last = max(last, edges[i][1])
            i += 1
        if last <= x[-2]:
            out.append(x)
    return out


def tokens(text: str, taken: list[tuple[str, int, int]], rules: PiiRules = PiiRules()) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of tokens that mix letters and digits and touch no span of taken: seeds of the kind secret, and shorter candidates."""
    strong, weak = [], []
    for m in SECRETS.finditer(text):
        digits = sum(map(len, DIGITS.findall(m[0])))
        letters = sum(map(str.isalpha, m[0]))
        if digits >= rules.secret_each and letters >= rules.secret_each:
            (strong if len(m[0]) >= rules.secret_chars else weak).append(m.span())
    return _apart(strong, taken), _apart(weak, taken)


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[list[str], int, int]]:
    """(kinds that the shape allows, start, end) of candidates that touch no base span."""
    found = []
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [(["email"], *m.span()) for m in LOOSE_EMAILS.finditer(text)]
    found += [(["ip"], *m.span()) for m in LOOSE_IP.finditer(text) if all(int(x) <= 255 for x in DIGITS.findall(m[0]))]
    for m in LOOSE_NUMBER.finditer(text):
        n = len(NOT_DIGIT.sub("", m[0]))
        kinds = ["phone"] * (7 <= n <= 15) + ["card"] * (13 <= n <= 19)
        if kinds:
            found.append((kinds, *m.span()))
    return _apart(found, taken)


class Contexts:
    """Patterns around places of one text: its words in lower case, digits as 0."""

    def __init__(self, text: str):
        self.words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        self.text, self.starts = text, [s for s, _ in self.words]

    def _word(self, i: int) -> str:
        s, e = self.words[i]
        return DIGIT.sub("0", self.text[s:e].lower())

    def of(self, start: int, end: int) -> list[str]:
        """The last word before a place and its last two words, and after a blank the first word after it.

        What stands before a place inside its own word is an affix of the place and counts as blank if it is a quote.
        """
        out = []
        while start and self.text[start - 1] in "\"'":
            start -= 1
        i = bisect_left(self.starts, start)
        if i and self.words[i - 1][1] <= start and self.text[start - 1].isspace():
            last = self._word(i - 1)
            out += [last] + ([f"{self._word(i - 2)} {last}"] if i > 1 else [])
        while end < len(self.text) and self.text[end] in "\"'":
            end += 1
        j = bisect_left(self.starts, end)
        if j < len(self.words) and self.text[end].isspace():
            out.append(f" {self._word(j)}")
        return out


SPAN = "array<struct<kind:string,start:int,end:int>>"
MENTIONS = f"k long, base {SPAN}, strong {SPAN}, found array<struct<kind:string,start:int,end:int,seed:boolean,pattern:string,instance:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
EDGE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("pattern", pa.string()), ("instance", pa.int64())]))


def mentions(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: PiiRules = PiiRules()) -> DataFrame:
    """Per row its base spans, strong ones of the kind secret, and every (pattern, instance) edge of seeds and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            bases, strongs, edges = [], [], []
            for t in batch.column(1).to_pylist():
                base, strong, found = base_spans(t), [], []
                if t and (base or DIGIT.search(t) or "(at)" in t or "[at]" in t or "@" in t):
                    sure, unsure = tokens(t, base, rules)
                    strong = [("secret", s, e) for s, e in sure]
                    seeds = [([k], s, e, True) for k, s, e in base + strong]
                    loose = loose_spans(t, base + strong)
                    loose += [(["secret"], s, e) for s, e in _apart(unsure, loose)]
                    around = Contexts(t) if seeds or loose else None
                    for ks, s, e, seed in seeds + [(*x, False) for x in loose]:
                        value = xxhash.xxh64_intdigest(t[s:e].lower().encode("utf-8", "replace")) - 2**63
                        patterns = around.of(s, e)
                        found += [(k, s, e, seed, p, value) for k in ks for p in patterns]
                bases.append(base)
                strongs.append(strong)
                edges.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), _structs(bases, SPAN_TYPE), _structs(strongs, SPAN_TYPE), _structs(edges, EDGE_TYPE)], ["k", "base", "strong", "found"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, MENTIONS)


def _structs(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    names = [f.name for f in kind.value_type]
    return pa.array([[dict(zip(names, x)) for x in r] for r in rows], kind)


def _bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """The hashes of values (column v), modulo bits, as a bitmap; at most bits / 64 words reach the driver."""
    place = F.pmod(F.xxhash64("v"), F.lit(bits))
    words = values.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("x"))
    got, out = words.toArrow(), np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return out.view(np.uint64)


def ordinary_uses(spark: SparkSession, docs: DataFrame, patterns: DataFrame, rules: PiiRules, text: str = "text") -> DataFrame:
    """(pattern, n): how often each pattern stands beside a word without a digit or @ in the corpus."""
    patterns = patterns.select("pattern").distinct()
    n = patterns.count()
    bits = 64 << (max(1, min(n, rules.max_broadcast)) - 1).bit_length()
    heads = patterns.select(F.substring_index("pattern", " ", -1).alias("v")).distinct()
    shared = spark.sparkContext.broadcast((_bitmap(patterns.withColumnRenamed("pattern", "v"), bits), _bitmap(heads, bits)))  # 16 bytes a pattern, up to max_broadcast of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        wanted, ends = shared.value
        known: dict[str, tuple[bool, bool, bool, bool]] = {}  # of a word: may end a pattern, may be one before, one after, is ordinary

        def in_map(bitmap: np.ndarray, value: str) -> bool:
            b = (xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), 42) + 2**63) % 2**64 - 2**63
            return bool(int(bitmap[b % bits >> 6]) >> (b % bits & 63) & 1)

        def look(word: str) -> tuple[bool, bool, bool, bool]:
            if len(known) > 500_000:
                known.clear()
            head = in_map(ends, word)
            known[word] = x = head, head and in_map(wanted, word), head and in_map(wanted, f" {word}"), "@" not in word and not DIGIT.search(word)
            return x

        for batch in batches:
            n = Counter()
            for t in batch.column(0).to_pylist():
                words = DIGIT.sub("0", t.lower()).split() if t else []  # as Contexts writes them, so a head is met whatever its digits
                before, plain_before, last = "", False, len(words) - 1
                for i, w in enumerate(words):
                    head, one, after, plain = known.get(w) or look(w)
                    if head:
                        if i < last and (known.get(words[i + 1]) or look(words[i + 1]))[3]:
                            if one:
                                n[w] += 1
                            if i and in_map(wanted, pair := f"{before} {w}"):
                                n[pair] += 1
                        if after and plain_before:
                            n[f" {w}"] += 1
                    before, plain_before = w, plain
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["pattern", "n"])

    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n")).join(patterns, "pattern", "left_semi")


def learned_patterns(spark: SparkSession, docs: DataFrame, found: DataFrame, rules: PiiRules = PiiRules(), text: str = "text") -> DataFrame:
    """(pattern, kind, confidence) of trusted contexts, by iteration over the pattern-instance graph until a round trusts the very set of the one before."""
    edges = found.select(F.explode("found").alias("x")).select("x.pattern", "x.kind", "x.seed", "x.instance")
    edges = checkpointed(edges.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")))
    # What has too few instances of a kind, accepted or not, can never be trusted.
    wide = edges.groupBy("pattern", "kind").agg(F.count("*").alias("d")).filter(F.col("d") >= rules.min_seeds)
    wide = checkpointed(wide.select("pattern", "kind"))
    # All that a pattern stands beside counts against it, whatever its kind.
    mine = edges.join(wide.select("pattern").distinct(), "pattern", "left_semi")
    plain = ordinary_uses(spark, docs, wide, rules, text)
    total = mine.groupBy("pattern").agg(F.countDistinct("instance").alias("d")).join(plain, "pattern", "left")
    size = total.select("pattern", (F.col("d") + F.coalesce("n", F.lit(0))).alias("size"))
    mine = checkpointed(edges.join(wide, ["pattern", "kind"], "left_semi").join(size, "pattern"))
    scored, trusted = mine.withColumn("score", F.col("seed").cast("double")), None
    for _ in range(rules.max_rounds):
        sums = scored.groupBy("pattern", "kind").agg((F.sum("score") / F.first("size")).alias("confidence"), F.count_if(F.col("score") > 0).alias("accepted"))
        patterns = checkpointed(sums.filter((F.col("confidence") >= rules.min_confidence) & (F.col("accepted") >= rules.min_seeds)).select("pattern", "kind", "confidence"))
        now = patterns.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind").cast("decimal(38,0)"))).first()
        if now == trusted or now[0] == 0:
            return patterns
        best = mine.join(patterns, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max("confidence").alias("c"))
        scored, trusted = mine.join(best, ["kind", "instance"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("c", F.lit(0.0)))), now
    raise RuntimeError(f"trusted patterns still change after {rules.max_rounds} rounds")


def find_personal_data(spark: SparkSession, docs: DataFrame, rules: PiiRules = PiiRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, base (array of kind, start, end) and extra (secrets, and what contexts find), each by kind and start."""
    prepare(spark)
    found = checkpointed(mentions(docs, text, key, rules).withColumn("_row", F.monotonically_increasing_id()))
    patterns = learned_patterns(spark, docs, found, rules, text)
    loose = found.select("_row", F.explode("found").alias("x")).filter("NOT x.seed").select("_row", "x.*")
    chosen = loose.join(patterns, ["pattern", "kind"]).groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    extra = chosen.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))
    none = F.array().cast(SPAN)
    return found.join(extra, "_row", "left").select(F.col("k").alias(key), "base", F.concat("strong", F.coalesce("extra", none)).alias("extra"))


def _in_order(spans, *more):
    """Spans by kind as in KINDS, then by start, as kind:start:end joined by commas."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE_KINDS), F.sha2(_in_order(F.col("base")), 256).alias("base_sha256"), _in_order(F.concat("base", "extra")).alias("spans"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans"))
