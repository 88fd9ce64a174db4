"""Text functions as Column expressions: normalising, tokens, n-grams, times, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
#: Punctuation that overlap comparison ignores beside white space.
OVERLAP_PUNCTUATION = "，。！？、；：,.!?;:\"'()（）\\[\\]【】<>《》“”‘’`~\\-_/\\\\|"


def clean_text(c: Column) -> Column:
    """Lower case, CJK ideographs, a-z and digits only, run together."""
    return F.regexp_replace(F.lower(c), "[^\\u4e00-\\u9fa5a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Each CJK character, and each run of other letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{CJK}]|[\\p{{L}}\\p{{N}}&&[^{CJK}]]++"), F.lit(0))


def bm25_tokens(c: Column) -> Column:
    """tokens, and the bigrams of neighbouring CJK characters after them."""
    pairs = F.regexp_extract_all(F.lower(c), F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))
    return F.concat(tokens(c), pairs)


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, "\\s+", "")


def normalize_text(c: Column) -> Column:
    """Lower case without white space and punctuation, for overlap."""
    return F.regexp_replace(F.lower(c), f"[\\s{OVERLAP_PUNCTUATION}]+", "")


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of normalised text; a shorter text is its own only gram."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: c.substr(i, F.lit(n))))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's grams that b has."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def word_count(c: Column) -> Column:
    """CJK characters and Latin words."""
    return F.size(F.regexp_extract_all(c, F.lit(f"[{CJK}]|[A-Za-z0-9_]+"), F.lit(0)))


def contains_ignoring_space(text: Column, part: Column, empty: bool = True) -> Column:
    """Whether text holds part, white space aside; empty says what an empty side gives."""
    a, b = without_space(F.coalesce(text, F.lit(""))), without_space(F.coalesce(part, F.lit("")))
    return F.when((a == "") | (b == ""), F.lit(empty)).otherwise(a.contains(b))


def hms(seconds: Column) -> Column:
    """HH:MM:SS,000 of whole seconds; milliseconds are always 000."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d,000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def minutes_seconds(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def seconds_of(c: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS text (a comma as decimal point is read as one)."""
    parts = F.transform(F.reverse(F.split(F.replace(c, F.lit(","), F.lit(".")), ":")), lambda x: x.try_cast("double"))
    folded = F.aggregate(F.zip_with(parts, F.array(F.lit(1.0), F.lit(60.0), F.lit(3600.0)), lambda p, w: F.coalesce(p * w, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), folded)


def cue_id(lecture: Column, start: Column, end: Column, rounded: bool = False) -> Column:
    """lecture_startms_endms; milliseconds are cut off, or rounded by the remapper's rule."""
    ms = lambda t: (F.round(t * 1000) if rounded else F.floor(t * 1000)).cast("long").cast("string")
    return F.concat_ws("_", lecture.cast("string"), ms(start), ms(end))


def cue_times(c: Column) -> Column:
    """(start, end) in seconds of a cue id."""
    at = lambda i: F.regexp_extract(c, "_(\\d+)_(\\d+)$", i).try_cast("double") / 1000
    return F.struct(at(1).alias("start_sec"), at(2).alias("end_sec"))


def slug(c: Column) -> Column:
    """Lower-case words joined by -, with the first 8 digits of the name's sha1."""
    base = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9\\u4e00-\\u9fff]+", "-"), F.lit("-"))
    return F.concat_ws("-", F.when(base != "", F.substring(base, 1, 40)), F.substring(F.sha1(c), 1, 8))


def effective_length(c: Column) -> Column:
    """Length without the slot sign and white space."""
    return F.length(F.regexp_replace(F.replace(c, F.lit("…"), F.lit("")), "\\s", ""))


def primary_name(c: Column) -> Column:
    """The part of a bilingual name before its first slash."""
    return F.trim(F.element_at(F.split(c, "/", 2), 1))


def sentences(c: Column) -> Column:
    """Sentences, each with its closing mark, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(c, "(?<=[。！？!?.;；\\n])"), F.trim), lambda s: s != "")


def sample_time(start: Column, end: Column, margin: float = 3.0, settle: float = 2.0, buffer: float = 0.5, short: float = 0.85) -> Column:
    """A moment late in an interval: margin before its end, settle after its start at least, and inside it by buffer."""
    late = F.greatest(end - margin, start + settle)
    late = F.when(late <= start + buffer, start + (end - start) * short).otherwise(late)
    return F.when(end <= start, start).otherwise(F.greatest(start, F.least(late, end - buffer)))
