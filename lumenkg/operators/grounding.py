"""Where a quoted evidence stands in its source, in the source's own offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Runs of Chinese characters in hints, and hints that tell nothing.
HINT = re.compile(r"[一-鿿]{2,}")
EMPTY_HINTS = frozenset("示例 例子 公式 课堂 如下 例如 比如".split())


def _trimmed(source: str, start: int, end: int, most: int) -> tuple[int, int]:
    while start < end and source[start].isspace():
        start += 1
    while start < end and source[end - 1].isspace():
        end -= 1
    return start, min(end, start + most)


def ground(evidence: str | None, source: str | None, hints: str | None = "", longest: int = 16, least: int = 8, most: int = 160) -> tuple[int, int, str] | None:
    """(start, end, how) of evidence in source, in code points: as it is, but for white space, by its longest piece (16 to 8 characters), or between words of the hints."""
    quote = (evidence or "").strip()
    if not quote or not source:
        return None
    if (i := source.find(quote)) >= 0:
        return i, i + len(quote), "exact"
    at = [i for i, c in enumerate(source) if not c.isspace()]
    dense, wanted = "".join(source[i] for i in at), "".join(quote.split())
    if wanted and (i := dense.find(wanted)) >= 0:
        return at[i], at[i + len(wanted) - 1] + 1, "spaced"
    for n in range(min(longest, len(wanted)), least - 1, -2):
        for piece in (wanted[k : k + n] for k in range(len(wanted) - n + 1)):
            if (i := dense.find(piece)) >= 0:
                return at[i], min(at[i + n - 1] + 1, at[i] + most), "piece"
    found = set()
    for run in HINT.findall(f"{hints or ''} {quote}"):
        k = 0
        while k < len(run):
            n = next((n for n in range(len(run) - k, 1, -1) if run[k : k + n] not in EMPTY_HINTS and run[k : k + n] in source), 0)
            if n:
                i = source.find(run[k : k + n])
                found.add((i, i + n))
            k += n or 1
    if len(found) < 2:
        return None
    start, end = _trimmed(source, max(0, min(found)[0] - 4), min(len(source), max(e for _, e in found) + 20), len(source))
    if len("".join(source[start:end].split())) < 12:
        return None
    return start, min(end, start + most), "hints"


def grounded(rows: DataFrame, evidence: str, source: str, hints: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, start, end, how (null where nothing is found) of rows that hold a source and an evidence; texts of any length, one row at a time."""
    picked = rows.select(*keep, F.col(evidence).alias("_e"), F.col(source).alias("_s"), (F.col(hints) if hints else F.lit("")).alias("_h"))
    names = [*keep, "start", "end", "how"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, s, h = (batch.column(len(keep) + i).to_pylist() for i in range(3))
            spans = [ground(*x) or (None, None, None) for x in zip(e, s, h)]
            found = [pa.array([x[i] for x in spans], kind) for i, kind in enumerate([pa.int32(), pa.int32(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], names)

    schema = picked.select(*keep).schema.add("start", "integer").add("end", "integer").add("how", "string")
    return picked.mapInArrow(run, schema)
