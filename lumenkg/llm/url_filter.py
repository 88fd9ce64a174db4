"""URL rules by a sort-merge range join.

A host turned around, org.example.www., makes a rule's host and all its subdomains one
interval of keys.  Urls are range-partitioned and sorted by that key (then path and id, so
one host's urls can lie in many partitions); each partition sweeps its sorted urls along
the sorted rule intervals and keeps a stack of those that are open.  Of the open rules
whose path starts the url's path, the longest wins.

Rules come as a list on the driver.  They are sent to the sweep in blocks of block_rules,
in order of their keys; a task sweeps its sorted urls along one block after another and
keeps the best rule so far, so any number of rules takes bounded memory.

Cases: a null url or one without :// has an empty host and path and no rule; a url without
a rule gets the default verdict; of equally long rules the one with the longer host wins,
then the first in order; the host and path of a rule are taken as they are; repeated rows
are each judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import prepare, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def reversed_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class HostSweep:
    """Open rule intervals while keys come in ascending order."""

    def __init__(self, rules: list[UrlRule]):
        by: dict[str, list[UrlRule]] = {}
        for r in dict.fromkeys(sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name, r.verdict))):
            by.setdefault(reversed_key(r.host), []).append(r)
        self.intervals, self.next, self.stack = sorted(by.items()), 0, []

    def rule(self, key: str, path: str) -> UrlRule | None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        while self.next < len(self.intervals) and self.intervals[self.next][0] <= key:
            opened = self.intervals[self.next]
            self.next += 1
            if key.startswith(opened[0]):
                self.stack.append(opened)
        fits = [next((r for r in rules if path.startswith(r.path)), None) for _, rules in self.stack]
        return max((r for r in fits if r), key=lambda r: (len(r.name), len(r.host)), default=None)


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url", key: str = "page_id", max_swept_rules: int = 200_000) -> DataFrame:
    """(key, host, path, rule, verdict) per row; max_swept_rules is the size of a block of rules."""
    prepare(spark)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("turned", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "turned", "path", "k").sortWithinPartitions("turned", "path", "k")
    kind = rows.schema["k"].dataType.simpleString()
    best = ordered.select("k", "host", "path", "turned", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("n"))
    in_order = sorted(rules, key=lambda r: (reversed_key(r.host), r.path))
    for i in range(0, len(in_order), max_swept_rules):
        best = _swept(spark, best, in_order[i : i + max_swept_rules], kind)
    return best.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _swept(spark: SparkSession, best: DataFrame, rules: list[UrlRule], kind: str) -> DataFrame:
    """Rows in order of turned, with a rule of this block where it beats the one so far; n is the length of the rule's host."""
    block = spark.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = HostSweep(block.value)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[4:]]
            for i, (turned, path) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                r = sweep.rule(turned, path)
                if r and (columns[0][i] is None or (len(r.name), len(r.host)) > (len(columns[0][i]), columns[2][i])):
                    columns[0][i], columns[1][i], columns[2][i] = r.name, r.verdict, len(r.host)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32())))], ["k", "host", "path", "turned", "rule", "verdict", "n"])

    return best.mapInArrow(run, f"k {kind}, host string, path string, turned string, rule string, verdict string, n int")


#: The rules of the query.
RULES = [UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/")]


def op8_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages"), RULES)


OP8_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
      FROM t JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT t.page_id, t.host, t.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM t LEFT JOIN f ON f.page_id = t.page_id
"""
