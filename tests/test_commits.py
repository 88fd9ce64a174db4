"""Committed versions with two writers, rebuilds of changed keys, and a stream that is broken off and taken up again."""

import pytest
from pyspark.sql import functions as F

from lumenkg.sources.commits import CommitConflict, VersionedTable, rebuild_changed
from lumenkg.streaming.ingest import run_once
from lumenkg.streaming.resume import finished_chunks


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_writers(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert a.version() == 0 and a.read() is None
    assert a.replace(numbers(spark, 1)) == 1
    seen = b.read()
    assert a.append(numbers(spark, 2), parent=1) == 2
    with pytest.raises(CommitConflict):
        b.append(numbers(spark, 3), parent=1)  # read before a committed
    assert rows(a.read()) == [(1,), (2,)] and rows(seen) == [(1,)] and rows(b.read(1)) == [(1,)]
    calls = []

    def slow(old):
        calls.append(rows(old))
        if len(calls) == 1:
            a.append(numbers(spark, 4))  # a commits while b still computes
        return old.unionByName(numbers(spark, 5))

    assert b.update(slow) == 4
    assert calls == [[(1,), (2,)], [(1,), (2,), (4,)]] and rows(a.read()) == [(1,), (2,), (4,), (5,)]


def test_a_dead_writer_leaves_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.replace(numbers(spark, 1))
    t._stage(numbers(spark, 9))  # rows without a manifest
    (tmp_path / "t/versions/x.draft").write_text("{")
    assert t.version() == 1 and rows(t.read()) == [(1,)]
    assert rows(numbers(spark)) == [] and t.replace(numbers(spark)) == 2 and rows(t.read()) == []


def test_only_changed_keys_are_computed(spark, tmp_path):
    out, computed = VersionedTable(spark, str(tmp_path / "t")), []

    def compute(part):
        computed.append(sorted({r.k for r in part.collect()}))
        return part.groupBy("k").agg(F.sum("x").alias("s"))

    make = lambda *r: spark.createDataFrame(r, "k string, x int")
    rebuild_changed(out, make(("a", 1), ("a", 2), ("b", 3), ("c", None)), "k", compute)
    rebuild_changed(out, make(("b", 3), ("a", 2), ("a", 1), ("c", None)), "k", compute)
    rebuild_changed(out, make(("b", 4), ("a", 2), ("a", 1), ("d", 7)), "k", compute)
    assert computed == [["a", "b", "c"], [], ["b", "d"]]
    assert rows(out.read().select("k", "s")) == [("a", 3), ("b", 4), ("d", 7)]


def test_a_stream_taken_up_again(spark, tmp_path):
    schema = "key string, seq long, fingerprint string, chunk long, text string"
    events = [("l1", 1, "f", 0, "a"), ("l1", 2, "f", 1, "b"), ("l2", 3, "f", 0, "c"), ("l1", 4, "f", 1, "again"), ("l1", 5, "g", 0, "new"), ("l2", 6, "f", 0, "again"), ("l1", 7, "g", 0, "again"), ("l1", 8, "g", 2, "d")]
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (events[:2], events[2:5], events[5:]):  # each call is a restart from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run_once(finished_chunks(spark.readStream.schema(schema).parquet(src)), out, cp)
    want = rows(finished_chunks(spark.createDataFrame(events, schema)))
    assert rows(spark.read.parquet(out)) == want and [r[1] for r in sorted(want, key=lambda r: r[1])] == [1, 2, 3, 5, 8]
