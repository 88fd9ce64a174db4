"""Tables whose versions are committed whole: a reader sees a version or the one before it, never half a write.

A version is a manifest, a small file that names the folders its rows lie in.  Rows are
written to a folder of their own first; then the manifest is written under another name and renamed to its
number, which fails where that number exists.  So of two writers that start from one version
one commits, and the other reads again and repeats its change: no lock is held, and a writer that dies leaves
only files that no manifest names.  Renames without overwriting are atomic on distributed file systems; a plain local
disk checks and renames in two steps.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class VersionedTable:
    """A table under path; what it reads and writes goes through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self._at = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("versions").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest version, 0 if there is none."""
        folder = self._at("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n)), default=0)

    def manifest(self, version: int) -> dict:
        file = self._fs.open(self._at(f"versions/{version:012}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None of an empty table."""
        number = self.version() if version is None else version
        if not number:
            return None
        found = self.manifest(number)
        return self.spark.read.schema(found["schema"]).parquet(*[f"{self.path}/{f}" for f in found["folders"]])

    def _stage(self, rows: DataFrame) -> str:
        folder = f"rows/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, parent: int, manifest: dict) -> int:
        text = json.dumps(manifest, sort_keys=True)
        draft = self._at(f"versions/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        keep[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            files.rename(draft, self._at(f"versions/{parent + 1:012}.json"), keep)
        except Exception as failed:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(failed):
                raise CommitConflict(f"version {parent + 1} of {self.path} exists") from failed
            raise
        return parent + 1

    def replace(self, rows: DataFrame, parent: int | None = None) -> int:
        """Commit rows as the whole table, over parent (the newest version by default); its number."""
        number = self.version() if parent is None else parent
        return self._commit(number, {"folders": [self._stage(rows)], "schema": rows._jdf.schema().toDDL()})

    def append(self, rows: DataFrame, parent: int | None = None) -> int:
        """Commit rows beside those of parent; folders of earlier versions are named again, not copied."""
        number = self.version() if parent is None else parent
        old = self.manifest(number)["folders"] if number else []
        return self._commit(number, {"folders": [*old, self._stage(rows)], "schema": rows._jdf.schema().toDDL()})

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 10) -> int:
        """Read, change and commit; where another writer was faster, again from what it committed."""
        for _ in range(tries):
            number = self.version()
            try:
                return self.replace(change(self.read(number)), number)
            except CommitConflict:
                continue
        raise CommitConflict(f"{tries} times in a row")


def rebuild_changed(out: VersionedTable, source: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Commit a rebuild of out in which only changed keys of source are computed; the others' rows are carried.

    Rows of out hold their key and `_digest`, a fingerprint of all source rows of that key in no order; keys that source no longer holds go.
    compute gets the source rows of the changed keys and returns rows with the key.  A repeated call on
    the same source computes nothing, so a rebuild that was killed is simply called again.
    """
    columns = sorted(source.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    # Sums of hash parts do not depend on the order of rows and are added before the shuffle.
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    digests = source.groupBy(key).agg(F.concat_ws("-", F.count("*").cast("string"), *parts).alias("_digest"))

    def change(old: DataFrame | None) -> DataFrame:
        if old is None:
            return compute(source).join(digests, key)
        same = old.select(key, "_digest").distinct().join(digests, [key, "_digest"], "left_semi")
        fresh = compute(source.join(same, key, "left_anti")).join(digests, key)
        return old.join(same, [key, "_digest"], "left_semi").select(fresh.columns).unionByName(fresh)

    return out.update(change)
