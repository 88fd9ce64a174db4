"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import os
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Used only where spark.checkpoint.dir is unset and driver and executors are one process, as in tests on local[n].
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/lumenkg"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make checkpoint() usable.

    The checkpoint folder is the one the cluster names in spark.checkpoint.dir; a local
    one is set only where that setting is absent on local[n], elsewhere its absence is an error.
    """
    spark.sparkContext.environment["PYTHONPATH"] = REPO_ROOT
    spark.sparkContext.environment["TOKENIZERS_PARALLELISM"] = "false"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not shared and not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or LOCAL_CHECKPOINT_DIR)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: lineage is cut, lost executors lose nothing.

    Shuffle files of the lineage just cut stay until the driver collects its garbage, so
    it is asked to: iterative operators would fill the executors' disks otherwise.
    """
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, for tables that an operator writes."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/lumenkg-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_folder() gave, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of_id(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus: the fold of a row (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def in_bucket(id_col: str, modulus: int, bucket: int) -> Column:
    """Whether a row is in a fold; rows with a null id are in none."""
    return F.coalesce(bucket_of_id(id_col, modulus) == bucket, F.lit(False))


def fresh_name(wanted: str, taken: list[str]) -> str:
    """A column name that taken does not hold, whatever the case of its letters."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def within_bytes(sample: DataFrame, text: str, key: str, max_bytes: int) -> DataFrame:
    """A sample that is bounded in rows, thinned by a hash of the key until its texts take about max_bytes; longer single texts are left out."""
    fits = sample.filter(F.octet_length(text) <= max_bytes)
    total = fits.agg(F.sum(F.octet_length(text))).first()[0] or 0
    share = F.lit(1_000_000 * max_bytes // max(total, 1))
    return fits if total <= max_bytes else fits.filter(F.pmod(F.xxhash64(F.lit(5), F.col(key)), F.lit(1_000_000)) < share)


def fitted_in_task(sample: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """fit(rows, sorted) of a sample that is bounded in rows and bytes, run by one task: the driver gets the fitted model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])
