"""Exact cosine pairs within a block, by tiles of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_pairs(rows: DataFrame, key: str, block: str, vector: str, least: float, tile_rows: int = 2048) -> DataFrame:
    """(a, b, similarity) of pairs a < b of one block whose inner product reaches least (unit vectors).

    A block of n rows becomes tiles of about tile_rows; every two tiles meet in a task of
    their own, so no task holds a block, and only pairs above the bound leave it.
    """
    sizes = rows.groupBy(block).agg(F.ceil(F.count("*") / tile_rows).alias("tiles"))
    dealt = rows.join(sizes, block).select(F.col(key).alias("id"), F.col(block).alias("g"), F.col(vector).alias("v"), "tiles", F.pmod(F.xxhash64(key), F.col("tiles")).alias("t"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))).select("g", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "id", "v", "t")

    def score(group: pa.Table) -> pa.Table:
        ids, tile = group.column("id").to_numpy(), group.column("t").to_numpy()
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        i, j = np.nonzero(v[left] @ v[right].T >= least)
        a, b = ids[left[i]], ids[right[j]]
        keep = a < b if x == y else a != b
        s = (v[left[i[keep]]] * v[right[j[keep]]]).sum(axis=1)
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s})

    return met.groupBy("g", "x", "y").applyInArrow(score, "a long, b long, similarity double")
