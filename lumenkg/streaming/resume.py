"""Work on chunks that can be broken off and taken up again: finished chunks are kept by key as long as their fingerprint holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["key", "seq", "fingerprint", "chunk", "text"]


def finished_chunks(chunks: DataFrame) -> DataFrame:
    """(key, seq, fingerprint, chunk, text) of chunks, each once: as a batch over a table, or on a stream with state per key.

    A chunk is new if its key has not finished it under the current fingerprint; another
    fingerprint, coming in order of seq, makes all chunks of the key new.  On a stream the state of a key is its fingerprint and the numbers of its finished
    chunks, it survives a restart in the stream's checkpoint folder, and batches are to come in order of seq.
    """
    rows = chunks.select(*COLUMNS)
    if not rows.isStreaming:
        order = Window.partitionBy("key").orderBy("seq")
        turns = rows.withColumn("_new", F.coalesce((~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order))).cast("int"), F.lit(1)))
        runs = turns.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        first = Window.partitionBy("key", "_run", "chunk").orderBy("seq")
        return runs.withColumn("_i", F.row_number().over(first)).filter("_i = 1").select(*COLUMNS)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, done = state.get if state.exists else ("", [])
        seen, started, kept = set(done), state.exists, []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            if not started or r.fingerprint != current:
                current, seen, started = r.fingerprint, set(), True
            if r.chunk not in seen:
                seen.add(r.chunk)
                kept.append(r)
        state.update((current, sorted(seen)))
        yield pd.DataFrame(kept, columns=COLUMNS)

    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return rows.groupBy("key").applyInPandasWithState(step, schema, "fingerprint string, done array<bigint>", "append", GroupStateTimeout.NoTimeout)
