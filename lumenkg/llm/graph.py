"""Connected components by minimum labels with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkg.llm.common import checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, broadcast_rows: int = 200_000) -> DataFrame:
    """(node, component) for every node of links; component is the smallest node reachable.

    Each round takes the least label among neighbours and then the label of that label,
    so a chain of n nodes needs about log n rounds.  Rows with a null end are ignored;
    loops and repeated links change nothing; no links give an empty table.  Each round is
    written to the checkpoint folder, so the plan does not grow.  Labels are broadcast
    while the links, counted, are at most broadcast_rows (16 bytes each), else joined by
    shuffle; so few links also lie in few partitions.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(one.select("u", F.col("u").alias("v"))).unionByName(one.select("v", F.col("v").alias("u")))
    both = checkpointed(both.distinct())  # each node is its own neighbour, too
    n = both.count()
    few = n <= broadcast_rows
    sent = F.broadcast if few else lambda df: df
    if few:
        both = both.coalesce(1 + n // 25_000)
    labels = both.select(F.col("u").alias("v"), F.col("v").alias("c")).filter("v = c")
    for _ in range(max_rounds):
        lower = both.join(sent(labels), "v").groupBy("u").agg(F.min("c").alias("c"), F.max(F.when(F.col("u") == F.col("v"), F.col("c"))).alias("old"))
        lower = lower.coalesce(1 + n // 25_000) if few else lower
        roots = labels.select(F.col("v").alias("c"), F.col("c").alias("root"))
        after = checkpointed(lower.join(sent(roots), "c").select("u", F.least("c", "root").alias("c"), "old"))
        labels = after.select(F.col("u").alias("v"), "c")
        if after.filter("c != old").isEmpty():
            return labels.select(F.col("v").alias("node"), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
