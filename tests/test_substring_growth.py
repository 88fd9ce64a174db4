"""Names sought in texts: what moves are keys that names begin with, not all letters of all texts."""

from lumenkg.operators import course as O
from tests.test_subgraph_growth import shuffled_rows


def test_letters_are_not_moved(spark):
    texts = spark.range(200).selectExpr("id", "array_join(transform(sequence(1, 400), i -> conv(pmod(xxhash64(id, i), 1000000007), 10, 36)), '') || IF(id % 4 = 0, ' ring', '') AS t").localCheckpoint()
    names = spark.createDataFrame([(" ring",), ("ring",), ("",), ("(",)], "alias string")
    found, rows = shuffled_rows(spark, lambda: O.substring_join(texts, names, "t", "alias").select("id", "alias").collect(), "10m")
    assert sorted(map(tuple, found)) == sorted([(i, "") for i in range(200)] + [(i, n) for i in range(0, 200, 4) for n in (" ring", "ring")])
    assert rows < 5000, rows
