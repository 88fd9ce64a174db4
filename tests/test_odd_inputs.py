"""Queries on small tables of odd rows, against their SQL."""

import math
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

duckdb = pytest.importorskip("duckdb")

from lumenkg import registry  # noqa: E402


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query over tables, which are equal to those of its SQL on one thread; a list of tables is one of several files."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t, files in tables.items():
        (folder / f"{t}.parquet").mkdir()
        for i, rows in enumerate(files if isinstance(files, list) else [files]):
            pq.write_table(rows, folder / f"{t}.parquet" / f"part-{i}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    cursor = con.execute(registry.oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    rows = Counter(tuple(map(plain, r)) for r in got.select(*names).collect())
    assert rows == want
    return rows


def lines(*rows):
    """Order lines (order, part, supplier, number, quantity, flag, status)."""
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_returnflag l_linestatus".split()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.string()]
    return pa.table({c: pa.array(list(x), k) for c, k, x in zip(columns, kinds, zip(*rows))})


def test_equal_scores_have_no_span(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "a19_max_minmax", lineitem=lines((39, 1, 1, 1, 50.0, "A", "O"), (79, 2, 1, 1, 50.0, "N", "O"), (40, 2, 1, 1, 3.0, "N", "O")))
    assert rows == Counter({("P1", "nan"): 1, ("P2", "nan"): 1})


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["rétion tionè Ètionè", "TİON İthe the", "a_the the_ of-and", "nation attion", None, ""]
    rows = same_as_sql(spark, tmp_path, "a9_mentions", benchmark=pa.table({"item_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    assert rows[("tion", 4)] == 1


def test_repeated_ids_in_the_order_of_the_table(spark, tmp_path):
    rows = [(o, 1, 1, n, 1.0, flag, "O") for flag in "RANARN" for o in range(1, 40) for n in (2, 3, 4)]
    orders = pa.table({"o_orderkey": pa.array(range(40), pa.int64()), "o_custkey": pa.array(range(40), pa.int64()), "o_orderpriority": ["1-URGENT"] * 40})
    found = same_as_sql(spark, tmp_path, "j1_filled_provenance", lineitem=[lines(*rows[:200][::-1]), lines(*rows[200:])], orders=orders)
    assert len(found) == 116  # cue 5 starts at 5.0 either way
