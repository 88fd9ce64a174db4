"""Learning paths read the lines of orders once and move numbers."""

import pyarrow as pa
import pyarrow.parquet as pq

from lumenkg import registry
from tests.test_odd_inputs import lines
from tests.test_subgraph_growth import shuffled_rows


def test_lines_are_sorted_once(spark, tmp_path):
    chains = [(40 * i + lecture, 3 * i + n, 1, n, 1.0, "A", "O") for i in range(500) for lecture in (0, 1) for n in (1, 2, 3)]  # part 3i + 1 comes before 3i + 2, that before 3i + 3
    pq.write_table(lines(*chains), tmp_path / "lineitem.parquet")
    sizes = [50 if i % 3 == 1 else 1 for i in range(1502)]
    pq.write_table(pa.table({"p_partkey": pa.array(range(1502), pa.int64()), "p_size": pa.array(sizes, pa.int32()), "p_name": ["x"] * 1502}), tmp_path / "part.parquet")
    found, rows = shuffled_rows(spark, lambda: registry.queries()["w16_learning_path"](spark, str(tmp_path)).collect(), "10m")
    place = {(r.lecture, r.node): r.place for r in found}
    assert sorted(place) == sorted((f"L{k}", f"L{k}:P{i}") for k in (0, 1) for i in range(1, 1501))
    assert all(sorted(r.place for r in found if r.lecture == k) == list(range(1, 1501)) for k in ("L0", "L1"))
    assert all(place[k, f"{k}:P{3 * i + n}"] < place[k, f"{k}:P{3 * i + n + 1}"] for k in ("L0", "L1") for i in range(500) for n in (1, 2))
    assert rows <= 13_000, rows  # 3,000 lines once, 3,000 nodes and 2,000 links made distinct, and both by lecture
