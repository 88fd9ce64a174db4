"""Sources, service semantics, hooks and streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenkg.operators import hooks, service
from lumenkg.operators.similarity import similar_pairs
from lumenkg.sources import exports, files
from lumenkg.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"segment_id":"s1","start_sec":1.5}\n\n{"cue_id":"c2","lecture_id":"2"}\n')
    assert {r.cue_id for r in files.read_cues(spark, str(tmp_path / "c.jsonl")).collect()} == {"s1", "c2"}
    (tmp_path / "t.jsonl").write_text('{"h":"a","t":"b"}\n{"subject":"c","object":"d"}\n')
    assert {(r.subject, r.object) for r in files.read_triplets(spark, str(tmp_path / "t.jsonl")).collect()} == {("a", "b"), ("c", "d")}
    (tmp_path / "x.srt").write_text("1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n2\n00:00:03,0 --> 00:00:04,0\nBye\n")
    cues = files.read_srt(spark, str(tmp_path / "x.srt"))
    assert [(r.start_sec, r.end_sec, r.text) for r in cues.orderBy("pos").collect()] == [(1.5, 2.0, "Hello there"), (3.0, 4.0, "Bye")]
    assert files.srt_lines(cues).orderBy("pos").first().value == "1\n00:00:01,000 --> 00:00:02,000\nHello there\n"
    (tmp_path / "n.txt").write_text("01:00\n\n00:30\n01:00\nx\n")
    assert [r.sec for r in files.read_time_nodes(spark, str(tmp_path / "n.txt")).collect()] == [30.0, 60.0]


def test_importance_shapes(spark, tmp_path):
    shapes = {"map": '{"a": 1, "b": 0.5}', "pairs": '[["a", 1], ["b", 0.5]]', "records": '[{"name": "a", "score": 1}, {"entity": "b", "importance": 0.5}]', "bundle": '{"global": {"a": 1, "b": 0.5}, "chapters": {"c1": {"a": 2}}}'}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
        got = {(r.entity, r.chapter, r.score) for r in files.importance_rows(spark, str(tmp_path / name)).collect()}
        assert {("a", None, 1.0), ("b", None, 0.5)} <= got and (("a", "c1", 2.0) in got) == (name == "bundle")


def test_textbook_graph(spark):
    e = spark.createDataFrame([("a", "d", 0.2), ("z", "d", 0.4)], "name string, definition string, importance double")
    r = spark.createDataFrame([("a", "part_of", "b"), ("a", "part_of", "b")], "subject string, predicate string, object string")
    i = spark.createDataFrame([("a", None, 0.9), ("a", "c", 0.1)], "entity string, chapter string, score double")
    nodes, edges = files.textbook_graph(e, r, i)
    assert {x.name: x.importance for x in nodes.collect()} == {"a": 0.9, "b": None, "z": 0.4} and edges.count() == 1


def test_fusion_and_edits(spark):
    n = spark.createDataFrame([("c", "base", "1", "Set", None, "set"), ("c", "video", "v1", "SET ", None, None), ("c", "base", "2", "Map", "映射", None)], "course string, view string, id string, name string, zh_name string, en_name string")
    e = spark.createDataFrame([("c", "video", "v1", "v1", "r"), ("c", "base", "1", "2", "r")], "course string, view string, source string, target string, relation string")
    nodes, edges = service.fuse(n, e)
    assert {(x.id, x.name, tuple(x.views)) for x in nodes.collect()} == {("1", "SET ", ("base", "video")), ("2", "Map", ("base",))}
    assert [(x.source, x.target) for x in edges.collect()] == [("1", "2")]
    left, rest = service.delete_nodes(n, e, n.filter("id = '2'"))
    assert left.count() == 2 and rest.count() == 1
    more = spark.createDataFrame([("c", "base", "2", "1", "s"), ("c", "base", "1", "9", "s")], e.schema)
    assert service.add_edges(e, more, n).count() == 2  # the pair has an edge, and 9 does not exist
    moved, ends = service.rename_nodes(n, e, spark.createDataFrame([("c", "base", "1", "one")], "course string, view string, id string, new_id string"))
    assert {x.id for x in moved.collect()} == {"one", "v1", "2"} and ("one", "2") in {(x.source, x.target) for x in ends.collect()}
    p = spark.createDataFrame([("admin", "c", [], []), ("t", "c", [], ["c"]), ("s", "c", ["c"], []), ("s", "c", [], []), (None, "c", [], [])], "role string, course string, r array<string>, w array<string>")
    assert [x.p for x in p.select(service.permission(F.col("role"), F.col("course"), F.col("r"), F.col("w")).alias("p")).collect()] == ["RW", "RW", "RO", "L", "U"]


def test_exports_escape(spark):
    e = spark.createDataFrame([('a"<b', "r", "c&d")], "subject string, relation string, object string")
    assert exports.graphml_edges(e).first().line == '<edge source="a&quot;&lt;b" target="c&amp;d"><data key="relation">r</data></edge>'
    assert exports.cypher_statements(e).first().statement == 'MERGE (a:Entity {name: "a\\"<b"}) MERGE (b:Entity {name: "c&d"}) MERGE (a)-[:R]->(b);'


def test_hooks(spark):
    hits = spark.createDataFrame([(1, 1, "First. More", 0.9), (1, 2, "Second", 0.1), (2, 1, "Low", 0.01)], "qid int, doc_id int, text string, score double")
    out = {r.qid: r for r in hooks.answer_questions(spark, hits, least=0.05).collect()}
    assert out[1].answer == "First." and out[1].context == "First. More\n\n---\n\nSecond" and out[2].verdict == "unsupported"
    kept = hooks.filter_by_hook(hits, lambda b: (b["score"] > 0.5).tolist(), "qid")
    assert {(r.qid, r.doc_id) for r in kept.collect()} == {(1, 1), (2, 1)}
    assert hooks.fill("a {x} {y}", {"x": 1}) == "a 1 {y}"


def test_similar_pairs_across_tiles(spark):
    rows = [(i, i % 2, [1.0, 0.0] if i % 4 < 2 else [0.0, 1.0]) for i in range(40)]
    got = similar_pairs(spark.createDataFrame(rows, "id long, g int, v array<double>"), "id", "g", "v", 0.9, tile_rows=3)
    want = {(a, b) for a, g, v in rows for b, h, w in rows if a < b and g == h and v == w}
    pairs = [(r.a, r.b) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(hours=7 * i), i % 3, "error" if i % 2 else "view") for i in range(60)]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[-5:], schema).coalesce(1).write.mode("append").parquet(src)  # again, late
    stream = spark.readStream.schema(schema).parquet(src)
    ingest.run_once(ingest.windowed_feedback(ingest.deduplicated(stream), late=None), str(tmp_path / "out"), str(tmp_path / "cp"))
    done = spark.read.schema("start timestamp, user_id long, n long, weight double").parquet(str(tmp_path / "out"))
    batch = {tuple(r) for r in ingest.windowed_feedback(ingest.deduplicated(spark.read.parquet(src))).collect()}
    got = {tuple(r) for r in done.collect()}
    assert got and got <= batch and len(got) >= len(batch) - 12  # the last windows wait for the watermark


def test_stream_upsert(spark, tmp_path):
    schema = "segment_id string, lesson_id int, text string, seq long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    for k, part in enumerate([[("a", 1, "x", 1), ("b", 2, "y", 2)], [("a", 1, "z", 3), ("c", 1, " ", 4)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_chunks(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp"))
    assert {(r.segment_id, r.text) for r in spark.read.parquet(out).collect()} == {("a", "z"), ("b", "y")}
