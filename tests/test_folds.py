"""Folds and literals: the cases of the fixture list, re-typed."""

import math

import pytest
from pyspark.sql import functions as F

from lumenkg.functions import rules as V
from lumenkg.functions import text as T
from lumenkg.operators import entities as E
from lumenkg.operators import folds
from lumenkg.operators import graph as G
from lumenkg.operators import intervals as I
from lumenkg.operators import scoring as S
from lumenkg.operators.align import increasing


def cue(start, end, text="a long sentence that is complete and closed.", page=0):
    return {"lecture": "1", "cue": f"{start}", "start_sec": start, "end_sec": end, "text": text, "page": page}


def test_absorb_takes_the_nearer_neighbour():
    out = folds.absorb_short([cue(0.0, 20.0), cue(20.2, 23.5, "short"), cue(24.0, 50.0)])
    assert [(c["start_sec"], c["end_sec"]) for c in out] == [(0.0, 23.5), (24.0, 50.0)]


def test_merge_respects_gap_and_length():
    assert folds.should_merge(cue(0.0, 5.0, "and then"), cue(6.0, 9.0))
    assert not folds.should_merge(cue(0.0, 5.0, "and then", 0), cue(6.0, 9.0, page=1))
    assert not folds.should_merge(cue(0.0, 100.0, "and then"), cue(101.0, 125.0))


def test_windows_overlap_by_half():
    w = folds.char_windows([10] * 10, 40)
    assert w[0] == (0, 4) and w[-1][1] == 10 and all(b > a + 1 for a, b in w[:-1]) and all(y[0] > x[0] for x, y in zip(w, w[1:]))


def test_alignment_skips_and_keeps_order():
    assert folds.monotone_align([[0.9, 0.0, 0.0], [0.0, 0.0, 0.8]]) == [(0, 0), (1, 2)]
    assert folds.monotone_align([]) == []
    assert increasing([(1, 5), (2, 1), (3, 2), (4, 9)]) == [(2, 1), (3, 2), (4, 9)]


def test_learning_path_puts_prerequisites_first_and_survives_cycles():
    assert folds.learning_path([(1, "c"), (2, "a"), (3, "b")], [("a", "c"), ("b", "a")]) == ["b", "a", "c"]
    assert sorted(folds.learning_path([(1, "a"), (2, "b")], [("a", "b"), ("b", "a")])) == ["a", "b"]


def test_strip_repeated_start():
    assert folds.strip_repeated_start("we talked about sets and maps", "sets and maps are related") == "are related"
    assert folds.strip_repeated_start("sets and maps", "sets and maps") == "sets and maps"


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    "c, want",
    [
        (lambda: T.clean_text(F.lit("谓词 Logic-1 é")), "谓词logic1"),
        (lambda: T.tokens(F.lit("谓词 Logic_1")), ["谓", "词", "logic", "1"]),
        (lambda: T.bm25_tokens(F.lit("谓词逻 a")), ["谓", "词", "逻", "a", "谓词", "词逻"]),
        (lambda: T.hms(F.lit(3725.9)), "01:02:05,000"),
        (lambda: T.seconds_of(F.lit("01:02:05,5")), 3725.5),
        (lambda: T.seconds_of(F.lit("x")), None),
        (lambda: T.primary_name(F.lit("谓词/predicate")), "谓词"),
        (lambda: T.sample_time(F.lit(0.0), F.lit(100.0)), 97.0),
        (lambda: T.sample_time(F.lit(100.0), F.lit(103.0)), 102.0),
        (lambda: T.sample_time(F.lit(339.5), F.lit(773.0)), 770.0),
        (lambda: T.contains_ignoring_space(F.lit("a b"), F.lit("")), True),
        (lambda: T.contains_ignoring_space(F.lit("a b"), F.lit(""), empty=False), False),
        (lambda: V.normal_relation(F.lit("Is A")), "belong_to"),
        (lambda: V.bad_entity(F.lit("f(x)")), True),
        (lambda: V.overly_specific(F.lit("定理 3.1")), True),
        (lambda: I.overlap(F.lit(10.0), F.lit(20.0), F.lit(15.0), F.lit(25.0)), 5.0),
        (lambda: E.name_parts(F.lit("谓词 逻辑/predicate logic"))["en"], "predicate logic"),
        (lambda: E.name_parts(F.lit("命题 1"))["zh"], "命题1"),
        (lambda: E.name_parts(F.lit("a/b/c/d"))["zh"], "a/b"),
    ],
)
def test_literals(spark, c, want):
    assert one(spark, c()) == want


def test_longest_match(spark):
    got = one(spark, S.longest_mentions(F.lit("一阶谓词逻辑中的谓词"), ["谓词逻辑", "谓词", "逻辑"]))
    assert got == ["谓词逻辑", "谓词"]


def test_debounce_and_union(spark):
    b = spark.createDataFrame([("l", float(x)) for x in (781, 785, 807, 811, 893)], "lecture string, ts double")
    assert sorted(r.ts for r in I.debounce(b, "lecture", "ts", 20.0).collect()) == [781.0, 807.0, 893.0]
    w = spark.createDataFrame([("l", 1, 0.0, 5.0), ("l", 2, 4.0, 9.0), ("l", 3, 12.0, 15.0), ("l", 4, 15.5, 18.0)], "g string, i int, s double, e double")
    spans = lambda gap: sorted((r.start_sec, r.end_sec) for r in I.union_intervals(w, "g", "s", "e", gap, "i").collect())
    assert spans(0.0) == [(0.0, 9.0), (12.0, 15.0), (15.5, 18.0)] and spans(0.5) == [(0.0, 9.0), (12.0, 18.0)]


def test_range_join_reports_each_pair_once(spark):
    a = spark.createDataFrame([("l", 1, 80.0, 120.0), ("l", 2, 95.0, 210.0)], "g string, c int, l_start double, l_end double")
    b = spark.createDataFrame([("l", i, 100.0 * i, 100.0 * (i + 1)) for i in range(4)], "g string, p int, r_start double, r_end double")
    for width in (7.0, 50.0, 1000.0):
        assert sorted((r.c, r.p) for r in I.range_join(a, b, "g", width).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_names_and_synonyms(spark):
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "subject string, object string")
    best = spark.createDataFrame([("B",)], "name string")
    assert {(r.alias, r.canonical) for r in E.synonym_map(pairs, best).collect()} == {("A", "B"), ("C", "B")}
    n = spark.createDataFrame([("命题逻辑/propositional logic",), ("命题逻辑/Propositional Logic",)], "name string")
    assert [(r.alias, r.canonical) for r in E.string_map(n).collect()] == [("命题逻辑/propositional logic", "命题逻辑/Propositional Logic")]


def test_graph_rules(spark):
    e = spark.createDataFrame([("A", "B"), ("C", "D"), ("D", "E"), ("E", "C"), ("F", "G"), ("G", "H"), ("H", "I")], "subject string, object string")
    assert {(r.subject, r.object) for r in G.long_components(e).collect()} == {("F", "G"), ("G", "H"), ("H", "I")}
    parts = {r.node: r.component for r in G.components(e).collect()}
    assert parts["E"] == "C" and parts["I"] == "F" and parts["B"] == "A"
    w = e.withColumn("weight", F.lit(1.0))
    assert math.isclose(sum(r["rank"] for r in G.pagerank(w, 5).collect()), 1.0, rel_tol=1e-9)
    core = {r.node: r.core for r in G.core_numbers(e).collect()}
    assert core["C"] == 2 and core["A"] == 1 and core["G"] == 1


def test_pages_from_boundaries(spark):
    b = spark.createDataFrame([("l", 0.0), ("l", 100.0), ("l", 100.5), ("l", 200.0)], "g string, t double")
    assert [(r.page, r.start_sec, r.end_sec) for r in I.boundaries_to_pages(b, "g", "t", 1.0).orderBy("page").collect()] == [(0, 0.0, 100.0), (1, 100.5, 200.0)]
