"""Overlaps of every length are stripped."""

from lumenkg import registry
from lumenkg.operators.folds import strip_overlap

REST = " Now something quite new is told, longer than what was said."


def test_longest_overlap_of_any_length():
    said = "We look at predicates and their truth sets"
    for n in (8, 9, 25, len(said)):
        start = said[-n:].strip()
        if len("".join(start.split())) >= 8:
            assert strip_overlap(start + REST, "Before. " + said) == (REST.strip(), start)
    assert strip_overlap("truth sets, and more of the same in this text", "all  truth\nsets,") == ("and more of the same in this text", "truth sets,")
    assert strip_overlap("short x and more words", "short x")[1] == ""  # six characters
    assert strip_overlap(said, said) == (said, "") and strip_overlap(None, "a") == ("", "")


def test_cut_snaps_to_a_sentence_and_keeps_most():
    assert strip_overlap("abcdefgh. abcdefgh. ab" + REST, "x abcdefgh. abcdefgh.")[1] == "abcdefgh. abcdefgh."
    assert strip_overlap("abcdefghijklmnopqrst uv", "abcdefghijklmnopqrst") == ("abcdefghijklmnopqrst uv", "")  # beyond 55 %, no sentence end


def test_query_strips_turns(spark, tmp_path):
    rows = [(1, 1, "user", "this is how the long turn ends"), (1, 2, "user", "the long turn ends" + REST), (2, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.n, r.text) for r in registry.queries()["w15_strip_overlap_full"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): (0, rows[0][3]), (1, 2): (18, REST.strip()), (2, 1): (0, "")}
