"""Histories hold whole turns."""

from lumenkg import registry


def test_long_turns_stay_whole(spark, tmp_path):
    long = "a question that is much longer than forty characters, " * 3
    rows = [(1, 1, "user", long), (1, 2, "assistant", "yes"), (1, 3, "user", "x"), (1, 4, "user", "y"), (1, 5, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.history for r in registry.queries()["r7_history_window_all"](spark, str(tmp_path)).collect()}
    assert got[1] == "" and got[3] == f"user: {long} / assistant: yes" and got[5] == "assistant: yes / user: x / user: y"
