"""Titles of books and courses give way to concepts."""

from lumenkg.operators import graph as G


def test_titles_are_demoted(spark):
    names = {
        "离散数学": True,
        "离散数学/discrete maths": True,
        "离散数学基础": True,
        "A book on Discrete Mathematics": True,  # several words count anywhere
        "关于离散数学": False,  # one word counts at the beginning
        "命题逻辑": False,
        "": False,
        None: False,
    }
    ranked = spark.createDataFrame([(n, 2.0) for n in names], "node string, final double")
    got = {r.node: (r.meta_demoted, r.final) for r in G.demote_meta_hubs(ranked).collect()}
    assert got == {n: (yes, 0.7 if yes else 2.0) for n, yes in names.items()}
    assert G.demote_meta_hubs(ranked, ()).filter("meta_demoted").count() == 0
