"""Lines above limits leave the texts, and the pipeline's quality stage hands on what is left."""

from lumenkg.llm.quality import QualityRules, clean_documents, judge_documents
from lumenkg.llm.stages import quality_stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BOILER = "Subscribe to our news letter today"


def own(i):
    return " ".join(f"word{i}x{j}" for j in range(12))


def site(n=30, host="a"):
    return [(i, f"{own(i)}\n\n {BOILER.upper() if i % 2 else BOILER} \nlast line of {i}", "en", host, 5) for i in range(n)]


def test_stage_removes_lines_above_the_limit(spark):
    rows = site() + [(None, site()[0][1], "en", "a", 5), (100, f"{own(100)}\n{BOILER}", "en", None, 7), (101, f"short\n{BOILER} " + BOILER, "en", "a", 5), (102, f"a b c d e f\n{BOILER}", "en", "a", 5), (103, own(103), "en", "a", 999)]
    out = quality_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.schema["n_chars"].dataType.simpleString() == "bigint"
    for i in range(30):
        assert got[i].text == f"{own(i)}\n\nlast line of {i}" and got[i].n_chars == len(got[i].text)
    assert got[None].text == got[0].text
    assert got[100].text == rows[31][1] and got[100].n_chars == 7  # another host, below its limit
    assert got[103].n_chars == 999 and 102 not in got  # only 6 words remain of 102
    assert len(got) == 33  # 101 repeats itself


def test_count_above_which_a_line_is_hot_in_any_host(spark):
    rows = site(40) + [(1000 + i, own(1000 + i), "en", "a", 5) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert judge_documents(spark, docs, QualityRules()).filter("n_removed_words > 0").count() == 0
    hot = {r.doc_id: r.text for r in clean_documents(spark, docs, QualityRules(line_max_docs=30)).collect()}
    assert hot[3] == f"{own(3)}\n\nlast line of 3" and len(hot) == len(rows)
