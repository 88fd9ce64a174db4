"""Every label is learned, however many there are."""

from lumenkg.llm.langid import LanguageRules, fit_languages, training_sample


def test_rare_label_beyond_the_bound_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 9)} text{chr(97 + i % 9)} " * 5, f"l{i % 9}") for i in range(90)] + [(900, "seldom seen words " * 5, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for rules in (LanguageRules(max_languages=3), LanguageRules(max_languages=3, docs_per_language=1)):
        sample = training_sample(docs, rules, "text", "lang", "doc_id")
        assert {lang for lang, _ in sample} == {f"l{i}" for i in range(9)} | {"rare"}
        assert set(fit_languages(sample, rules).labels) == {lang for lang, _ in sample}
