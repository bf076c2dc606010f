"""The language stage where no row states a language."""

from txnspark.llm import language_id


def test_texts_without_a_letter_go_without_a_model(spark):
    rows = [(1, None), (2, ""), (3, "12 34 --- " * 100), (4, "ein Text"), (None, "日本"), (4, "ein Text")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    out = language_id.keep(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted((tuple(r) for r in docs.where("text LIKE 'ein%' OR text = '日本'").collect()), key=str)
