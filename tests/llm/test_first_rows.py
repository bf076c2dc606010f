"""The near-duplicate stage on repeated rows, null ids and clashing ids: one row of each group."""

from txnspark.llm import ngram_join

DOCS = "doc_id long, text string, lang string"


def prose(seed, n=60):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def kept(spark, rows):
    out = ngram_join.keep_first(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang"]
    return sorted(((r["doc_id"], r["text"], r["lang"]) for r in out.collect()), key=str)


def test_repeated_rows_keep_one(spark):
    a, b = prose(1), prose(2)
    assert kept(spark, [(4, a, "x")] * 3 + [(5, a, "x"), (6, b, "x")]) == [(4, a, "x"), (6, b, "x")]
    (one,) = kept(spark, [(4, a, "x"), (4, a, "y"), (4, a, None)])
    assert one[:2] == (4, a)


def test_null_ids_keep_one_of_each_text(spark):
    a, b, near = prose(1), prose(2), prose(1) + " end"
    assert kept(spark, [(None, a, "x")] * 4 + [(None, b, "x"), (None, b, "x")]) == [(None, a, "x"), (None, b, "x")]
    assert kept(spark, [(None, a, "x"), (9, near, "x")]) == [(9, near, "x")]
    assert len(kept(spark, [(None, a, "x"), (None, near, "x")])) == 1


def test_clashing_ids_keep_the_text_that_nothing_stands_for(spark):
    a, b = prose(1), prose(2)
    assert kept(spark, [(1, a, "x"), (2, a + " end", "x"), (2, b, "x")]) == [(1, a, "x"), (2, b, "x")]
    # Two texts of one number do not tie their groups together.
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x")]
    assert kept(spark, rows) == [(1, a, "x"), (2, b, "x")]


def test_rows_without_words_stay(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, " \n", "x"), (None, " \n", "x"), (2, "", "x")]
    assert len(kept(spark, rows)) == len(rows)
