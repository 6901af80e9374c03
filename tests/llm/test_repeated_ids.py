from marlstone.llm import simhash


def test_simhash_keeps_unlinked_texts_of_one_id(spark):
    rows = [(1, "a b c d"), (1, "other words here now"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
