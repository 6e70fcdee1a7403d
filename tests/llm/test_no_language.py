import corpus_pipeline


def test_without_a_taught_language_only_texts_without_letters_go(spark, sf):
    rows = [(1, "a clean text", None), (2, None, None), (3, "12 !!", None), (4, "текст", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.keep_languages(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]
