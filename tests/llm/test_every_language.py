"""Every language of the labelled rows is learned, and the pipeline keeps documents it is unsure of."""
from pyspark.sql import functions as F

import corpus_pipeline
from prismtab.llm import langid


def test_more_than_64_languages(spark):
    rows = [(f"l{i:02d}", f"{chr(0x4E00 + 40 * i)} {n}") for i in range(70) for n in range(3 if i else 1)]
    rows += [("l00", "one text many times")] * 1000
    network = langid.train(spark.createDataFrame(rows, "lang string, text string"), steps=1)
    assert network.languages == [f"l{i:02d}" for i in range(70)]


def test_unsure_documents_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, "word"), (2, "a", "other"), (3, "b", "42"), (4, None, None)], "doc_id long, lang string, text string")
    monkeypatch.setattr(langid, "identify", lambda rows, network: rows.withColumns(
        {"lang_pred": F.when(F.col("doc_id") <= 2, "c").otherwise("und"), "score": F.lit(0.02)}))
    kept = corpus_pipeline.language(spark, docs, "")
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, "c"), (2, "a")]
