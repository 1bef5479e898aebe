"""The pipeline stage by stage: columns, clean documents, and effects."""
from pyspark.sql import functions as F

import corpus_pipeline
from prismtab.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name == "language":
            assert docs.count() >= 0.98 * before.count()
        if name == "private_data":
            assert docs.count() == before.count() and docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
        if name == "mix":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.count() == docs.count()


def test_stages_on_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0
