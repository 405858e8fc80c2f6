"""The stages of the pipeline, each against what its operator decides."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hallmark.llm import decontaminate, queries
from hallmark.llm.tables import step, table

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_columns_and_decide(spark):
    docs = table(spark, FOLDER, "documents")
    extra = docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    docs = step(docs.unionByName(extra).unionByName(docs.limit(3)))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = step(stage(spark, before, FOLDER))
        assert after.schema == docs.schema
        assert after.exceptAll(before).count() == 0
        assert 0.5 * before.count() < after.count() <= before.count()
        if name == "near_duplicates":
            assert after.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(after, table(spark, FOLDER, "benchmark")).count() == 0
            assert after.where("doc_id is null").count() == 1
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert last.count() == before.count() and last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_clean_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    kept = corpus_pipeline.without_toxic(spark, docs, folder).select("doc_id")
    clean = labels.where("toxic = 0").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.97 * clean.count()


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op5_toxicity", "op7_lm_scores"}))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
