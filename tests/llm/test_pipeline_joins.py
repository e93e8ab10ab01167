"""What the pipeline's stages broadcast does not follow the number of documents."""

import corpus_pipeline
from lexiclust.llm import simhash


def test_near_duplicates_stage_broadcasts_no_variants(spark, monkeypatch):
    plans, real = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda e: plans.append(e._jdf.queryExecution().sparkPlan().toString()) or real(e))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i"), (None, None)], "doc_id long, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
