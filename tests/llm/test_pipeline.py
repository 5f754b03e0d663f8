"""The stages on a small table, each against a plain computation where it is short, else against what it must keep."""

from collections import Counter

import corpus_pipeline as P
import __spark_entry__
from genoquill.llm import quality_classifier
from genoquill.llm.common import materialize

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, D), "stage")
        seen.append(docs.count())
        ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if name != P.STAGES[-1][0]:
            assert docs.columns == names
        if stage is P.quality:
            labels = spark.read.parquet(f"{D}/labels.parquet")
            assert ids(docs) == {r.doc_id for r in quality_classifier.score(before, labels).where("predicted = 1").select("doc_id").collect()}
        if stage is P.near_duplicates:
            assert docs.count() == len(ids(docs))
            texts = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
            first = {}
            for i in sorted(texts):
                first.setdefault(texts[i], i)
            assert ids(docs) <= set(first.values())
        if stage is P.mixture:
            n = Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert set(n) == ids(before) and max(n.values()) <= 3
    last = docs.collect()
    assert seen[-1] == seen[-2] and all(r.lossless and r.n_pieces == len(r.ids) for r in last)
    assert P.ORACLE_SQL is None and "pipeline" in __spark_entry__.queries()
    assert {r.doc_id for r in P.run(spark, D).select("doc_id").collect()} == {r.doc_id for r in last}
