import corpus_pipeline
from leafmill.llm import decontam, pii
from leafmill.llm.common import materialize, table

from .test_copies import brute_kept


def test_stages_and_their_effects(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tiny))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and docs.count() == len(after)
        if name == "language":
            assert len(after) > 0.97 * len(before)
        if name == "near_duplicates":
            # One of each component of similarity 0.8 stays, which exact copies and what operator 10 links are among.
            assert sorted(after) == brute_kept(list(before), [r.text for r in before.values()])
            assert len({r.text for r in after.values()}) == len(after)
        if name == "decontamination":
            assert not decontam.scan(docs, table(spark, tiny, "benchmark")).where("contaminated").take(1)
            clean = {r.doc_id for r in decontam.scan(spark.createDataFrame(list(before.values()), docs.schema), table(spark, tiny, "benchmark")).where("not contaminated").collect()}
            assert clean <= set(after) and all(after[i].text == before[i].text for i in clean)
        if name == "personal_data":
            assert set(after) == set(before)
            found = pii.find(docs)
            assert found.where("n_email + n_ip + n_card + n_phone > 0").count() == 0
        before = after
    assert 0.2 < len(after) / table(spark, tiny, "documents").count() < 0.95


def test_run_equals_its_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tiny))
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, tiny).collect()))


def test_odd_documents(spark, tiny, docs, odd):
    df = docs(odd, extra=True)
    for _, stage in corpus_pipeline.STAGES:
        for given in (df, df.where("false"), df.union(df)):
            out = stage(spark, given, tiny)
            assert out.columns == df.columns
            out.collect()
