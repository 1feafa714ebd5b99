import corpus_pipeline as C
from twinfold.llm.common import stage, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    for name, f in C.STAGES:
        out = stage(f(spark, docs, sf_dir), f"t-{name}")
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "quality":
            assert sum(labels.get(d) == 0 for d in after) <= 2
            assert sum(labels.get(d) == 1 for d in before - after) <= 2
        if name == "pii":
            assert after == before
        docs = out
    assert docs.filter("epochs < 1 or epochs > 2").count() == 0


def test_stages_take_empty_tables(spark, sf_dir, no_docs):
    docs = no_docs
    for _, f in C.STAGES:
        docs = f(spark, docs, sf_dir)
    assert docs.count() == 0
