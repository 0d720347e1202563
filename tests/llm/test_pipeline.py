import corpus_pipeline as pipeline

from longweft.llm import langid, minhash_dedup, quality_rules
from tests_llm_helpers import removed_words, texts_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), list(pipeline.COLUMNS)
    seen = []
    for name, stage in pipeline.STAGES:
        out = pipeline.spool(stage(spark, docs, SF), "t")
        seen.append((name, docs, out))
        docs = out
    assert all(out.columns == columns for _, _, out in seen[:-1])
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    (_, a0, a1), (_, _, b1), (_, _, c1), (_, _, d1), (_, _, e1) = seen
    model = langid.train(a0)
    assert ids(a1) == ids(langid.identify(a0, model).filter("NOT rejected"))
    assert ids(b1) == ids(quality_rules.quality_rules(a1).filter("kept"))
    assert ids(c1) == ids(minhash_dedup.near_duplicates(b1).filter("kept"))
    want = removed_words(texts_of(c1), 13)
    assert {i: t.split() for i, t in texts_of(d1)} == want and ids(d1) == ids(c1)
    assert ids(e1) == ids(d1) and 0 < len(ids(c1)) < len(ids(a0))
