import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, simhash

from .test_operators import COLUMNS, ODD, closure

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_over_the_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, tiny).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == DOC_COLUMNS
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.op9_quality_cascade(spark, tiny).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "near_dedup":
            assert docs.count() == before.select("doc_id").distinct().count() - (before.count() - docs.count()) and docs.exceptAll(before).isEmpty()
            assert simhash.drop_near_duplicates(docs).count() == docs.count()
        if name == "surrogates":
            assert docs.filter("text rlike '@mail[0-9].example.com'").isEmpty() and docs.count() == before.count()
        if name == "sentencepiece":
            assert docs.filter("not round_trip").isEmpty() and docs.count() == before.count()
    assert 0 < docs.count() <= 2 * first.count()


def test_run_equals_stages(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns[:5] == DOC_COLUMNS and out.agg(F.sum("n_pieces")).first()[0] > 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_input(spark, stage):
    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, spark.createDataFrame([], COLUMNS), "").collect() == []
    extra = spark.createDataFrame(ODD, COLUMNS).withColumn("kept", F.lit("mine")).withColumn("size", F.lit(1))
    rows = f(spark, extra, "")
    assert rows.columns[:7] == [*DOC_COLUMNS, "kept", "size"]
    got = rows.collect()
    assert all((r["kept"], r["size"]) == ("mine", 1) for r in got)  # no column gives way
    name, texts = corpus_pipeline.STAGES[stage][0], [r[1] for r in ODD]
    if name == "quality_rules":
        assert all(r.text and len(r.text.split()) >= 50 for r in got)
    elif name == "near_dedup":  # of the copies one stays, and of null, empty and blank texts
        blank = [r for r in got if not (r.text or "").strip()]
        assert len(blank) == 1 and sorted(r.text for r in got if r not in blank) == sorted({t for t in texts if t and t.strip()})
    elif name == "surrogates":
        assert len(got) == len(ODD) and all((r.text is None) == (r.n_chars is None) and (r.text is None or len(r.text) == r.n_chars) for r in got)
    elif name == "mix":
        assert all(r.text and r.text.strip() for r in got)
    else:
        assert len(got) == len(ODD) and all(r.n_pieces == 0 for r in got if not r.text)


def test_near_dedup_equals_brute_force(spark, tiny):
    """One document of each component of likeness 0.8 stays, the smallest id, and no other goes."""
    docs = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tiny}/documents.parquet"), tiny)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    root = closure([t for _, t in rows])
    want = {i for k, (i, _) in enumerate(rows) if root[k] == k}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want and len(want) < len(rows)
