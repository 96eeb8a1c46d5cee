"""The pipeline on sf0.001: each stage keeps the columns, does its work and drops nothing else."""

import corpus_pipeline
from cohortlens.llm import near_dup
from cohortlens.llm.common import release, table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == names
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= seen
        if name != "mixing":
            assert len(ids) == len(set(ids))
        if name == "near_duplicates":
            left = near_dup.near_duplicates(out)
            assert left.filter("doc_id <> component_id").count() == 0
        seen, docs = set(ids), out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and {"shard", "slot"} <= set(last.columns)


def test_labels_decide(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, table(spark, SF, "documents"), SF).collect()}
    right = sum((i in kept) == (q == 1) for i, q in labels.items())
    assert right >= 0.85 * len(labels)


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns of other names: kept by stages that find nothing wrong with them."""
    rows = [(None, None, None, None, None, 1, None), (1, "", "en", "a", 0, 2, "x"), (1, "", "en", "a", 0, 2, "x"), (2, "word " * 40_000, None, "b", 5, None, "y"), (3, None, "de", None, None, 3, None), (None, "some text", "en", "a", 9, 4, "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, score string")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(out.columns) - {"slot"} == set(docs.columns)
            assert out.count() <= 3 * docs.count()
    assert corpus_pipeline.decontamination_stage(spark, odd, SF).count() == len(rows)
    assert corpus_pipeline.near_dup_stage(spark, odd, SF).count() == len(rows)
    assert corpus_pipeline.sharding_stage(spark, odd, SF).count() == len(rows)


def test_run_leaves_few_tables_and_its_rows(spark):
    release(spark)
    other = near_dup.stored(spark.range(3), "other")
    once = corpus_pipeline.run(spark, SF)
    rows = sorted((r.shard, r.slot, r.doc_id) for r in once.collect())
    assert other.count() == 3
    names = [p.rsplit("/", 1)[1].rsplit("-", 5)[0] for p in written(spark)]
    assert not {"quality", "near_duplicates", "decontamination", "groups", "edges", "digests"} & set(names)
    again = sorted((r.shard, r.slot, r.doc_id) for r in corpus_pipeline.run(spark, SF).collect())
    assert rows == again and rows
    release(spark)
    assert written(spark) == []
