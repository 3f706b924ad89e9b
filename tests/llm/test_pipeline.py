import corpus_pipeline
from lorequarry.llm import decontaminate, quality, rules
from test_jaccard import slow_components

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {r.doc_id for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    classified = corpus_pipeline.classify(spark, docs, SF)
    assert {r.doc_id for r in classified.collect()} == ids & good and classified.columns == docs.columns
    ruled = corpus_pipeline.apply_rules(spark, classified, SF)
    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in rules.judge(classified).collect() if r.kept}
    single = corpus_pipeline.drop_near_duplicates(spark, ruled, SF)
    rows = sorted((r.doc_id, r.text) for r in ruled.collect())
    firsts = {}
    for (i, _), root in zip(rows, slow_components([t for _, t in rows]), strict=True):
        firsts.setdefault(root, i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(firsts.values())
    clean = corpus_pipeline.decontaminate_stage(spark, single, SF)
    leaked = {r.doc_id for r in decontaminate.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    assert clean.columns == docs.columns
    out = corpus_pipeline.encode(spark, clean, SF).collect()
    assert len(out) == clean.count() and all(r.round_trip for r in out)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()


def test_rows_of_null_and_repeated_id_are_judged_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    from pyspark.sql import functions as F

    for shared in (None, 5):
        same = docs.withColumn("doc_id", F.lit(shared).cast("long"))
        texts = sorted(r.text for r in docs.collect() if judged[r.doc_id])
        assert sorted(r.text for r in corpus_pipeline.apply_rules(spark, same, SF).collect()) == texts
        leaked = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        texts = sorted(r.text for r in docs.collect() if r.doc_id not in leaked)
        assert sorted(r.text for r in corpus_pipeline.decontaminate_stage(spark, same, SF).collect()) == texts
    texts = sorted(r.text for r in docs.collect() if r.doc_id in good)
    assert sorted(r.text for r in quality.good_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()) == texts
