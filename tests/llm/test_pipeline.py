import corpus_pipeline
from pathloom.llm import decontam, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels[d] == 0 for d in kept & set(labels)) < sum(v == 0 for v in labels.values())
    assert sum(labels[d] == 1 for d in kept & set(labels)) >= 0.95 * sum(labels.values())
    spoken = corpus_pipeline.language(spark, docs, SF)
    assert spoken.columns == docs.columns and spoken.count() >= 0.9 * docs.count()
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    classes = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == classes
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    leaks = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - leaks


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (None, "words in a text", "en", "a", 3, None), (None, "words in a text", "en", "a", 3, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, df, SF)
            assert name == "packing" or got.columns == df.columns
            got.count()
