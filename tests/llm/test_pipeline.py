import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, columns = docs, docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = held.count()
        held = corpus_pipeline.stage(step(spark, held, SF), "test")
        assert held.columns == columns and 0 < held.count() <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in held.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
