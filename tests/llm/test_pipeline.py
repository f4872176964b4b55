from pyspark.sql import functions as F


def test_pipeline_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema)
    kept = docs.unionAll(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in kept.select("doc_id").collect()}
        kept = corpus_pipeline.saved(stage(spark, kept, sf))
        assert kept.columns == docs.columns, name
        assert {r[0] for r in kept.select("doc_id").collect()} <= before
    assert kept.where(F.col("text").isNull()).count() <= 1
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
