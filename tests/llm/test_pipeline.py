"""The pipeline's stages on small tables against what each has to keep."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for n, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / str(n))
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if n + 1 < len(pipeline.STAGES):
            assert docs.columns == columns, name
        kept = [r.doc_id for r in docs.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= set(before), name
        if name == "decontamination":
            assert {i for i, t in before.items() if any(x in t for x in items)} == set(before) - set(kept)
        elif name == "near_duplicates":
            assert len({before[i] for i in kept}) == len(kept)
            assert {min(i for i, t in before.items() if t == u) for u in {before[i] for i in kept}} == set(kept)
        elif name == "encoding":
            assert len(kept) == len(before)
        else:
            assert len(kept) > 0.85 * len(before)


def test_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).withColumn("leaks_found", F.lit("own"))
    odd = docs.limit(4).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    mixed = docs.unionByName(odd).unionByName(docs.limit(1).withColumn("text", F.lit("")))
    for _, stage in pipeline.STAGES:
        assert stage(spark, mixed, SF).count() > 0
        assert stage(spark, mixed.limit(0), SF).count() == 0
