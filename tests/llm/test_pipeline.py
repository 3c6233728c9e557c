"""The pipeline against its stages applied by hand to a small corpus with planted cases."""

import corpus_pipeline as P
from panelforge.llm import packing


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(2).collect()]
    text = docs.filter("lang = 'en' and length(text) > 1000").first().text
    planted = [(10_001, text + " tail", "en", "s", 1), (10_002, "the of and " + items[0] + " the end", "en", "s", 1), (10_003, "12345 !!! ###", "en", "s", 1), (10_004, None, "en", "s", 1), (10_005, text[:700] + ' with token = "ce0cc631f6559e745b37cb8be6fc63ae2d235c5f" ' + text[900:1000], "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(P.STAGES):
        before = {r.doc_id for r in now.collect()} if k else None
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        after = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns
            ids = [r.doc_id for r in after.collect()]
            assert len(ids) == len(set(ids)) and (before is None or set(ids) <= before)
            gone = {0: {10_003, 10_004}, 1: {10_001}, 2: {10_002}, 3: set()}[k]
            assert not gone & set(ids)
            if k == 3:
                assert set(ids) == before and "[SECRET]" in after.filter("doc_id = 10005").first().text
        now = after
    want = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    got = now.toPandas()
    assert set(got.doc_id) == set(want)
    assert got.length.sum() == sum(len(packing.encode(t, packing.default_tokenizer())) + 1 for t in want.values())
    assert P.run(spark, str(tmp_path)).count() == len(got)
