import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from sylvane.llm import batches, packing, pii, quality_model, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    outputs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        made = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert made.columns == docs.columns, name
        outputs.append((docs, made))
        docs = made
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = outputs[0]
    kept = {r["doc_id"]: r for r in quality_rules.quality_rules(before).where("kept").collect()}
    assert ids(after) == set(kept) and all(r["text"] == kept[r["doc_id"]]["cleaned"] and r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = outputs[1]
    model = quality_model.learn_documents(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = quality_model.document_features(before).select("doc_id", model.score(F.col("x")).alias("s")).where("s >= 0.3")
    assert ids(after) == ids(good)
    before, after = outputs[2]
    assert ids(after) == {r["doc_id"] for r in simhash.near_duplicates(before).collect() if r["doc_id"] == r["component_id"]}
    before, after = outputs[3]
    texts = {r["doc_id"]: r["text"] for r in pii.pseudonymise(before, corpus_pipeline.PSEUDONYM_KEY).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == texts
    before, after = outputs[4]
    assert ids(after) == ids(before)
    assert given and after.count() == corpus_pipeline.run(spark, SF).count()
    assert packing.CAPACITY >= max(r["length"] + r["offset"] for r in after.collect())


def test_stages_take_odd_rows(spark, odd_docs, odd_rows, no_docs):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns, name
        assert stage(spark, no_docs, SF).count() == 0, name
        stage(spark, odd_docs, SF).count()
    assert corpus_pipeline.STAGES[4][1](spark, no_docs, SF).count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, odd_docs, SF).collect()
    ids = [r[0] for r in odd_rows]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in packed if r["piece"] == 0) == sorted(-1 if i is None else i for i in ids)


def test_stages_bound_what_a_task_holds(spark, tmp_path, no_docs):
    """The reader's batches, Arrow's batches in bytes, and row groups; the defaults are 4,096 rows, 64 MB and 128 MB."""
    keys = {"parquet.columnarReaderBatchSize": batches.BATCH_ROWS, "execution.arrow.maxRecordsPerBatch": batches.BATCH_ROWS, "execution.arrow.maxBytesPerBatch": batches.BATCH_BYTES}
    for name, stage in corpus_pipeline.STAGES:
        for key in keys:
            spark.conf.unset(f"spark.sql.{key}")
        stage(spark, no_docs, SF)
        assert {k: int(spark.conf.get(f"spark.sql.{k}").removesuffix("b")) for k in keys} == keys, name
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(800)])
    corpus_pipeline.write(spark.range(0, 600, 1, 1).select("id", text.alias("text")), f"{tmp_path}/w")
    (path,) = tmp_path.glob("w/*.parquet")
    sizes = [pq.ParquetFile(path).metadata.row_group(i).total_byte_size for i in range(pq.ParquetFile(path).metadata.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 1.5 * corpus_pipeline.ROW_GROUP
