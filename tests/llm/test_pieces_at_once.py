"""The pipeline's last stage encodes and decodes in one pass of one worker, with the results of the two passes."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import kernels, pieces

TEXTS = [None, "", " ", "Hello  world\nx ▁ é 你好", " lead", "trail  ", "▁▁▁", "𝒳𝒴 z" * 3, "a" * 2000, "same text", "same text"]


def test_one_pass_is_encode_then_decode(spark):
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    shared = spark.sparkContext.broadcast(pieces.Pieces(pieces.model_path()))
    two = pieces.decode(pieces.encode(df, shared, seed=1).withColumn("ids", F.col("piece_ids")), shared).select("doc_id", F.col("ids").alias("piece_ids"), "decoded")
    one = pieces.encode_decode(df, shared, seed=1, keep=["doc_id"])
    assert one.columns == ["doc_id", "piece_ids", "decoded"] and sorted(one.collect()) == sorted(two.collect())
    assert sorted(pieces.encode_decode(df, shared, seed=1).select(*one.columns).collect()) == sorted(two.collect())
    out = corpus_pipeline.sentencepiece(spark, df, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = two.select("doc_id", F.size("piece_ids").cast("long"), "piece_ids", F.sha2(F.encode("decoded", "UTF-8"), 256))
    assert sorted(out.select("doc_id", "n_pieces", "piece_ids", "decoded_sha256").collect()) == sorted(want.collect())


def test_workers_keep_no_tables():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "c"])], ["text"])
    for part in kernels.blocks(iter([batch])):
        kernels.words(*kernels.buffers(part.column("text")))
        assert kernels._cache
    assert not kernels._cache
