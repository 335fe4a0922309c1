"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes the columns of ``documents`` and ignores others. Null texts
count as empty and, having no words, go in the first stage; a null id is an id
like any other; repeated rows are judged alike, and one of them stays in the
third stage. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import new_path, table, written
from larkspur.llm.decontam import without_contaminated
from larkspur.llm.line_dedup import drop_common_lines
from larkspur.llm.ngram_join import BROADCAST_IDS, similar_documents
from larkspur.llm.pieces import Pieces, encode_decode, model_path
from larkspur.llm.quality import score_documents, with_trust

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules, and those whose score is under the threshold. Repeated rows get one verdict."""
    judged = score_documents(with_trust(docs.select(*COLUMNS), table(spark, sf_dir, "labels")), F.col("_trusted"))
    # Written before the filter: pushed into the scan, it would split each text again for every word of it.
    return written(judged.select(*COLUMNS, "kept"), "judged").filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; documents that they leave without text go too."""
    out = drop_common_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return out.filter(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one of the least id (a null counts as the smallest), then of the least hash of id and text."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    placed = similar_documents(keyed.select("_key", "text"), n=5, percent=80, id_col="_key", count_links=False).select("_key", "component_id").distinct()
    placed = written(placed, "placed")
    rows = keyed.groupBy("_key").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_many"))
    first = placed.join(rows, "_key").groupBy("component_id").agg(F.min(F.struct("_id", "_key", "_many")).alias("_row"))
    first = written(first.select("component_id", F.col("_row._key").alias("_first"), F.col("_row._many").alias("_many")), "firsts")
    # The keys that go are fewer than those that stay; few of them are sent to the texts, more take the texts to them.
    gone = few(written(placed.join(first, "component_id").filter("_key <> _first").select("_key"), "gone"))
    again = few(written(first.filter("_many > 1").select(F.col("_first").alias("_key")), "again"))
    kept = keyed.join(gone, "_key", "left_anti")
    return kept.join(again, "_key", "left_anti").unionByName(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"])).select(*COLUMNS)


def few(keys: DataFrame) -> DataFrame:
    """Keys marked to be sent to every task if there are few of them, counted first."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, and all rows of their ids, a null id included; without items all stay."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as sampled pieces, with the hash of what they decode to; an empty text has none. Rows of one id and text get one segmentation."""
    pieces = spark.sparkContext.broadcast(Pieces(model_path()))
    # A text goes to the worker once and doesn't come back.
    back = encode_decode(docs.select(*COLUMNS), pieces, seed=1, keep=["doc_id", "lang", "source"])
    return back.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: No SQL: sampled segmentation and the hashed score can't be expressed. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
