"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table
from larkspur.llm.decontam import contaminated
from larkspur.llm.line_dedup import drop_common_lines
from larkspur.llm.html_text import extract_main_text
from larkspur.llm.language_id import identify
from larkspur.llm.lm_score import score_texts
from larkspur.llm.ngram_join import similar_documents
from larkspur.llm.pieces import Pieces, decode, encode, model_path
from larkspur.llm.pii import find_personal_data
from larkspur.llm.quality import score_documents, with_trust
from larkspur.llm.repeats import remove_repeats


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def fold(n: int) -> Column:
    """crc32 of the document id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold(7) == 2)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100, texts=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), fold(5) == 0)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = spark.sparkContext.broadcast(Pieces(model_path()))
    coded = encode(docs, pieces, seed=1)
    coded = coded.select("doc_id", "text", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), "piece_ids")
    back = decode(coded, pieces)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", "n_pieces", "pieces_hash", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), same.alias("lossless"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_trust(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = score_documents(docs, F.col("_trusted")).drop("_trusted")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "pipeline": pipeline,
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
