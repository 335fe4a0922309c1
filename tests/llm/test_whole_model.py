"""Without a parameter the model has every word and pair of the training texts, however rare."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.llm.lm_score import score_texts


def test_rare_pairs_are_in_the_model(spark):
    docs = spark.createDataFrame([(1, "once only"), (2, "other words here"), (3, "once only"), (4, "only once")], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in score_texts(docs, F.col("doc_id") > 2).collect()}
    assert got == {k: pytest.approx(v) for k, v in ((x["doc_id"], x["score"]) for x in score_texts(docs, F.col("doc_id") > 2, min_count=1).collect())}
    # 7 tokens, 6 words: p(once) = 2/14, p(end) = 2.97/14 (two are quantised to 1.3 ** 3 = 2.197)
    one, end = 2 / 14, (1.3**3 + 1) / 14
    start = (1 + 1.3**3 * one) / (1.3**3 + 1.3**3)  # two texts begin with two words
    assert got[3] == pytest.approx(math.log10(start) + math.log10((1 + one) / 2) + math.log10((1 + end) / 2))
    assert got[4] < got[3]  # the same words in an order that isn't learnt
