"""The driver passes the model on in pieces, however large it is, and the pairs of frequent words may lie in any part."""

import random

import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from larkspur.llm import lm_score
from larkspur.llm.lm_score import score_texts


def scores(df, **options):
    return {x["doc_id"]: x["score"] for x in score_texts(df, F.col("doc_id") % 7 == 2, **options).collect()}


def test_the_driver_holds_a_piece_at_a_time(spark, monkeypatch):
    r = random.Random(23)
    word = lambda: f"w{int(r.expovariate(0.01))}"
    df = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(300)], "doc_id long, text string").repartition(3)
    want, sent, broadcast = scores(df), [], SparkContext.broadcast
    monkeypatch.setattr(lm_score, "PIECE", 150_000, raising=False)

    def seen(context, value):
        sent.append(len(value) if isinstance(value, bytes) else 0)
        return broadcast(context, value)

    monkeypatch.setattr(SparkContext, "broadcast", seen)
    assert scores(df) == pytest.approx(want)
    pairs = [n for n in sent if 0 < n < 1 << 20]
    assert max(pairs) <= 150_100 and len(pairs) > 2  # a segment of words is 1 MB, the least that can be sent
    assert max(sent) <= (1 << 20) + 100  # and the mark


@pytest.mark.parametrize("options", [{}, {"shard_mb": 0.002}])
def test_pairs_of_frequent_words_in_all_parts(spark, options):
    r = random.Random(29)
    word = lambda: f"w{int(r.expovariate(0.1))}"
    df = spark.createDataFrame([(i, " ".join(word() for _ in range(40))) for i in range(150)] + [(900, None), (901, "unseen w1")], "doc_id long, text string").repartition(3)
    want = scores(df)
    for least in (1, 20):
        assert scores(df, spread_from=least, **options) == pytest.approx(want)
