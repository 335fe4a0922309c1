"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to ``buckets`` buckets. Two
multinomials over the buckets are counted, one from the trusted documents (the
target) and one from the whole raw corpus; a document's score is the mean over
its n-grams of the log of target over raw probability. Documents under the
threshold go. The bucket weights are one array of ``buckets`` doubles, which
is the only thing that reaches every task; its size doesn't depend on the
data. Only SQL functions are used, each document is handled within its row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import least_by_hash, let, own_name, split_words

BUCKETS = 1 << 14


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), n - 3), window)

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        found = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i + 1) | ((i > 0) & same(s, x, i - 1))), lambda x: x["p"]))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
        return F.aggregate(F.sort_array(found), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")), step, lambda acc: acc["total"])

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h)))
    return F.when(n < 4, F.lit(0)).otherwise(counted).cast("long")


def text_counts(text: Column, words: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Bucket numbers of all words and of all pairs of neighbouring words."""
    ones = lambda h: F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    twos = lambda h: F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.coalesce(F.get(h, i + 1), F.lit(0).cast("long"))), F.lit(buckets)).cast("int"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(ones(h), twos(h)))


def bucket_weights(docs: DataFrame, trusted: Column, buckets: int = BUCKETS, smoothing: float = 1.0, text_col: str = "text") -> np.ndarray:
    """Log of target over raw probability of every bucket: ``buckets`` doubles, whatever the size of the data.

    ``trusted`` says which rows of ``docs`` form the target; every row is in the raw corpus.
    Without trusted n-grams all weights are 0.
    """
    grams = docs.select(trusted.alias("_t"), ngram_buckets(split_words(F.col(text_col)), buckets).alias("_g")).select("_t", F.explode("_g").alias("_b"))
    counts = grams.groupBy("_b").agg(F.count(F.when(F.col("_t"), 1)).alias("target"), F.count(F.lit(1)).alias("raw"))
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # a row for each bucket at most
        target[row["_b"]], raw[row["_b"]] = row["target"], row["raw"]
    if not target.sum():
        return np.zeros(buckets)
    share = lambda n: (n + smoothing) / (n.sum() + smoothing * buckets)
    return np.log(share(target) / share(raw))


def with_trust(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``_trusted``: whether the document belongs to the target.

    The target is a sample of at most ``most`` of the documents that some label
    calls good (``quality`` 1) and none calls bad, the least by a hash of the id:
    the bound on what is sent to every task. The raw corpus is all of ``docs``.
    """
    good = labels.groupBy(F.col(id_col).alias("_good")).agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_all"))
    name = own_name(docs, "_good")
    good = least_by_hash(good.filter("_all and _good is not null"), most, "_good").select(F.col("_good").alias(name), F.lit(True).alias("_trusted"))
    return docs.drop("_trusted").join(F.broadcast(good), F.col(id_col) == F.col(name), "left").drop(name)


def score_documents(docs: DataFrame, trusted: Column, threshold: float = -0.1, min_words: int = 50, max_repeat_percent: int = 50, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """Counts, score and verdict of every row.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``score`` and ``kept`` to the columns
    of ``docs``, in place of any of these names; no other name can clash. Null,
    empty or blank text has no words: its score is 0 and it fails the base rules.
    Rows are judged one by one, so repeated rows get equal verdicts; a score that
    equals ``threshold`` is kept. A null in ``trusted`` counts as not trusted. A
    very long text is one row with its words. An empty table gives an empty table.
    """
    trusted = F.coalesce(trusted, F.lit(False))
    weight = F.lit(bucket_weights(docs, trusted, buckets, text_col=text_col))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    base = [c for c in docs.columns if c not in names]
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weight, b)) / F.size(g)
    score = lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(let(ngram_buckets(w, buckets), mean))
    found = own_name(docs, "_found")
    # One expression over the words, so that a filter pushed below can't split a text again for each of them.
    every = let(split_words(F.col(text_col)), lambda w: F.struct(*[c.alias(k) for k, c in text_counts(F.col(text_col), w).items()], score(w).alias("score")))
    counted = docs.select(*base, every.alias(found)).select(*base, f"{found}.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
