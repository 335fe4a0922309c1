import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import kernels, pieces

TEXTS = [None, "", " ", "Hello  world\nx ▁ é 你好", " lead", "trail  ", "\n\n a\t\tb", "▁▁▁", "𝒳𝒴 z" * 3, "a" * 2000, "é" * 300, " " * 70, "same text", "same text"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path())


def coded(model, texts, keys, seed=1):
    data, offsets = kernels.buffers(pa.array(texts, pa.string()))
    return pieces.encode_block(model, data, offsets, np.array(keys, np.uint64), seed)


def test_round_trip_and_reproducible(spark, model):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, piece_ids string")
    shared = spark.sparkContext.broadcast(model)
    out = pieces.encode(df, shared, seed=3)
    assert out.columns == ["doc_id", "text", "piece_ids"]
    first = {x["doc_id"]: x["piece_ids"] for x in out.collect()}
    again = {x["doc_id"]: x["piece_ids"] for x in pieces.encode(df.repartition(5), shared, seed=3).collect()}
    assert first == again
    back = pieces.decode(out, shared).select("text", "decoded").collect()
    assert all((x["text"] or "") == x["decoded"] for x in back)
    assert first[0] == [] and first[1] == []
    assert pieces.encode(df.limit(0), shared).count() == 0


def test_long_batches_decode_in_parts(model, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED", 5)
    ids, bounds = coded(model, TEXTS, range(len(TEXTS)))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    class Shared:
        value = model

    parts = pieces._decode(Shared)(iter([pa.RecordBatch.from_arrays([lists], ["_ids"])]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == [t or "" for t in TEXTS]


def test_samples_follow_the_lattice(model):
    n = 20_000
    ids, bounds = coded(model, ["the cat"] * n, range(n))
    seen = collections.Counter(tuple(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    byte = set(model.byte_id.tolist())
    known = {model.bytes[i]: i for i in range(len(model.bytes)) if model.bytes[i] and i not in byte}

    def paths(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, w in paths(s[k:]):
                    yield (known[s[:k]], *rest), w + model.log[known[s[:k]]]

    every = list(paths(b" the cat"))
    total = sum(math.exp(w) for _, w in every)
    assert max(abs(seen[p] / n - math.exp(w) / total) for p, w in every) < 0.015
    assert set(seen) <= {p for p, _ in every}


def test_long_units_are_segmented_alike(model, monkeypatch):
    texts = ["internationalisation" * 12, "你好世界的是一二三" * 40, "aaaa" * 100, "𝒳𝒴é漢" * 60, "x" * 300 + " y " + "ab" * 200]
    monkeypatch.setattr(pieces, "LONG", 1 << 40)
    whole = coded(model, texts, range(5))
    for long, window in ((8, 1 << 16), (8, 50), (256, 70)):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "WINDOW", window)
        cut = coded(model, texts, range(5))
        assert np.array_equal(cut[0], whole[0]) and np.array_equal(cut[1], whole[1])


def test_megabytes_without_a_space(model):
    for text in ("漢字仮名" * 90_000, "a" * 300_000):
        ids, bounds = coded(model, [text], [1])
        data, _ = pieces.decode_block(model, ids, bounds)
        assert data.tobytes() == text.encode()


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9, "d")], "doc_id long, text string, _text int, _key int, _ids int, decoded string")
    shared = spark.sparkContext.broadcast(model)
    out = pieces.decode(pieces.encode(df, shared), shared)
    assert out.columns == ["doc_id", "text", "_text", "_key", "_ids", "decoded"] and tuple(out.first()) == (1, "a b", 7, 8, 9, "a b")
