"""Operators whose result is exact, against brute force on small tables with ties, repeats, nulls and large groups."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import kernels, ngram_join, repeats
from larkspur.llm.decontam import contaminated, masks, replaced, without_contaminated
from larkspur.llm.line_dedup import LineRuns, drop_common_lines
from larkspur.llm.ngram_join import components, similar_documents
from larkspur.llm.quality import score_documents, with_trust

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


# line dedup


def brute_lines(docs, least):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: low(line.strip(strip))
    count = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    r = random.Random(1)
    pool = [" Common Line\t", "common line", "ÀB", "àb", "", "  ", "x"]
    docs = [(i, "\n".join(r.choice(pool + [f"own {i} {j}"]) for j in range(r.randint(0, 9)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "common line\n" * 500)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, n_lines string")
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in drop_common_lines(df, min_docs=10, batches=5, fanout=2).collect()}
    assert got == brute_lines(docs, 10)
    assert drop_common_lines(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_count_once(spark):
    df = spark.createDataFrame([(None, "a\nb")] + [(1, "a\nc")] * 4 + [(2, "a")], "doc_id long, text string")
    out = drop_common_lines(df, min_docs=3, batches=2).collect()
    assert len(out) == 6 and all("a" not in x["text"] for x in out)
    assert drop_common_lines(df, min_docs=4, batches=2).filter("n_dropped > 0").count() == 0


def test_runs_are_compacted(spark):
    index = LineRuns(spark, min_docs=3, fanout=2)
    for i in range(4):
        index.add(spark.createDataFrame([(1, 1), (2, i)], "_k1 long, _k2 long"))
    assert [len(x) for x in index.levels] == [0, 0, 1]
    assert [tuple(x) for x in index.common().collect()] == [(1, 1)]


# repeats


def brute_repeats(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def repeat_docs(seed):
    r = random.Random(seed)
    passage = "".join(r.choice("ab cé") for _ in range(400))
    docs = [(i, passage[r.randint(0, 150) : r.randint(100, 400)] + r.choice("xyz") + passage[r.randint(0, 390) :]) for i in range(120)]
    return docs + [(500, None), (501, ""), (502, "a" * 700), (503, "a" * 99), (504, "a" * 100), (505, "ab" * 400), (None, passage), (506, passage), (507, passage)]


def test_repeats(spark):
    docs = repeat_docs(3)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_bytes int").repartition(6)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove_repeats(df).collect()}
    assert got == brute_repeats(docs, 100)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("crowd", "size"), [(4096, 8192), (2, 8192), (4096, 3), (0, 5)])
def test_repeats_in_small_blocks(spark, monkeypatch, crowd, size):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BATCH", size)
    docs = repeat_docs(4 + crowd + size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_repeats(docs, 100)


def test_strings_whose_second_ranks_share_their_upper_half(spark):
    start = "the passage that all of these documents share in their beginning"
    pairs = [(27849, 249762), (143447, 214236), (60010, 325332), (41301, 211947)]  # equal in the upper 32 bits of the second rank
    docs = [(i, start + f"{i:08d} goes on in its very own way..."[:36]) for pair in pairs for i in pair]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_repeats(docs, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 4), st.integers(0, 3)), max_size=40), st.integers(1, 6))
def test_verdicts_over_any_batches(rows, size):
    rows = sorted(set(rows))
    kinds = {}
    for key, ctx, doc, pos in rows:
        first = min((d, p) for k, c, d, p in rows if (k, c) == (key, ctx))
        several = len({c for k, c, *_ in rows if k == key}) > 1
        if (doc, pos) != first:
            kinds[key, ctx, doc, pos] = 1
        elif several:
            kinds[key, ctx, doc, pos] = 2
    want = sorted((d, p, k) for (_, _, d, p), k in kinds.items())

    def batches():
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            zeros = [0] * len(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((*zip(*part, strict=True), zeros, zeros, [False] * len(part)), repeats._PAIRS.types, strict=True)], schema=repeats._PAIRS)

    got = sorted((d, p, k) for b in repeats._verdicts(batches()) for _, d, p, _, _, k in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert got == want


# n-gram join


def shingles(text, n):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(docs, n, percent):
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for d, s in sets.items():
        common = collections.Counter(e for g in s for e in where[g] if e < d)
        for e, m in common.items():
            if 100 * m >= percent * (len(s) + len(sets[e]) - m):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_docs(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    word = lambda: r.choice(vocabulary)
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        texts.append(w)
    for _ in range(80):
        w = [word() for _ in range(r.randint(20, 120))]
        p = r.randint(0, len(w))
        texts.append(w[:p] + passage + w[p:])
    texts += [passage + [word() for _ in range(r.randint(0, 9))] for _ in range(60)]
    for _ in range(25):
        b = [word() for _ in range(r.randint(5, 60))]
        for _ in range(4):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            texts.append(w)
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return docs + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  B"), (9004, "a"), (9005, " \n"), (9006, "b a"), (9007, "b a")]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_groups(spark, monkeypatch, n, percent):
    monkeypatch.setattr(ngram_join, "CHUNK", 20 if n == 5 else 1024)  # several chunks
    docs = near_docs(n)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int").repartition(6)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_documents(df, n, percent).collect()}
    assert got == brute_groups(docs, n, percent)
    fewer = similar_documents(df, n, percent, count_links=False)
    assert fewer.columns == ["doc_id", "n_shingles", "component_id"]
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in fewer.collect()} == got


@pytest.mark.parametrize("chunk", [20, 1024])
def test_every_link_counts_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    docs = near_docs(6) + [(8000, near_docs(6)[0][1])]  # an equal set is no other set
    sets = {d: shingles(t, 4) for d, t in docs}
    different = [s for s in set(sets.values()) if s]
    linked = lambda x, y: x != y and 100 * len(x & y) >= 85 * len(x | y)
    want = {d: sum(linked(s, x) for x in different) for d, s in sets.items()}
    assert max(want.values()) > 2 * ngram_join.FREQUENT
    got = {x["doc_id"]: x["n_links"] for x in similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 4, 85).collect()}
    assert got == want


def test_groups_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w"), (7, "X y z u v w")], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"]) for x in similar_documents(df).collect()), key=str)
    assert got == [(1, 1), (1, None), (1, None), (7, 1), (None, None)]
    assert similar_documents(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (2, "x y z u v w"), (2, "k l m n o p"), (3, "k l m n o p"), (4, "own words of this one text")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.ngram_jaccard_join(spark, df, "").collect()), key=str)
    assert got == [(2, "k l m n o p"), (2, "x y z u v w"), (4, "own words of this one text"), (None, "a b c d e f")]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    got = {x["_node"]: x["_label"] for x in components(spark.createDataFrame(links, "_a long, _b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


# decontamination


def test_decontamination(spark):
    r = random.Random(2)
    item = [f"t{i}" for i in range(30)]
    fill = lambda k: [f"f{r.randint(0, 500)}" for _ in range(k)]
    swapped = list(item)
    for i in (4, 11, 18, 25):
        swapped[i] = "other"
    docs = [(1, " ".join(fill(40) + item + fill(20))), (2, " ".join(fill(9) + swapped)), (3, " ".join(fill(60))), (4, " ".join(fill(5) + item[:14] + fill(5))), (5, " ".join(item[:6] + fill(30))), (6, None), (7, ""), (8, "T0, t1! T2; " + " ".join(item[3:])), (8, "T0, t1! T2; " + " ".join(item[3:])), (None, " ".join(item))]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None), (10, " ".join(item))], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["n_tokens"], x["n_equal"], x["at_token"]) for x in contaminated(df, items).collect()}
    assert got == {(1, 10): (30, 30, 40), (2, 10): (30, 26, 9), (4, 10): (30, 14, 5), (8, 10): (30, 30, 0), (None, 10): (30, 30, 0)}
    assert sorted(x["doc_id"] for x in without_contaminated(df, items).collect()) == [3, 5, 6, 7]
    assert contaminated(df.limit(0), items).count() == 0 and contaminated(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("width", range(1, 14))
def test_masks_hit_every_pattern(width):
    many = replaced(width, 80)
    own = masks(width, many)
    for out in itertools.combinations(range(width), many):
        assert any(not {i + k for k in m} & set(out) for m in own for i in range(width - m[-1])), (width, out, own)


def test_decontamination_of_every_pattern(spark):
    items = {n: [f"i{n}x{i}" for i in range(n)] for n in (5, 9, 13, 15)}
    docs = []
    for n, many in ((5, 1), (9, 1), (13, 2), (15, 4)):
        for out in itertools.combinations(range(n), many):
            if any(sum(i <= k < i + 13 for k in out) <= (2 if n > 12 else many) for i in range(max(1, n - 12))):
                docs.append((n, "a b " + " ".join("other" if i in out else w for i, w in enumerate(items[n])) + " c"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(df, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(docs)}


# kernels


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nAaBé\x0b", max_size=12)), max_size=8), st.integers(1, 20))
def test_words_and_blocks(texts, size):
    data, offsets = kernels.buffers(pa.array(texts, pa.string()))
    hashed, owner, counts = kernels.words(data, offsets)
    split = [WORD.findall(low(t)) for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    flat = [w for x in split for w in x]
    names = {}
    assert all(names.setdefault(w, h) == h for w, h in zip(flat, hashed.tolist(), strict=True)) and len(set(names.values())) == len(names)
    assert owner.tolist() == [i for i, x in enumerate(split) for _ in x]
    again = [t for b in kernels.blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), "text", size) for t in b.column(0).to_pylist()]
    assert again == texts and np.all(np.diff(offsets) >= 0)


# pipeline


def words_of(r, vocabulary, k):
    return " ".join(r.choice(vocabulary) for _ in range(k))


def test_pipeline_by_brute_force(spark, tmp_path):
    r = random.Random(31)
    good, junk = [f"word{i}" for i in range(60)], [f"JUNK{i}!!" for i in range(30)]
    item = words_of(r, good, 24)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(words_of(r, good, 20) for _ in range(4)) + "\nShared Footer line"))
    rows += [(100 + i, words_of(r, junk, 80)) for i in range(30)]
    rows += [(200, rows[0][1]), (201, rows[1][1].replace("word1 ", "word2 ", 1)), (202, words_of(r, good, 40) + " " + item + " " + words_of(r, good, 30)), (203, "too short"), (204, ""), (205, None), (None, rows[2][1]), (60, rows[3][1]), (3, rows[3][1])]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in [*range(61), 200, 201, 202]] + [(100 + i, 0) for i in range(9)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Quality: base rules, then the ratio of bucket counts; here junk words are never in the target.
    def passes(t):
        w = WORD.findall(t or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(tri)
        twice = {j for i, g in enumerate(tri) if n[g] > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(twice) <= 50 * len(w) and not any(x in junk for x in w)

    left = [(d, t) for d, t, *_ in rows if passes(t)]
    # Lines in ten documents or more, a document being an id with its text.
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    many = collections.Counter(k for _, t in set(left) for k in {key(x) for x in t.split("\n")} if k)
    left = [(d, "\n".join(x for x in t.split("\n") if many[key(x)] < 10)) for d, t in left]
    left = [(d, t) for d, t in left if t.strip(" \t\n\x0b\x0c\r")]
    # One row of each group of near copies.
    named = list(enumerate(left))
    groups = brute_groups([(i, t) for i, (_, t) in named], 5, 80)
    best = {}
    for i, (d, t) in named:
        g = groups[i][1]
        if g not in best or (d is not None, d or 0) < (best[g][0] is not None, best[g][0] or 0):
            best[g] = (d, t)
    left = list(best.values())
    # Benchmark: 13 words in a row of an item, four fifths of them equal, at any offset.
    items = [re.findall(r"\w+", item), ["two", "words"]]

    def leaks(t):
        w = re.findall(r"\w+", low(t))
        for own in items:
            width = min(13, len(own))
            for o in range(-len(own), len(w)):
                same = [0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(own)]
                if any(100 * sum(same[k : k + width]) >= 80 * width for k in range(len(own) - width + 1)):
                    return True
        return False

    want = sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in left if not leaks(t)), key=str)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((x["doc_id"], x["decoded_sha256"]) for x in got), key=str) == want
    assert 40 < len(want) < 62 and all(x["n_pieces"] == len(x["piece_ids"]) for x in got)


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (i == 4 or out.columns == docs.columns)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "same line\nown %d" % i, 1, 2, 3, 4) for i in range(12)], "doc_id long, text string, _r1 int, _R2 int, _gone int, _bad int")
    out = drop_common_lines(df, min_docs=10)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"] and {tuple(x)[2:] for x in out.collect()} == {(1, 2, 3, 4, 2, 1)}
    items = spark.createDataFrame([(1, "own 3 same")], "item_id long, text string")
    assert without_contaminated(df, items).columns == df.columns
    judged = score_documents(with_trust(df.withColumnsRenamed({"_r1": "_words", "_R2": "_good", "_gone": "_found"}), spark.createDataFrame([(1, 1)], "doc_id long, quality int")), F.col("_trusted"))
    assert {(x["_words"], x["_good"], x["_found"], x["n_words"]) for x in judged.collect()} == {(1, 2, 3, 4)}
