"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters in
a row binds the three (elementwise product), the first permuted twice, the
second once, so that order counts. A text's vector bundles (adds) the vectors
of its n-grams; the prototype of a language bundles the labelled texts'. A text
gets the language whose prototype has the largest cosine with it.

Letters go to one of 64 symbols (by a hash beyond ASCII) and everything else
is one blank, so there are 64 ** 3 n-grams whatever the data, and the vectors
of all of them are one table that a worker makes for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import blocks, mix

DIMENSIONS, SYMBOLS, SEED = 512, 64, 20240229
#: Code points of Unicode.
POINTS = 0x110000
#: Languages that a profile may have; more is an error, as prototypes are gathered on the driver.
MOST_LANGUAGES = 10_000

_made: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point (0: no letter), and the vectors of all n-grams (int8)."""
    if not _made:
        letter = np.fromiter((chr(i).isalpha() for i in range(POINTS)), dtype=bool, count=POINTS)
        lower = np.arange(POINTS, dtype=np.uint64)
        for i in np.flatnonzero(letter).tolist():
            if len(c := chr(i).lower()) == 1:
                lower[i] = ord(c)
        symbol = np.where(lower < 128, lower % np.uint64(32), 27 + mix(lower) % np.uint64(SYMBOLS - 27))
        symbol = np.where(letter, symbol, 0).astype(np.uint8)
        random = np.random.default_rng(SEED)
        base = random.choice(np.array([-1, 1], np.int8), size=(SYMBOLS, DIMENSIONS))
        one, two = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
        grams = (two[:, None, None] * one[None, :, None] * base[None, None, :]).reshape(-1, DIMENSIONS)
        _made.append((symbol, grams))
    return _made[0]


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of every n-gram that has a letter in the middle, and whether each text has a letter."""
    symbol, _ = _tables()
    texts = texts.fill_null("")
    sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = symbol[points]
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    has = np.bincount(text, weights=letters > 0, minlength=len(sizes)) > 0
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[starts] = 0
    after[(np.cumsum(sizes) - 1)[sizes > 0]] = 0
    use = letters > 0
    gram = before[use].astype(np.int64) * SYMBOLS * SYMBOLS + letters[use].astype(np.int64) * SYMBOLS + after[use]
    own, many = np.unique(text[use] * SYMBOLS**3 + gram, return_counts=True)
    return own // SYMBOLS**3, own % SYMBOLS**3, many, has


def _bundled(text: np.ndarray, gram: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Vector of every text."""
    _, grams = _tables()
    out = np.zeros((n, DIMENSIONS), np.float32)
    bounds = np.searchsorted(text, np.arange(n + 1))
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if hi > lo:
            out[i] = many[lo:hi].astype(np.float32) @ grams[gram[lo:hi]].astype(np.float32)
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams add up before they are turned to vectors: one sum for each language and task."""
    sums: dict[str, np.ndarray] = {}
    for batch in blocks(batches, "_text"):
        text, gram, many, _ = _counted(batch.column("_text"))
        names, code = np.unique(np.asarray(batch.column("_lang").to_pylist(), dtype=object), return_inverse=True)
        for i, name in enumerate(names.tolist()):
            inside = code[text] == i
            found = sums.setdefault(name, np.zeros(SYMBOLS**3, np.float64))
            found += np.bincount(gram[inside], weights=many[inside], minlength=SYMBOLS**3)
    if sums:
        _, grams = _tables()
        vectors = []
        for count in sums.values():
            own = np.flatnonzero(count)
            vectors.append(count[own] @ grams[own].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], ["_lang", "_vector"])


def _predict(names: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes = shared.value
        for batch in blocks(batches, "_text"):
            text, gram, many, has = _counted(batch.column("_text"))
            vectors = _bundled(text, gram, many, batch.num_rows)
            norm = np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), 1e-9)
            if names:
                cosine = (vectors @ prototypes.T) / norm[:, None]
                best = cosine.argmax(axis=1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                found = [names[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
            else:
                score, found = np.zeros(batch.num_rows), ["und"] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_held"), pa.array(found, pa.string()), pa.array(score.astype(np.float64))], ["_id", "_held", "lang_pred", "score"])

    return run


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit vectors of all languages among the rows with a language. Rows with a null language or text teach nothing."""
    labelled = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null and _text is not null")
    parts = labelled.mapInArrow(_learn, "_lang string, _vector array<double>").select("_lang", F.posexplode("_vector").alias("_at", "_x"))
    summed = parts.groupBy("_lang", "_at").agg(F.sum("_x").alias("_x"))
    rows = summed.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_at", "_x"))).alias("_v")).orderBy("_lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for row in rows:
        vector = np.array([x["_x"] for x in row["_v"]])
        out[row["_lang"]] = vector / max(float(np.sqrt((vector * vector).sum())), 1e-9)
    return out


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every row, learned from the rows that aren't held out.

    Returns ``id_col``, ``held_out``, ``lang_pred`` (a learned language; ``und``
    for null text and text without a letter, and for all if nothing could be
    learned) and ``score``, the cosine cut to 0..1 (0 for ``und``). Ties go to
    the language that sorts first. Rows are judged one by one, so repeated rows
    get equal results; a null in ``held_out`` means the row is learned from, a
    null language teaches nothing. A very long text is read whole, as a block by
    itself, in some 60 bytes of memory for each character. An empty table gives an
    empty table. Other columns are ignored, so none can clash.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    flag = F.coalesce(held_out, F.lit(False))
    prototypes = learn_prototypes(docs.filter(~flag), text_col, lang_col)
    names = list(prototypes)
    shared = spark.sparkContext.broadcast(np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS))
    rows = docs.select(F.col(id_col).alias("_id"), flag.alias("_held"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_predict(names, shared), f"_id {kind}, _held boolean, lang_pred string, score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score")
