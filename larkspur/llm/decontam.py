"""Benchmark decontamination by spaced-seed hashing.

Masks choose some of the tokens in a span, so that every stretch which the rule
admits has a place where one of them reads equal tokens only; two passages whose chosen
tokens agree get the same hash, whatever stands at the ignored positions. The
hashes of the test items are joined with those of the documents. A hit fixes
an item and its offset in a document; the item is then laid over the document
at this offset and the equal positions are counted, so that passages with
replaced words are found and chance hits are not. Only SQL functions are used.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import let, own_name, written

#: Masks for a width at most, and patterns of replaced tokens up to which they are searched for.
MOST_MASKS, PATTERNS = 3, 5000
#: Largest seed table, in rows, that is sent to every task; beyond it the join shuffles.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased: punctuation doesn't hide a passage."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def replaced(width: int, min_percent: int) -> int:
    """Tokens of a stretch that may differ."""
    return width - -(-width * min_percent // 100)


@functools.lru_cache(maxsize=None)
def masks(width: int, differ: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one at least, at some place in ``width`` tokens, reads none of any ``differ`` tokens.

    The heaviest for which few suffice, chosen greedily over all patterns; with
    too many patterns the run that any of them leaves whole. Always the same.
    """
    run = tuple(range(max(1, -(-(width - differ) // (differ + 1)))))
    if not 0 < differ < width or math.comb(width, differ) > PATTERNS:
        return (run,)
    patterns = [sum(1 << i for i in p) for p in itertools.combinations(range(width), differ)]
    for weight in range(width - differ, len(run), -1):
        hits = {}
        for rest in itertools.islice(itertools.combinations(range(1, width), weight - 1), PATTERNS):
            own = [sum(1 << (i + k) for k in (0, *rest)) for i in range(width - rest[-1])]
            hits[0, *rest] = {p for p in patterns if any(not p & o for o in own)}
        left, chosen = set(patterns), []
        while left and len(chosen) < MOST_MASKS:
            best = max(hits, key=lambda m: (len(hits[m] & left), [-k for k in m]))
            left -= hits[best]
            chosen.append(best)
        if not left:
            return tuple(chosen)
    return (run,)


def seeds(hashes: Column, own: list[tuple[int, ...]]) -> Column:
    """Structs of first token and hash, for every position and mask."""
    one = lambda h, m: F.when(F.size(h) > m[-1], F.transform(
        F.sequence(F.lit(0), F.size(h) - 1 - m[-1]), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(str(m)), *[F.get(h, i + k) for k in m]).alias("seed"))
    )).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))
    return let(hashes, lambda h: F.concat(*[one(h, m) for m in own]))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 13, min_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item or a stretch of it, one row for each document and item.

    A document is contaminated by an item if, with the item laid over it at
    some offset, a stretch of ``window`` item tokens (all
    of a shorter item) has ``min_percent`` of its tokens equal. Returns
    ``id_col``, ``item_col``, ``n_tokens`` of the item, ``n_equal`` and
    ``at_token``, the contaminated offset with most equal tokens (ties: the
    first). The masks for a length hit every such stretch.

    Null and empty texts match nothing; a null id is an id like any
    other. Repeated rows of a document or an item count once for each distinct
    pair of id and text. A very long text is one row with its seeds. Empty tables
    give no rows. Other columns are ignored, so none can clash.
    """
    known = items.select(F.col(item_col).alias("_item"), token_hashes(F.col(item_text)).alias("_tokens")).distinct()
    known = written(known, "items")
    widths = [x["w"] for x in known.select(F.least(F.size("_tokens"), F.lit(window)).alias("w")).distinct().collect() if x["w"] > 0]  # window values at most
    by_width = {w: list(masks(w, replaced(w, min_percent))) for w in sorted(widths)}
    used = sorted({m for own in by_width.values() for m in own}) or [(0,)]
    own_seeds = F.array().cast("array<struct<at:int,seed:bigint>>")
    for w, own in by_width.items():
        own_seeds = F.when(F.least(F.size("_tokens"), F.lit(window)) == w, seeds(F.col("_tokens"), own)).otherwise(own_seeds)
    item_seeds = known.select("_item", F.xxhash64("_tokens").alias("_variant"), F.explode(own_seeds).alias("_s"))
    item_seeds = item_seeds.select("_item", "_variant", F.col("_s.at").alias("_item_at"), F.col("_s.seed").alias("_seed"))
    item_seeds = written(item_seeds, "item-seeds")
    if item_seeds.count() <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)

    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole).alias("_text_id"), F.col(text_col).alias("_text"))
    doc_seeds = rows.select("_id", "_text_id", F.explode(seeds(token_hashes(F.col("_text")), used)).alias("_s")).select("_id", "_text_id", F.col("_s.at").alias("_at"), F.col("_s.seed").alias("_seed"))
    hits = doc_seeds.join(item_seeds, "_seed").select("_id", "_text_id", "_item", "_variant", (F.col("_at") - F.col("_item_at")).alias("_offset")).distinct()
    hits = written(hits, "seed-hits")

    # Documents with a hit only, and their tokens once.
    touched = rows.join(hits.select(F.col("_id").alias("_hid"), F.col("_text_id").alias("_htext")).distinct(), F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_text_id") == F.col("_htext")), "left_semi")
    touched = touched.dropDuplicates(["_id", "_text_id"]).select(F.col("_id").alias("_did"), F.col("_text_id").alias("_dtext"), token_hashes(F.col("_text")).alias("_doc_tokens"))
    variants = known.select(F.col("_item").alias("_kitem"), F.xxhash64("_tokens").alias("_kvariant"), "_tokens")
    laid = hits.join(variants, F.col("_item").eqNullSafe(F.col("_kitem")) & (F.col("_variant") == F.col("_kvariant")))
    laid = laid.join(touched, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_text_id") == F.col("_dtext")))

    equal = F.transform(F.col("_tokens"), lambda t, i: ((F.col("_offset") + i >= 0) & F.coalesce(F.get(F.col("_doc_tokens"), F.greatest(F.col("_offset") + i, F.lit(0))) == t, F.lit(False))).cast("int"))
    width = F.least(F.size("_tokens"), F.lit(window))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    judged = laid.select("_id", "_item", F.size("_tokens").alias("_n"), "_offset", width.alias("_width"), equal.alias("_equal"))
    judged = judged.select("_id", "_item", "_n", "_offset", "_width", total(F.col("_equal")).alias("_sum"), F.array_max(F.transform(F.sequence(F.lit(0), F.col("_n") - F.col("_width")), lambda i: total(F.slice(F.col("_equal"), i + 1, F.col("_width"))))).alias("_best"))
    found = judged.filter(100 * F.col("_best") >= min_percent * F.col("_width"))
    first = F.struct(F.col("_sum").alias("n"), (-F.col("_offset")).alias("o"), F.col("_n").alias("len"))
    found = found.groupBy(F.col("_id").alias(id_col), F.col("_item").alias(item_col)).agg(F.max(first).alias("_m"))
    return found.select(id_col, item_col, F.col("_m.len").cast("long").alias("n_tokens"), F.col("_m.n").cast("long").alias("n_equal"), (-F.col("_m.o")).cast("long").alias("at_token"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that :func:`contaminated` doesn't find, all columns and rows kept; a null id is an id like any other."""
    name = own_name(docs, "_bad")
    bad = written(contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias(name)).distinct(), "contaminated")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
