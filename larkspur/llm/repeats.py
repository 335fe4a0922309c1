"""Exact repeated substrings, by distributed prefix doubling.

A rank names the string of h bytes at a position: equal strings have equal
ranks. The rank of 2h bytes comes from the pair of ranks at a position and h
bytes on. Ranks of up to 32 bytes are made where the text lies; from there
Spark sorts the position rank pairs of all documents at growing offsets, and
after each sort the positions whose pair is unique, or settled, leave:

1. 32 bytes. Every string of ``length`` bytes has an anchor: the leftmost
   position in it with the least rank of 32 bytes. The anchor depends on nothing
   but the string, so equal strings have equal anchors at equal places, while
   only some 3 positions in 100 are anchors. Spark sorts pairs of an anchor's
   rank and the rank of its context, the bytes of all strings with this anchor.
   Anchors whose rank is unique leave: none of their strings is repeated. If an
   earlier anchor has the same context, all strings of the anchor are repeated
   and it is settled.
2. ``length`` bytes. The anchors that stay (at the ends of copied passages, and
   at the same places of their first copies) are sorted with the bytes of their
   contexts. The strings of all anchors with one rank are reranked to pairs of 64
   bytes, which overlap and together are the whole string; all but the first of
   equal ones are repeated. Where more anchors than ``CROWD`` have one rank, the
   pairs themselves are dealt and sorted, so that no task gets all of them.

Ranks are 64-bit names and always compared in pairs, so that equal strings are
told by 128 bits. Positions that are known to be repeated from their own block
don't take part in the sort, so a passage that a third of all documents have
gives one row for each block of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, written
from larkspur.llm.kernels import blocks, buffers, mix

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Ranks of the 256 bytes, and of the gap between documents.
_SYMBOL = mix(np.arange(1, 258, dtype=np.uint64) * _A)
#: Bytes of an anchor string.
ANCHOR = 32
#: Anchors with one rank up to which one task compares their strings.
CROWD = 4096
#: Contexts that are reranked at once.
BATCH = 8192

_SETTLED, _STAYS = 1, 2
_PAIRS = pa.schema([("_key", pa.int64()), ("_ctx", pa.int64()), ("_doc", pa.int64()), ("_pos", pa.int32()), ("_lo", pa.int16()), ("_hi", pa.int16()), ("_known", pa.bool_())])
_VERDICT = pa.schema([("_key", pa.int64()), ("_doc", pa.int64()), ("_pos", pa.int32()), ("_lo", pa.int16()), ("_hi", pa.int16()), ("_kind", pa.int8())])
_INTERVAL = pa.schema([("_doc", pa.int64()), ("_start", pa.int32()), ("_stop", pa.int32())])


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + (right ^ _B))


def _doubled(rank: np.ndarray, have: int, length: int) -> np.ndarray:
    """Ranks of ``length`` bytes from those of ``have``; the last step overlaps."""
    while have < length:
        step = min(have, length - have)
        rank, have = _pair(rank[:-step], rank[step:]), have + step
    return rank


class _Block:
    """The documents of one block with gaps between them, their ranks and anchors."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        data, offsets = buffers(batch.column("_text"))
        self.length, self.width = length, length - ANCHOR + 1
        self.gap = length + self.width
        self.sizes = np.diff(offsets)
        self.starts = offsets[:-1] + self.gap * np.arange(1, len(offsets))
        symbols = np.full(len(data) + self.gap * len(offsets), 256, dtype=np.uint16)
        symbols[np.repeat(self.starts - offsets[:-1], self.sizes) + np.arange(len(data))] = data
        self.rank = _doubled(_SYMBOL[symbols], 1, ANCHOR)
        # Starts of whole strings, and the anchor of each.
        many = np.maximum(self.sizes - length + 1, 0)
        doc = np.repeat(np.arange(len(many), dtype=np.int32), many)
        first = np.cumsum(many) - many
        begin = np.repeat(self.starts - first, many) + np.arange(int(many.sum()))
        anchor = self._leftmost_least()[begin]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = anchor[1:] != anchor[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(anchor)) - 1
        self.anchor, self.doc = anchor[at], doc[at]
        #: How far before the anchor its first and its last string start.
        self.lo, self.hi = (self.anchor - begin[at]).astype(np.int16), (self.anchor - begin[last] if len(at) else self.anchor).astype(np.int16)

    def _leftmost_least(self) -> np.ndarray:
        """For every window of ``width`` positions the leftmost with the least rank: prefix and suffix minima of chunks of the width."""
        w, n = self.width, len(self.rank) - self.width + 1
        key = np.full(-(-len(self.rank) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        key[: len(self.rank)] = self.rank
        key = (key & ~np.uint64(127)).reshape(-1, w) | np.arange(w, dtype=np.uint64)  # the place breaks ties
        base = (np.arange(key.size, dtype=np.int64) // w) * w
        fore = np.minimum.accumulate(key, axis=1).ravel()
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        left, right = back[:n], fore[w - 1 : w - 1 + n]
        low = np.uint64(127)
        return np.where((left & ~low) <= (right & ~low), base[:n] + (left & low).astype(np.int64), base[w - 1 : w - 1 + n] + (right & low).astype(np.int64))

    def contexts(self) -> np.ndarray:
        """Rank of the context of every anchor, from the ranks of the 32-byte strings that make it up."""
        at, size = self.anchor - (self.width - 1), self.length + self.width - 1
        out = self.rank[at]
        for step in [*range(ANCHOR, size - ANCHOR, ANCHOR), size - ANCHOR]:
            out = _pair(out, self.rank[at + step])
        return out


def _dealt(key: np.ndarray, ctx: np.ndarray, ids: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rank pairs of a block's positions, in text order. Those that an equal pair of the block precedes are settled here, and dealt by their place."""
    order = np.lexsort((pos, ids, ctx, key))
    k, c = key[order], ctx[order]
    known = np.zeros(len(k), dtype=bool)
    known[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    head = np.flatnonzero(~known)
    origin = order[np.repeat(head, np.diff(np.append(head, len(k))))]
    flags = np.zeros(len(k), dtype=bool)
    flags[order] = known & ((ids[order] != ids[origin]) | (pos[order] != pos[origin]))
    route = np.where(flags, mix(ids.astype(np.uint64) * _A + pos.astype(np.uint64)), key).view(np.int64)
    ctx = np.where(flags, np.int64(0), ctx)
    for i in range(0, len(route), 1 << 16):
        cut = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (route, ctx, ids, pos, lo, hi, flags)], schema=_PAIRS)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            b = _Block(batch, length)
            ids = np.asarray(batch.column("_doc"))[b.doc]
            pos = (b.anchor - b.starts[b.doc]).astype(np.int32)
            yield from _dealt(b.rank[b.anchor], b.contexts().view(np.int64), ids, pos, b.lo, b.hi)

    return run


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (known, key, context, document, position). Keeps two rows between batches.

    Settled: an earlier position has the same pair. Staying: the first position
    of a pair whose key has other pairs too.
    """
    names = ("_key", "_ctx", "_doc", "_pos", "_lo", "_hi")
    carried: list[np.ndarray] | None = None  # the first rows of the last key and of the last pair
    sent = False  # whether that first row of the key has been sent

    def out(rows: list[np.ndarray], chosen: np.ndarray, kind: int) -> pa.RecordBatch:
        key, _, doc, pos, lo, hi = (x[chosen] for x in rows)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, pos, lo, hi, np.full(len(key), kind, np.int8))], schema=_VERDICT)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) for c in names]
        known = np.asarray(batch.column("_known").to_numpy(zero_copy_only=False), dtype=bool)
        if known.any():
            yield out(rows, known, _SETTLED)
            rows = [x[~known] for x in rows]
        if not len(rows[0]):
            continue
        fresh = 0
        if carried is not None:
            rows, fresh = [np.concatenate((a, x)) for a, x in zip(carried, rows, strict=True)], 2
        key, ctx, doc, pos = rows[:4]
        same_key = np.zeros(len(key), dtype=bool)
        same_key[1:] = key[1:] == key[:-1]
        same_pair = same_key.copy()
        same_pair[1:] &= ctx[1:] == ctx[:-1]
        firsts = np.flatnonzero(~same_pair)
        first = np.repeat(firsts, np.diff(np.append(firsts, len(key))))
        settled = same_pair & ((doc != doc[first]) | (pos != pos[first]))
        stays = same_key & ~same_pair
        heads = np.flatnonzero(~same_key)
        several = np.add.reduceat(stays.astype(np.int64), heads) > 0
        if fresh and sent:
            several[0] = True
        stays[heads[several]] = True
        if fresh:  # the carried rows have had their verdicts, but for a first row whose key had one pair
            settled[:2] = False
            stays[1] = False
            if sent:
                stays[0] = False
        if settled.any():
            yield out(rows, settled, _SETTLED)
        if stays.any():
            yield out(rows, stays, _STAYS)
        carried = [x[[heads[-1], firsts[-1]]] for x in rows]
        sent = bool(several[-1])


def _listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths, and all elements, of a column of lists."""
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64), pc.list_flatten(lists)


def _context_rows(length: int, whole: bool):
    """Bytes of the contexts of listed anchors; or, if ``whole`` is off, the rank pairs of all their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            data, offsets = buffers(batch.column("_text"))
            many, found = _listed(batch.column("_stays"))
            key, pos, lo, hi = (np.asarray(found.field(c)) for c in ("_key", "_pos", "_lo", "_hi"))
            row = np.repeat(np.arange(len(many)), many)
            inside = pos.astype(np.int64) - hi + length <= np.diff(offsets)[row]  # an id may have other texts too
            key, pos, lo, hi, row = (x[inside] for x in (key, pos, lo, hi, row))
            if not len(key):
                continue
            ids = np.asarray(batch.column("_doc"))[row]
            start = offsets[row] + pos - lo
            if whole:
                size = lo.astype(np.int64) - hi + length
                ends = np.concatenate(([0], np.cumsum(size)))
                held = data[np.repeat(start - ends[:-1], size) + np.arange(int(ends[-1]))]
                held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(pos), pa.array(lo), pa.array(hi), held], ["_key", "_doc", "_pos", "_lo", "_hi", "_bytes"])
            else:
                one, two = _string_ranks(data, length)
                size = lo.astype(np.int64) - hi + 1
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                place = (at - np.repeat(offsets[row], size)).astype(np.int32)
                none = np.zeros(len(at), np.int16)
                yield from _dealt(one[at], two[at].view(np.int64), np.repeat(ids, size), place, none, none)

    return run


def _string_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two ranks for the string at every position, which overlap and together are all its bytes."""
    half = 1 << ((length - 1).bit_length() - 1)
    rank = _doubled(_SYMBOL[data], 1, half)
    return rank[: len(data) - length + 1], rank[length - half :]


def _compared(length: int):
    """From contexts sorted by (key, document, position): stretches of strings that an earlier equal string precedes. A key has ``CROWD`` rows at most."""

    def repeated(key, doc, pos, lo, hi, held: pa.Array) -> pa.RecordBatch | None:
        data, offsets = buffers_of(held)
        one, two = _string_ranks(data, length)
        size = lo.astype(np.int64) - hi + 1
        row = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        one, two = one[offsets[row] + nth], two[offsets[row] + nth]
        name = _pair(one, two)
        order = np.argsort(name, kind="stable")  # rows are in order of document and position
        same = np.zeros(len(order), dtype=bool)
        same[1:] = name[order[1:]] == name[order[:-1]]
        if not (one[order][same] == one[order][np.flatnonzero(same) - 1]).all() or not (two[order][same] == two[order][np.flatnonzero(same) - 1]).all():
            order = np.lexsort((two, one))  # two pairs with one name: sort by the pairs themselves
            same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        heads = np.flatnonzero(~same)
        first = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
        start = pos[row].astype(np.int64) - lo[row] + nth
        flags = np.zeros(len(order), dtype=bool)
        flags[order] = same & ((doc[row[order]] != doc[row[first]]) | (start[order] != start[first]))
        if not flags.any():
            return None
        opens, closes = flags.copy(), flags.copy()
        opens[1:] &= ~(flags[:-1] & (row[1:] == row[:-1]))
        closes[:-1] &= ~(flags[1:] & (row[1:] == row[:-1]))
        begin = np.flatnonzero(opens)
        return pa.RecordBatch.from_arrays([pa.array(doc[row[begin]]), pa.array(start[begin].astype(np.int32)), pa.array((start[closes] + length).astype(np.int32))], schema=_INTERVAL)

    def buffers_of(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        held = held.cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        return np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def judged(table: pa.Table) -> pa.RecordBatch | None:
            table = table.combine_chunks()
            column = lambda c: table.column(c).to_numpy()
            return repeated(*(column(c) for c in ("_key", "_doc", "_pos", "_lo", "_hi")), table.column("_bytes").chunk(0)) if table.num_rows else None

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = pa.Table.from_batches([batch.slice(at, BATCH)])
                held = part if held is None else pa.concat_tables([held, part])
                key = held.column("_key").to_numpy()
                last = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
                if last and (found := judged(held.slice(0, last))) is not None:
                    yield found
                held = held.slice(last).combine_chunks()
        if held is not None and (found := judged(held)) is not None:
            yield found

    return run


def _kept(length: int, texts: bool):
    names = ["_doc", "_null", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            data, offsets = buffers(batch.column("_text"))
            sizes = np.diff(offsets)
            many, found = _listed(batch.column("_found"))
            found = np.asarray(found).astype(np.int64)
            row = np.repeat(np.arange(len(many)), many)
            start, stop = np.minimum(found >> 32, sizes[row]), np.minimum(found & 0xFFFFFFFF, sizes[row])
            change = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(change, offsets[row] + start, 1)
            np.add.at(change, offsets[row] + stop, -1)
            gone = np.cumsum(change)[:-1] > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            cuts = offsets[:-1][sizes > 0]
            first[cuts] = gone[cuts]
            count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
            removed, spans = count(gone), count(first)
            sums, rests = [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                rest = data[lo:hi] if not removed[i] else data[lo:hi][~gone[lo:hi]]
                sums.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    rests.append(rest.tobytes())
            out = [batch.column("_doc"), batch.column("_null"), pa.array(sizes.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(rests, pa.binary())] if texts else []), names + (["kept"] if texts else []))

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts earlier.

    Earlier means in a document of a smaller id, or before in the same
    document. Strings overlap freely and are judged on the input. Returns
    ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, if ``texts``, ``kept``, the remaining bytes (a cut may
    fall inside a character). Columns of the input with these names, and all
    others but id and text, are ignored.

    Null text is empty text; texts shorter than ``length`` lose nothing. A very
    long text is a block by itself: memory is some 40 bytes for each of its own.
    Ids are integers; a null id counts as -2**63. Rows with the same id are
    versions of one document and no repeats of each other: equal rows get equal
    results, and what is repeated at a place in one version goes in all.
    ``length`` is at least 64 and at most 128. Empty tables give empty tables.
    """
    if not 2 * ANCHOR <= length <= 128:
        raise ValueError("length must be from 64 to 128")
    kind = docs.schema[id_col].dataType
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.col(id_col).isNull().alias("_null"), whole.alias("_text"))
    pairs = "_key long, _ctx long, _doc long, _pos int, _lo short, _hi short, _known boolean"
    order = ["_known", "_key", "_ctx", "_doc", "_pos"]
    verdict = "_key long, _doc long, _pos int, _lo short, _hi short, _kind byte"
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_pairs = lambda df: df.repartition(wide, "_key").sortWithinPartitions(*order).mapInArrow(_verdicts, verdict)
    interval = lambda df: df.filter(F.col("_kind") == _SETTLED).select("_doc", (F.col("_pos") - F.col("_lo")).cast("int").alias("_start"), (F.col("_pos") - F.col("_hi") + length).cast("int").alias("_stop"))

    anchors = written(sorted_pairs(rows.select("_doc", "_text").mapInArrow(_anchor_rows(length), pairs)), "anchors")
    stays = anchors.filter(F.col("_kind") == _STAYS).select("_key", "_doc", "_pos", "_lo", "_hi")
    crowded = written(stays.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD).select("_key"), "crowded")

    def with_text(chosen: DataFrame) -> DataFrame:
        lists = chosen.groupBy("_doc").agg(F.collect_list(F.struct("_key", "_pos", "_lo", "_hi")).alias("_stays"))
        return rows.select("_doc", "_text").join(lists, "_doc")

    few = with_text(stays.join(crowded, "_key", "left_anti")).mapInArrow(_context_rows(length, True), "_key long, _doc long, _pos int, _lo short, _hi short, _bytes binary")
    few = few.repartition(wide, "_key").sortWithinPartitions("_key", "_doc", "_pos").mapInArrow(_compared(length), "_doc long, _start int, _stop int")
    found = interval(anchors).unionByName(few)
    if not crowded.isEmpty():
        many = with_text(stays.join(crowded, "_key", "left_semi")).mapInArrow(_context_rows(length, False), pairs)
        found = found.unionByName(interval(sorted_pairs(many)))
    found = written(found, "repeats")

    lists = found.groupBy("_doc").agg(F.collect_list(F.shiftleft(F.col("_start").cast("long"), 32) + F.col("_stop")).alias("_found"))
    schema = "_doc long, _null boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    out = rows.join(lists, "_doc", "left").mapInArrow(_kept(length, texts), schema)
    discard(anchors, crowded)
    return out.select(F.when(~F.col("_null"), F.col("_doc")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))
