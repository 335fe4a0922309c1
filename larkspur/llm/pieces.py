"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

The pieces and their order come from a SentencePiece model; a piece of rank r
has log probability -temperature * log(r + 2). All segmentations of a text form
a lattice. Forward filtering sums the probability of all paths to each place;
backward sampling draws the last piece, then the one before it, and so on, each
in proportion to the paths through it, which samples whole segmentations from
their exact distribution. The random numbers are hashes of the row's key, the
seed and the place, so a row always gets the same segmentation.

As in the model, a space stands before the text and spaces belong to the piece
after them. No piece crosses the start of a run of spaces or a line end, so the
lattice falls into units that are independent given the text; equal units of a
block share their forward sums, every occurrence draws for itself. A character
that no piece has (among them the space sign itself) is spelt in byte pieces,
so decoding gives the text back to the byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import _BYTE, _tables, blocks, buffers, mix, release

_MARK = "▁"
#: Bytes from which a unit is looked at for places that no piece crosses, and is segmented by itself; bytes of it that are handled at once.
LONG, WINDOW = 256, 1 << 16
#: Log probability of a byte piece.
BYTE_LOG = -12.0


class Pieces:
    """Pieces of a model: a double-array trie over their bytes, and the scores. Plain arrays, so that it can be broadcast."""

    def __init__(self, model_file: str, temperature: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * size
        self.log = np.full(size, -np.inf)
        rank = sorted((i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))), key=lambda i: (-model.get_score(i), i))
        for r, i in enumerate(rank):
            self.bytes[i] = model.id_to_piece(i).replace(_MARK, " ").encode()
            self.log[i] = -temperature * math.log(r + 2)
        for i in range(size):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes[i], self.log[i] = i, bytes([b]), BYTE_LOG
        self.longest = max(map(len, self.bytes))
        self._plant({self.bytes[i]: i for i in rank})
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _plant(self, ids: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        final: list[int] = [-1]
        for piece, i in sorted(ids.items()):
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    final.append(-1)
                node = children[node][b]
            final[node] = i
        size = 8 * len(children) + 1024
        self.base, self.check, self.piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, free, top = {0: 0}, 257, 257
        for node in range(len(children)):  # parents come before their children
            own = sorted(children[node])
            if not own:
                continue
            while used[free]:
                free += 1
            # A single child fills the first gap; brothers are looked for near the end, so that planting stays linear.
            base = max(1, (free if len(own) == 1 else max(free, top - 512)) - own[0])
            while any(used[base + b] for b in own):
                base += 1
            top = max(top, base + own[-1] + 1)
            self.base[place[node]] = base
            for b in own:
                child = children[node][b]
                place[child] = base + b
                used[base + b] = 1
                self.check[base + b], self.piece[base + b] = place[node], final[child]


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units of all texts."""
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    control = data < 32
    start |= control
    start[1:] |= control[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def _lattice(pieces: Pieces, data: np.ndarray, starts: int) -> np.ndarray:
    """[length, start]: the piece of each length at the first ``starts`` bytes, -1 where there is none; characters without a piece as byte pieces."""
    longest = pieces.longest
    found = np.full((longest + 1, starts), -1, np.int32)
    node, where = np.zeros(starts, np.int32), np.arange(starts)
    for n in range(1, longest + 1):
        ok = where + n <= len(data)
        node, where = node[ok], where[ok]
        after = np.minimum(pieces.base[node] + data[where + n - 1], len(pieces.check) - 1)
        ok = (pieces.check[after] == node) & (after > 0)
        node, where = after[ok], where[ok]
        if not len(node):
            break
        found[n, where] = pieces.piece[node]
    lead = data[:starts]
    width = _char_width(lead)
    chars = np.flatnonzero(width)
    lone = chars[found[np.minimum(width[chars], longest), chars] < 0]
    spelt = np.repeat(lone, width[lone]) + (np.arange(int(width[lone].sum())) - np.repeat(np.cumsum(width[lone]) - width[lone], width[lone]))
    spelt = spelt[spelt < starts]
    # A character that began before these bytes: its bytes here are spelt if no piece covers them.
    found[1, spelt] = pieces.byte_id[lead[spelt]]
    return found


def _char_width(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))


def _windows_of(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a unit that begin with a character."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + WINDOW)
        while stop < len(data) and 0x80 <= data[stop] < 0xC0:
            stop += 1
        yield start, stop
        start = stop


def _uncrossed(pieces: Pieces, data: np.ndarray) -> np.ndarray:
    """Characters inside a unit before which every segmentation breaks, as no piece crosses their start."""
    change = np.zeros(len(data) + pieces.longest + 2, np.int32)
    for start, stop in _windows_of(data):
        found = _lattice(pieces, data[start : stop + pieces.longest], stop - start)
        for n in range(2, pieces.longest + 1):
            at = np.flatnonzero(found[n] >= 0) + start
            change[at + 1] += 1
            change[at + n] -= 1
    crossed = np.cumsum(change)[: len(data)] > 0
    crossed[0] = True
    return np.flatnonzero(~crossed & ((data < 0x80) | (data >= 0xC0)))


def _long_unit(pieces: Pieces, data: np.ndarray, noise) -> tuple[list[int], list[int]]:
    """Ends and ids of the pieces of a sampled segmentation of one unit, the last one first.

    The forward sums are kept for every byte, the lattice for one window at a time.
    """
    log, longest = np.append(pieces.log, -np.inf), pieces.longest
    alpha = np.full(len(data) + 1 + longest, -np.inf)  # the tail takes what is written past the end
    alpha[0] = 0.0
    stretches = list(_windows_of(data))
    for start, stop in stretches:
        found = _lattice(pieces, data[start : stop + longest], stop - start)
        weight = np.ascontiguousarray(log[found[1:]].T)  # [start, length]
        for i in np.flatnonzero((found >= 0).any(axis=0)).tolist():
            if alpha[start + i] > -np.inf:
                np.logaddexp(alpha[start + i + 1 : start + i + 1 + longest], alpha[start + i] + weight[i], out=alpha[start + i + 1 : start + i + 1 + longest])
    ends, ids, end = [], [], len(data)
    held, base = None, len(data) + 1
    while end > 0:
        if max(0, end - longest) < base:  # the lattice of the bytes before
            base = max(0, end - WINDOW)
            while base and 0x80 <= data[base] < 0xC0:
                base -= 1
            held = _lattice(pieces, data[base : end + longest], end - base)
        reach = min(longest, end)
        n = np.arange(1, reach + 1)
        own = held[n, end - n - base]
        share = np.exp(alpha[end - n] + log[own] - alpha[end])
        total = np.cumsum(share)
        k = int(np.searchsorted(total, noise(end), side="right"))
        if k >= reach or share[k] <= 0:  # rounding
            k = int(np.flatnonzero(share > 0)[-1])
        ends.append(end), ids.append(int(own[k]))
        end -= k + 1
    return ends, ids


def encode_block(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and their offsets. A space stands before each text that isn't empty."""
    n_texts = len(offsets) - 1
    sizes = np.diff(offsets)
    full = sizes > 0
    moved = offsets + np.concatenate(([0], np.cumsum(full)))
    text = np.full(int(moved[-1]), 32, np.uint8)
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
    text[np.repeat(moved[:-1] + full - offsets[:-1], sizes) + np.arange(len(data))] = data
    starts = _units(text, moved)
    lengths = np.diff(np.append(starts, len(text)))
    for at, size in [(a, n) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True) if n >= LONG]:
        starts = np.append(starts, at + _uncrossed(pieces, text[at : at + size]))
    starts = np.sort(starts)
    lengths = np.diff(np.append(starts, len(text)))
    long = lengths >= LONG
    longs, starts, lengths = list(zip(starts[long].tolist(), lengths[long].tolist(), strict=True)), starts[~long], lengths[~long]
    chosen = np.full(len(text) + 1, -1, np.int32)
    key = mix(keys.astype(np.uint64) + np.uint64(seed % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15))

    def random(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Between 0 and 1, from the key, the seed and the place in the text."""
        noise = mix(key[owner] + (place - moved[owner]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return (noise >> np.uint64(11)).astype(np.float64) / (1 << 53)

    for at, size in longs:
        who = np.searchsorted(moved, [at], side="right") - 1
        ends, ids = _long_unit(pieces, text[at : at + size], lambda end: random(who, np.array([at + end]))[0])  # noqa: B023
        chosen[at + np.array(ends)] = ids
    if not len(starts):
        ends = np.flatnonzero(chosen >= 0)
        return chosen[ends], np.searchsorted(ends, moved, side="right")
    powers, inverse = _tables(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * powers[: len(text)], out=total[1:])
    names = mix((total[starts + lengths] - total[starts]) * inverse[starts] + lengths.astype(np.uint64))
    _, first, back = np.unique(names, return_index=True, return_inverse=True)

    # Distinct units, the longest first, each with a free place at its end.
    order = np.argsort(-lengths[first], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, unit = first[order], rank[back]
    size = lengths[first]
    at = np.cumsum(size + 1) - (size + 1)
    buffer = np.zeros(int((size + 1).sum()), np.uint8)
    inside = np.repeat(at, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    buffer[inside] = text[np.repeat(starts[first], size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))]
    longest = min(pieces.longest, int(size[0]))
    found = np.full((longest + 1, len(buffer)), -1, np.int32)  # [length, start]
    node, where = np.zeros(len(inside), np.int32), inside
    limit = np.repeat(at + size, size)
    for n in range(1, longest + 1):
        ok = where + n <= limit
        node, where, limit = node[ok], where[ok], limit[ok]
        after = pieces.base[node] + buffer[where + n - 1]
        after = np.minimum(after, len(pieces.check) - 1)
        ok = (pieces.check[after] == node) & (after > 0)
        node, where, limit = after[ok], where[ok], limit[ok]
        if not len(node):
            break
        found[n, where] = pieces.piece[node]
    # Characters without a piece are spelt in bytes.
    width = _char_width(buffer[inside])
    chars, width = inside[width > 0], width[width > 0]
    lone = found[np.minimum(width, longest), chars] < 0
    chars, width = chars[lone], width[lone]
    spelt = np.repeat(chars, width) + (np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width))
    found[1, spelt] = pieces.byte_id[buffer[spelt]]

    log = np.append(pieces.log, -np.inf)  # the last one: no piece
    alpha = np.full(len(buffer), -np.inf)
    alpha[at] = 0.0
    for j in range(1, int(size[0]) + 1):
        active = int(np.searchsorted(-size, -j, side="right"))
        end = at[:active] + j
        acc = np.full(active, -np.inf)
        for n in range(1, min(j, longest) + 1):
            acc = np.logaddexp(acc, alpha[end - n] + log[found[n, end - n]])
        alpha[end] = acc
    share = np.zeros((longest + 1, len(buffer)), np.float32)  # [length, end]: of the last piece
    for n in range(1, longest + 1):
        begin = np.flatnonzero(found[n] >= 0)
        share[n, begin + n] = np.exp(alpha[begin] + log[found[n, begin]] - alpha[begin + n])

    # Backward, all occurrences at once.
    owner = np.searchsorted(moved, starts, side="right") - 1
    left, base = lengths.copy(), at[unit]
    live = np.arange(len(starts))
    while len(live):
        end, place = base[live] + left[live], starts[live] + left[live]
        u = random(owner[live], place)
        took, most, acc = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live))
        for n in range(1, min(longest, int(left[live].max())) + 1):
            w = share[n, end]
            acc += w
            took[(took == 0) & (acc > u) & (w > 0)] = n
            most[w > 0] = n
        took = np.where(took > 0, took, most)  # rounding
        chosen[place] = found[took, end - took]
        left[live] -= took
        live = live[left[live] > 0]
    ends = np.flatnonzero(chosen >= 0)
    return chosen[ends], np.searchsorted(ends, moved, side="right")


def decode_block(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and their offsets, without the space before each."""
    size = pieces.lengths[ids]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = pieces.flat[np.repeat(pieces.starts[ids] - ends[:-1], size) + np.arange(int(ends[-1]))]
    bounds = ends[offsets]
    full = np.diff(bounds) > 0
    keep = np.ones(len(data), dtype=bool)
    keep[bounds[:-1][full]] = False
    return data[keep], bounds - np.concatenate(([0], np.cumsum(full)))


def _texts(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary()).cast(pa.string())


def _encode(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text", 1 << 19):
            data, offsets = buffers(batch.column("_text"))
            ids, bounds = encode_block(shared.value, data, offsets, np.asarray(batch.column("_key")).view(np.uint64), seed)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            rest = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*rest, lists], [*batch.schema.names[:-2], "_ids"])
            release()

    return run


#: Pieces that are decoded at once; a longer text stands alone.
DECODED = 1 << 18


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            counts = np.asarray(pc.fill_null(pc.list_value_length(whole.column(whole.num_columns - 1)), 0)).astype(np.int64)
            ends, start = np.cumsum(counts), 0
            while start < len(counts):
                before = int(ends[start - 1]) if start else 0
                stop = min(len(counts), max(start + 1, int(np.searchsorted(ends, before + DECODED, side="right"))))
                batch = whole.slice(start, stop - start)
                ids = np.asarray(pc.list_flatten(batch.column(batch.num_columns - 1)))
                texts = _texts(*decode_block(shared.value, ids, np.concatenate(([0], ends[start:stop] - before))))
                rest = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, texts], [*batch.schema.names[:-1], "_decoded"])
                start = stop

    return run


#: Bytes of text that are encoded and decoded at once.
CODED = 1 << 18


def _encode_decode(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text", CODED):
            data, offsets = buffers(batch.column("_text"))
            ids, bounds = encode_block(shared.value, data, offsets, np.asarray(batch.column("_key")).view(np.uint64), seed)
            rest = [batch.column(i) for i in range(batch.num_columns - 2)]
            texts = _texts(*decode_block(shared.value, ids, bounds))
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), texts], [*batch.schema.names[:-2], "_ids", "_decoded"])
            release()

    return run


def encode(docs: DataFrame, pieces, seed: int = 0, key: Column | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """All columns of ``docs`` and ``ids_col``, a sampled segmentation of the whole text.

    ``pieces`` is a broadcast :class:`Pieces`. ``key`` (default: a hash of
    ``id_col``) and ``seed`` fix the sample: rows with equal keys and texts get
    equal segmentations. Null and empty texts have no pieces, an empty table gives
    an empty table. An input column called ``ids_col`` is replaced; no other name
    can clash. A long stretch without spaces is cut where no piece crosses; one
    that can't be cut is segmented by itself, with 8 bytes kept for each of its bytes.
    """
    key = F.xxhash64(id_col) if key is None else key
    cols = [c for c in docs.columns if c != ids_col]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"), key.cast("long").alias("_key"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema[:-2])
    return renamed.mapInArrow(_encode(pieces, seed), f"{fields}, _ids array<int>").toDF(*cols, ids_col)


def encode_decode(docs: DataFrame, pieces, seed: int = 0, key: Column | None = None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str = "decoded") -> DataFrame:
    """The columns ``keep`` (default: all), ``ids_col`` as of :func:`encode` and what :func:`decode` makes of it: a block is decoded where it is encoded, by one worker instead of two."""
    key = F.xxhash64(id_col) if key is None else key
    cols = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"), key.cast("long").alias("_key"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in renamed.schema[:-2])
    return renamed.mapInArrow(_encode_decode(pieces, seed), f"{fields}_ids array<int>, _decoded string").toDF(*cols, ids_col, decoded_col)


def decode(rows: DataFrame, pieces, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``rows`` but ``ids_col``, and the text its pieces spell. Null and empty lists spell empty text."""
    cols = [c for c in rows.columns if c not in (ids_col, text_col)]
    renamed = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col(ids_col).alias("_ids"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema[:-1])
    return renamed.mapInArrow(_decode(pieces), f"{fields}, _decoded string").toDF(*cols, text_col)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary files are; the path is a parameter of :class:`Pieces`."""
    import public_tokenizers

    return public_tokenizers.path(name)
