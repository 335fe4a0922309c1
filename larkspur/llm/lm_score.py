"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of words are quantised to a logarithmic scale. A
count at step q is stored as q members (n-gram, 1) .. (n-gram, q) of a Bloom
filter; a count is read back by probing step after step until one is missing.
Besides the n-grams the filter has, for every word that pairs start with, how
often and how many of them it starts. A text is scored with

    p(w | v) = (c(v w) + t(v) p(w)) / (c(v) + t(v)),    p(w) = (c(w) + 1) / (N + V + 1)

(Witten and Bell), every count coming from the filter. It has all words and pairs,
or those that are seen ``min_count`` times or more; a word that starts no pair
gives p(w). Its size follows the number of members. The
part with the words is sent to every worker; that with the pairs is cut into
shards of ``shard_mb`` and sent shard after shard, the texts being read once for
each. The driver passes a shard on in pieces of 16 MB and holds one of them.

Words are summed in each task before they are shuffled. Pairs are named by 64
bits, 36 of which name the first word, so that those of one word lie together;
they are sorted in each task and travel as packed byte planes. A range of first
words is one part: where it is merged, its pairs are counted and its part of the
filter is filled, with what its words start, so no pair travels twice. The pairs
of words seen ``spread_from`` times or more are dealt to all parts, and what these
words start is summed from there. Exact counts for ``base_score`` come from a
table of the most frequent words, bounded by ``most_words``; all rarer words are
joined with their counts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written
from larkspur.llm.kernels import blocks, buffers, mix, release, words

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KINDS = {"word": np.uint64(0x2545F4914F6CDD1D), "pair": np.uint64(0xC2B2AE3D27D4EB4F), "uses": np.uint64(0x369DEA0F31A53F85), "kinds": np.uint64(0xDB4F0B9175AE2165)}
#: Bytes of a segment of the filter, bits that a member has there, and those it sets: about one false hit in 100.
SEGMENT, BITS, PROBES = 1 << 20, 12, 4
#: Bytes of text that are handled at once, and of which pairs are sorted at once.
PART, SORTED = (1 << 20) - 4096, 12 << 20
#: Distinct words that a task holds before it passes them on.
HELD = 1 << 21
#: Bits of the name of a pair that name its first word, and those that are left.
HISTORY_BITS = 36
_LOW = np.uint64(64 - HISTORY_BITS)
#: Bytes of a pair that travels: the step to its name, and its count.
_PLANES = 8 + 4
#: Bytes of the filter of the pairs that the driver passes on at once, and the 64-bit words that a part has at least.
PIECE, LEAST = 16 << 20, 1 << 13


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end; the text of each; the number of each text."""
    data, offsets = buffers(texts)
    hashed, _, counts = words(data, offsets)
    many = counts + 1
    ends = np.cumsum(many) - 1
    out = np.empty(int(many.sum()), np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[ends] = False
    out[place] = hashed
    out[ends] = _END
    return out, np.repeat(np.arange(len(many)), many), many


def _before(token: np.ndarray, text: np.ndarray) -> np.ndarray:
    """History of every token."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    first = np.ones(len(token), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    before[first] = _START
    return before


def _pair_name(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return (before >> _LOW << _LOW) | (mix(before * _PAIR + token) >> np.uint64(HISTORY_BITS))


def _history_name(name: np.ndarray) -> np.ndarray:
    """Name of the first word, from the word or from the pair."""
    return name >> _LOW


def _part(name: np.ndarray, spread: np.ndarray | bool, parts: int) -> np.ndarray:
    """Part of each pair: one for all of a first word, or any, by the pair, for those that are ``spread``."""
    return (((np.where(spread, mix(name), name) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _member(name: np.ndarray, kind: str) -> np.ndarray:
    return mix(name ^ _KINDS[kind])


def _flags(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=bool)


def _summed(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate(names), return_inverse=True)
    return own, np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the training texts of a task with their counts, summed as far as ``HELD`` allows."""
    names, counts, many = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        own, count = _summed(names, counts)
        for i in range(0, len(own), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(own[part].view(np.int64)), pa.array(count[part])], ["_word", "_count"])

    for batch in blocks(batches, "_text", PART):
        token, text, _ = _tokens(batch.column("_text"))
        own, count = np.unique(token[_flags(batch.column("_train"))[text]], return_counts=True)
        names.append(own), counts.append(count)
        many += len(own)
        if many > 2 * HELD:
            own, count = _summed(names, counts)
            names, counts, many = [own], [count], len(own)
            if many > HELD:
                yield from out()
                names, counts, many = [], [], 0
    if names:
        yield from out()
    names, counts = [], []
    release()


def _packed(values: np.ndarray, width: int) -> bytes:
    """Byte planes of unsigned integers, the lowest first."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def _pair_planes(made: Made, parts: int, step: int):
    """Pairs of words that the filter has, in training texts: names in order and counts, packed for each part. Those of words that reach ``step`` are spread."""

    def packed(name: np.ndarray, spread: bool) -> pa.RecordBatch:
        name, count = np.unique(name, return_counts=True)
        part = _part(name, spread, parts)
        if spread:
            order = np.argsort(part, kind="stable")
            name, count, part = name[order], count[order], part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        found = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            found.append(_packed(np.diff(name[lo:hi], prepend=np.uint64(0)), 8) + _packed(count[lo:hi], 4))
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array([spread] * len(found)), pa.array(found, pa.binary())], ["_part", "_spread", "_planes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made.on_worker(1.0, 1)
        held, weight = {False: [], True: []}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for spread, names in held.items():
                name = np.concatenate(names) if names else np.zeros(0, np.uint64)
                names.clear()
                if len(name):
                    yield packed(name, spread)
            release()

        for batch in blocks(batches, "_text", PART):  # words are found in small blocks, and their pairs held
            token, text, _ = _tokens(batch.column("_text"))
            own, at = np.unique(token, return_inverse=True)
            member = _member(own, "word")
            frequent, often = (known.count(member) > 0)[at], known.reaches(member, step)[at]
            before = _before(token, text)
            first = before == _START
            use = _flags(batch.column("_train"))[text] & frequent
            use[1:] &= frequent[:-1] | first[1:]
            spread = first
            spread[1:] |= often[:-1]
            name, spread = _pair_name(before[use], token[use]), spread[use]
            held[False].append(name[~spread]), held[True].append(name[spread])
            weight += len(name)
            if 6 * weight > SORTED:  # a token has some six bytes
                yield from out()
                weight = 0
        yield from out()

    return run


def _pair_filter(min_count: int, base: float):
    """The filter of a part: its pairs that are seen often enough, with the uses and kinds of their first words; those of spread words as numbers, to be summed."""

    def run(table: pa.Table) -> pa.Table:
        held = {False: ([], []), True: ([], [])}
        for value, spread in zip(table.column("_planes"), table.column("_spread").to_pylist(), strict=True):
            planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(_PLANES, -1)
            names, counts = held[spread]
            names.append(np.cumsum(_unpacked(planes[:8]), dtype=np.uint64)), counts.append(_unpacked(planes[8:]).astype(np.int64))
        members, seen, apart = [], [], b""
        for spread, (names, counts) in held.items():
            if not names:
                continue
            name, count = _summed(names, counts)
            names.clear(), counts.clear()
            name, count = name[count >= min_count], count[count >= min_count]
            members.append(_member(name, "pair")), seen.append(count)
            history = _history_name(name)
            heads = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))[: len(name)]
            uses, kinds = np.add.reduceat(count, heads) if len(name) else count, np.diff(np.append(heads, len(name)))
            if spread:
                apart = np.stack([history[heads].view(np.int64), uses, kinds]).tobytes()
            else:
                members += [_member(history[heads], "uses"), _member(history[heads], "kinds")]
                seen += [uses, kinds]
        member, steps = np.concatenate(members), _steps(np.concatenate(seen), base)
        total = int(steps.sum())
        bits = np.zeros(max(LEAST, math.ceil(total * BITS / 64)), np.uint64)
        left, q = np.arange(len(member)), 1
        while len(left):
            word, own = _places(member[left], q, np.uint64(len(bits)))
            np.bitwise_or.at(bits, word, own)
            q += 1
            left = left[steps[left] >= q]
        part = table.column("_part")[0].as_py()
        out = pa.table({"_part": pa.array([part], pa.int64()), "_members": pa.array([total], pa.int64()), "_top": pa.array([q - 1], pa.int64()), "_bits": pa.array([bits.tobytes()], pa.binary()), "_apart": pa.array([apart], pa.binary())})
        release()
        return out

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First words whose pairs are spread, with the uses and kinds that a part has."""
    for batch in batches:
        for value in batch.column("_apart"):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(value.as_buffer(), np.int64).reshape(3, -1)], ["_name", "_uses", "_kinds"])


def _steps(count: np.ndarray, base: float) -> np.ndarray:
    """Step 1 for a count of 1, one more for each factor of ``base``, rounded."""
    return 1 + np.rint(np.log(np.maximum(count, 1)) / math.log(base)).astype(np.int64)


def _places(member: np.ndarray, step: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a step of each n-gram, in a part of ``size`` words, and its bits in that word."""
    one = mix(member + np.uint64(step * int(_STEP) % (1 << 64)))
    bits = np.zeros(len(one), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((one >> np.uint64(40 + 6 * i)) & np.uint64(63))
    return (((one & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)).astype(np.int64), bits


def _segment(member: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each n-gram, the same for all its steps."""
    return ((member >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def _build(segments: int, base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            member = np.asarray(batch.column("_member")).view(np.uint64)
            steps = _steps(np.asarray(batch.column("_count")), base)
            left, q = np.arange(len(member)), 1
            while len(left):
                segment = _segment(member[left], segments)
                word, bits = _places(member[left], q, np.uint64(SEGMENT // 8))
                for s in np.unique(segment).tolist():
                    inside = segment == s
                    np.bitwise_or.at(held.setdefault(s, np.zeros(SEGMENT // 8, np.uint64)), word[inside], bits[inside])
                q += 1
                left = left[steps[left] >= q]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["_part", "_bits"])

    return run


class PartedFilter:
    """Quantised counts of n-grams on a worker: parts of the filter, each of its own size, in the pieces in which the driver passed them on.

    ``places``: of each part its piece, its start there and its size, in 64-bit words. ``top`` is the largest step that was stored: no count is read beyond it, however full the filter is.
    """

    def __init__(self, pieces: list[bytes | np.ndarray], places: np.ndarray, base: float, top: int):
        self.pieces, self.base, self.top = [np.frombuffer(x, np.uint64) for x in pieces], base, top
        self.piece, self.start, self.size = places

    def count(self, member: np.ndarray, part: np.ndarray) -> np.ndarray:
        """About the count of each n-gram of the part, 0 if the filter doesn't have it."""
        return _read(self._step(member, part, range(1, self.top + 1)), self.base)

    def _step(self, member: np.ndarray, part: np.ndarray, asked: range) -> np.ndarray:
        """The last of the steps asked for, one after the other, until one is missing; 0 if the first is."""
        step, piece = np.zeros(len(member), np.int64), self.piece[part]
        for i, held in enumerate(self.pieces):
            left = np.flatnonzero(piece == i)
            start, size = self.start[part[left]], self.size[part[left]].astype(np.uint64)
            for q in asked:
                if not len(left):
                    break
                word, bits = _places(member[left], q, size)
                found = (held[start + word] & bits) == bits
                left, start, size = left[found], start[found], size[found]
                step[left] = q
        return step


class CountFilter(PartedFilter):
    """The same in equal segments, to which the n-grams themselves are dealt; in one piece if ``places`` isn't given."""

    def __init__(self, bits: bytes | list[np.ndarray], segments: int, base: float, top: int, places: np.ndarray | None = None):
        if places is None:
            bits, places = [bits], np.stack([np.zeros(segments, np.int64), np.arange(segments) * (SEGMENT // 8), np.full(segments, SEGMENT // 8)])
        super().__init__(bits, places, base, top)
        self.segments = segments

    def count(self, member: np.ndarray) -> np.ndarray:
        return super().count(member, _segment(member, self.segments))

    def reaches(self, member: np.ndarray, step: int) -> np.ndarray:
        """Whether the filter has each n-gram at ``step`` and the step before it; the same on every worker."""
        return self._step(member, _segment(member, self.segments), range(max(1, step - 1), step + 1)) == step


def _read(step: np.ndarray, base: float) -> np.ndarray:
    """Count that a step stands for."""
    return np.where(step > 0, np.power(base, np.maximum(step - 1, 0)), 0.0)


#: Begins the bytes of a piece, by which a worker finds them in the file of the broadcast; with it they are aligned there.
_MARK = b"larkspur-pieces:"
_MARKED = _MARK.rjust(len(_MARK) + -(pickle.dumps(b"\1" * (1 << 17), pickle.HIGHEST_PROTOCOL).index(b"\1" * 64)) % 8, b"\0")


def _sent(spark, parts: list[bytes]):
    return spark.sparkContext.broadcast(b"".join([_MARKED, *parts]))


def _bits(sent) -> np.ndarray:
    """Bits of a piece on a worker: mapped from the file of the broadcast, which the workers of an executor share, or loaded where there is none."""
    if path := getattr(sent, "_path", None):
        with open(path, "rb") as file:
            at = file.read(256).find(_MARK)
        if at >= 0:
            data = np.memmap(path, np.uint8, "r")[at + len(_MARK) :]
            return np.asarray(data[: len(data) // 8 * 8]).view(np.uint64)  # the pickle's end follows
    return np.frombuffer(sent.value[len(_MARKED) :], np.uint64)


def _passed_on(parts: DataFrame, places: np.ndarray) -> list:
    """Broadcasts of the bits of the parts (_part, _bits), made piece by piece; ``places`` gets the piece of each part and its start there."""
    sent, held, weight = [], [], 0

    def send() -> None:
        sent.append(_sent(parts.sparkSession, held))
        held.clear()

    for row in parts.select("_part", "_bits").toLocalIterator():
        if held and weight + len(row["_bits"]) > PIECE:
            send()
            weight = 0
        places[:2, row["_part"]] = len(sent), weight // 8
        held.append(bytes(row["_bits"]))
        weight += len(held[-1])
    if held:
        send()
    release()
    return sent


class Made:
    """A filter of (_member, _count) in equal segments, built by the workers and passed on to them. ``counts``: their _count, read first for the size."""

    def __init__(self, members: DataFrame, counts: DataFrame, base: float):
        step = F.lit(1) + F.round(F.log(F.col("_count").cast("double")) / math.log(base))
        n = counts.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("n"), F.coalesce(F.max(step), F.lit(1.0)).alias("top")).first()
        self.segments, self.top = max(1, math.ceil(n["n"] * BITS / (8 * SEGMENT))), int(n["top"]) + 1
        number = F.pmod(F.shiftrightunsigned("_member", 32), F.lit(self.segments)).cast("int")
        spark = members.sparkSession
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.places = np.full((3, self.segments), SEGMENT // 8, np.int64)
        self.places[0] = -1  # a segment without members isn't built
        self.pieces = _passed_on(members.repartition(min(self.segments, 4 * wide), number).mapInArrow(_build(self.segments, base), "_part int, _bits binary"), self.places)

    def on_worker(self, base: float, top: int | None = None) -> CountFilter:
        return CountFilter([_bits(x) for x in self.pieces], self.segments, base, top or self.top, self.places)


def _named(kinds: dict[str, str]):
    """Members (_member, _count) from columns of names and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = np.asarray(batch.column("_name")).view(np.uint64)
            members = np.concatenate([_member(name, kind) for kind in kinds])
            yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.array(np.concatenate([np.asarray(batch.column(c)) for c in kinds.values()]))], ["_member", "_count"])

    return run


def _scores(words_made: Made, often_made: Made, pieces: list, places, top: int, table, base: float, step: int, total: int, vocabulary: int, shard: int):
    """Scores of the tokens whose pair is in a part of the shard; in the first one also the counts of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, often = words_made.on_worker(base), often_made.on_worker(base)
        shards = places.value[3]
        double = PartedFilter([_bits(x) for x in pieces], places.value[:3], base, top)
        word, count = (np.frombuffer(x, np.uint64) for x in table.value)
        for batch in blocks(batches, "_text", PART):
            token, text, many = _tokens(batch.column("_text"))
            own, at = np.unique(token, return_inverse=True)
            member = _member(own, "word")
            alone = (single.count(member) + 1) / (total + vocabulary + 1)
            # Histories: the words, and the start of a text.
            first, spread = np.append(own, _START), np.append(single.reaches(member, step), True)
            history, part = _history_name(first), _part(first, False, len(shards))
            mine = ~spread & (shards[part] == shard)
            kinds, uses = np.zeros(len(history)), np.zeros(len(history))
            for name, found in (("kinds", kinds), ("uses", uses)):
                found[spread] = often.count(_member(history[spread], name))
                found[mine] = double.count(_member(history[mine], name), part[mine])
                mine &= kinds > 0
            before = np.empty_like(at)
            before[1:] = at[:-1]
            before[np.cumsum(many) - many] = len(own)
            named = _pair_name(first[before], token)
            home = shards[_part(named, spread[before], len(shards))] == shard
            asked = np.flatnonzero(home & (kinds[before] > 0))
            pair, one, back = np.unique(named[asked], return_index=True, return_inverse=True)
            both = np.zeros(len(token))
            both[asked] = double.count(_member(pair, "pair"), _part(pair, spread[before[asked[one]]], len(shards)))[back]
            t, c, p = kinds[before], uses[before], alone[at]
            p = np.where(t > 0, (both + t * p) / np.maximum(np.maximum(c, both) + t, 1), p)
            sums = lambda x: np.bincount(text, weights=x, minlength=len(many))  # noqa: B023, E731
            score = sums(np.where(home, np.log10(np.minimum(p, 1.0)), 0.0))
            if len(word):
                spot = np.minimum(np.searchsorted(word, own), len(word) - 1)
                c = np.where(word[spot] == own, count[spot], 0).astype(np.int64)[at]
            else:
                c = np.zeros(len(token), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), batch.column("_train"), pa.array(many), pa.array(sums(c > 0).astype(np.int64)), pa.array(sums(np.log10(c + 1.0))), pa.array(score)], ["_id", "_hash", "_train", "_many", "_known", "_logs", "_score"])
            release()
        del single, often, double, word, count
        release()

    return run


def _rare_words(table):
    """Words of every text that the table doesn't have, with their number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = np.frombuffer(table.value[0], np.uint64)
        for batch in blocks(batches, "_text", PART):
            token, text, _ = _tokens(batch.column("_text"))
            own, at = np.unique(token, return_inverse=True)
            rare = (np.isin(own, word, assume_unique=True, invert=True))[at]
            if not rare.any():
                continue
            pair, many = np.unique(text[rare].astype(np.int64) * len(own) + at[rare], return_counts=True)
            row = pa.array(pair // len(own))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(row), batch.column("_hash").take(row), pa.array(own[pair % len(own)].view(np.int64)), pa.array(many)], ["_id", "_hash", "_word", "_many"])

    return run


def _most_frequent(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Words and counts of the most frequent words, at most ``most``, in order of the words, and the table of all rarer ones. Cut between classes of counts, of which there are some 500."""
    kind = F.floor(F.log2(F.col("_count").cast("double")) * 8)
    least, n = None, 0
    for row in sorted(counted.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["k"]):
        n += row["n"]
        if n > most:
            break
        least = row["k"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), counted
    found = counted.filter(kind >= least).select("_word", "_count").toArrow()
    word = found.column("_word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], found.column("_count").to_numpy().view(np.uint64)[order], counted.filter(kind < least)


def score_texts(docs: DataFrame, held_out: Column, min_count: int = 1, base: float = 1.3, shard_mb: float = 256, most_words: int = 2_000_000, spread_from: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts under a model of the texts that aren't held out.

    Tokens are the words (A-Z lower-cased) and the end of the text. Returns for
    every row ``id_col``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (add-one unigram, exact counts)
    and ``score``, the model's log10 probability; other columns are ignored, so
    none can clash. Null text is empty text, its only token the end. A null in
    ``held_out`` means the row is trained on. Repeated rows count as often as they
    occur, and each gets its score. A very long text is handled as a block by
    itself, in some 100 bytes of memory for each of its bytes. With nothing to
    train on every score is that of the smoothing alone. An empty table gives an
    empty table. ``docs`` is read several times.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    named = kind.simpleString()
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole).alias("_hash"), (~F.coalesce(held_out, F.lit(False))).alias("_train"), whole.alias("_text"))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))

    counted = rows.select("_train", "_text").mapInArrow(_word_counts, "_word long, _count long")
    counted = written(counted.groupBy("_word").agg(F.sum("_count").alias("_count")), "lm-words")
    seen = counted.agg(F.coalesce(F.sum("_count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, vocabulary = seen["n"], seen["v"]
    frequent = counted.filter(F.col("_count") >= min_count).select(F.col("_word").alias("_name"), "_count")
    words_made = Made(frequent.mapInArrow(_named({"word": "_count"}), "_member long, _count long"), frequent.select("_count"), base)

    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    parts = max(4 * wide, math.ceil(size / SORTED))
    step = int(_steps(np.array([spread_from]), base)[0])
    planes = rows.select("_train", "_text").mapInArrow(_pair_planes(words_made, parts, step), "_part long, _spread boolean, _planes binary")
    # Row groups of a part or two, so that those of other shards aren't read.
    pairs = written(planes.groupBy("_part").applyInArrow(_pair_filter(min_count, base), "_part long, _members long, _top long, _bits binary, _apart binary"), "lm-pairs", "uncompressed", **{"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1})
    apart = pairs.select("_apart").mapInArrow(_apart, "_name long, _uses long, _kinds long").groupBy("_name").agg(F.sum("_uses").alias("_uses"), F.sum("_kinds").alias("_kinds"))
    apart = written(apart, "lm-often")
    often_made = Made(apart.mapInArrow(_named({"uses": "_uses", "kinds": "_kinds"}), "_member long, _count long"), apart.select(F.explode(F.array("_uses", "_kinds")).alias("_count")), base)

    # Of each part: its piece and its start there, its size, its shard.
    places, weight, top = np.zeros((4, parts), np.int64), np.zeros(parts, np.int64), 1
    places[0] = -1
    for row in pairs.select("_part", "_members", "_top", F.octet_length("_bits").alias("_size")).toLocalIterator():
        weight[row["_part"]], places[2, row["_part"]], top = row["_members"], row["_size"] // 8, max(top, row["_top"])
    shards = max(1, math.ceil(weight.sum() * BITS / 8 / (shard_mb * (1 << 20))))
    places[3] = (np.cumsum(weight) - weight) * shards // max(1, weight.sum())

    *often, rarer = _most_frequent(counted, most_words)
    has_rarer = len(often[0]) < vocabulary
    table = spark.sparkContext.broadcast(tuple(often))
    del often
    release()
    out = None
    for shard in np.unique(places[3]).tolist():
        own = np.flatnonzero(places[3] == shard)
        pieces = _passed_on(pairs.filter(F.col("_part").between(int(own[0]), int(own[-1]))), places)
        asked = spark.sparkContext.broadcast(places)
        scored = rows.mapInArrow(_scores(words_made, often_made, pieces, asked, top, table, base, step, total, vocabulary, shard), f"_id {named}, _hash long, _train boolean, _many long, _known long, _logs double, _score double")
        if shards > 1:  # a filter is freed before the next one is sent
            scored = written(scored, "lm-scores")
            for sent in [*pieces, asked]:
                sent.destroy()
        if out is None:
            out = scored
            continue
        more = scored.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.max("_score").alias("_more"))
        out = out.join(more, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).withColumn("_score", F.col("_score") + F.col("_more")).drop("_i", "_h", "_more")

    known, logs = F.col("_known"), F.col("_logs")
    if has_rarer:
        rare = rows.select("_id", "_hash", "_text").mapInArrow(_rare_words(table), f"_id {named}, _hash long, _word long, _many long")
        # Dealt by word once, for the join and for leaving out repeated rows.
        rare = rare.repartition("_word").groupBy("_id", "_hash", "_word").agg(F.max("_many").alias("_many"))
        rare = rare.join(rarer, "_word").groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.sum("_many").alias("_k"), F.sum(F.col("_many") * F.log10(F.col("_count") + 1)).alias("_l"))
        out = out.join(rare, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
        known, logs = known + F.coalesce("_k", F.lit(0)), logs + F.coalesce("_l", F.lit(0.0))
    base_score = logs - F.col("_many") * math.log10(total + vocabulary + 1)
    return out.select(F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), F.col("_many").alias("n_tokens"), known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), F.col("_score").alias("score"))
