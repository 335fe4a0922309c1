"""Jaccard join on word n-grams with token-combination prefixes.

Tokens are shingle hashes; their order is the order of the hashes, so a prefix
is a document's least tokens. The hash space is cut into ranges of two or three
tokens of a document each. All tokens of a document in one range are a
combination and together make a key (a range with one token: a single-token
key). The extended prefix of a document is its first h + 1 + g ranges with
tokens, h being the most tokens by which a partner can differ. A differing
token spoils one range, so two documents that reach the threshold have g + 1
keys in common, or more: no link is lost. How wide a range is follows from the
size of the set, in powers of two; a set is indexed at each width that a
partner may have.

Keys are rare or frequent by the number of sets that have them. A set with g
frequent keys or fewer (from a passage that many documents share) has a rare
key in common with every partner and is found by those alone. Pairs need as
many common rare keys as g + 1 leaves when the frequent ones are allowed for.
Sets that consist of frequent keys to a good part are also compared by those.

Candidates are verified exactly, but never as all pairs of a large key: first a
set against the least set of the keys it has most in common with; then all
others, as pairs for the rare keys (a bounded number each), and for the frequent
ones in chunks, each pair of chunks by one matrix product, which gives a number
of links for each set and the few links that join components. A pair counts at
the least frequent key that both sets are compared by, or as a pair if there is
none, so every link counts once. Equal sets are one node from the start.
Components come from large-star and small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import discard, written
from larkspur.llm.kernels import blocks, buffers, grams, mix, words

#: Sets that have a key from which it counts as frequent.
FREQUENT = 24
#: Tokens that a range holds on average, at least.
COMBINED = 1.75


class _Sets:
    """Distinct sorted shingle hashes of every text of a block."""

    def __init__(self, batch: pa.RecordBatch, n: int):
        data, offsets = buffers(batch.column("_text"))
        hashed, _, counts = words(data, offsets)
        ends = np.cumsum(counts)
        every = grams(hashed, n)
        self.sets: list[np.ndarray] = []
        salt = np.uint64(0x632BE59BD9B4E019)
        for lo, m in zip((ends - counts).tolist(), counts.tolist(), strict=True):
            if m >= n:
                self.sets.append(np.unique(every[lo : lo + m - n + 1]))
            elif m:  # the whole sequence, told apart by its number of words
                self.sets.append(mix(grams(hashed[lo : lo + m], m) + np.full(1, m, np.uint64) * salt))
            else:
                self.sets.append(np.zeros(0, np.uint64))


    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and a 64-bit name of every set; 0 for the empty set."""
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        if not sizes.sum():
            return sizes, np.zeros(len(sizes), np.int64)
        every = np.concatenate(self.sets)
        ends = np.cumsum(sizes)
        one, two = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (mix(every + np.uint64(1)), mix(every ^ np.uint64(0xA0761D6478BD642F))))
        name = mix((one[ends] - one[ends - sizes]) * np.uint64(0xE7037ED1A0B428DB) + mix(two[ends] - two[ends - sizes]) + sizes.astype(np.uint64))
        return sizes, np.where(sizes > 0, name.view(np.int64), 0)


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            sizes, node = _Sets(batch, n).nodes()
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), pa.array(node)], ["_id", "_n", "_node"])

    return run


def _differ(size: int, percent: int) -> int:
    """|x ^ y| <= (100 - t) / t * |x| for partners, t the threshold in percent."""
    return (100 - percent) * size // percent


def _spare(size: int, percent: int) -> int:
    return _differ(size, percent) // 4


def _ranges(s: np.ndarray, level: int, need: int) -> list[tuple[int, np.ndarray]]:
    """Keys of the first ``need`` ranges with tokens, the hash space being cut into 2 ** level ranges.

    A set with fewer ranges than it needs gives all of them, and goes on to the
    next level; so does its partner, until one of the two has enough.
    """
    out = []
    while True:
        which = s >> np.uint64(64 - level) if level else np.zeros(len(s), np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        combined = np.add.reduceat(mix(s ^ np.uint64(level + 1)), starts)
        out.append((level, mix(combined + (which[starts] * np.uint64(64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15))[:need]))
        if len(starts) >= need or level >= 63:
            return out
        level += 1


def _keys(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(level, keys) of a set. Of two partners both have the level of the larger one."""
    at = lambda m: max(0, math.floor(math.log2(max(1, m) / COMBINED)))
    need = _differ(len(s), percent) + 1 + _spare(len(s), percent)
    found: dict[int, np.ndarray] = {}
    for level in range(at(len(s)), at(len(s) * 100 // percent) + 1):
        if level not in found:
            found |= dict(_ranges(s, level, need))
    return list(found.items())


def _key_rows(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            sets = _Sets(batch, n)
            _, nodes = sets.nodes()
            _, once = np.unique(nodes, return_index=True)  # equal sets of a block are indexed once
            keys, many, levels, rows, need = [], [], [], [], []
            for i in once.tolist():
                s = sets.sets[i]
                if len(s):
                    least = 1 + _spare(-(-percent * len(s) // 100), percent)
                    for level, found in _keys(s, percent):
                        keys.append(found), many.append(len(found)), levels.append(level), rows.append(nodes[i]), need.append(least)
            if not keys:
                continue
            keys = np.concatenate(keys).view(np.int64)
            rows, levels, need = (np.repeat(np.array(x), many) for x in (rows, levels, need))
            for i in range(0, len(keys), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(rows[cut]), pa.array((levels[cut] + 64 * need[cut]).astype(np.int32))], ["_key", "_node", "_how"])

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, node): those of keys with two nodes or more, and whether the key is frequent.

    A key may have any number of rows; of one that goes on in the next batch no
    more than FREQUENT rows are held back, for then it is known to be frequent.
    """
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)]
    running = None  # a frequent key, and its last node, whose rows have been sent
    last_node = None

    def out(key, node, how, frequent):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(how), pa.array(frequent)], ["_key", "_node", "_how", "_frequent"])

    def split(key, node, how, final):
        nonlocal held, running, last_node
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        if running is not None and len(key) and key[0] == running and node[0] == last_node:
            fresh[0] = False
        key, node, how = key[fresh], node[fresh], how[fresh]
        if not len(key):
            return None
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(heads, len(key)))
        size = np.repeat(many, many)
        frequent = size > FREQUENT
        live = size > 1
        if running is not None and key[0] == running:
            frequent[: many[0]] = live[: many[0]] = True
        tail = slice(heads[-1], len(key))
        if not final and not frequent[-1]:
            held = [key[tail], node[tail], how[tail]]
            live[tail] = False
            running = None
        else:
            held = [x[:0] for x in (key, node, how)]
            running, last_node = (key[-1], node[-1]) if not final else (None, None)
        return out(key[live], node[live], how[live], frequent[live]) if live.any() else None

    for batch in batches:
        if batch.num_rows:
            key, node, how = (np.concatenate((h, np.asarray(batch.column(c)))) for h, c in zip(held, ("_key", "_node", "_how"), strict=True))
            if (got := split(key, node, how, False)) is not None:
                yield got
    if len(held[0]) and (got := split(*held, True)) is not None:
        yield got


def _packed(s: np.ndarray) -> bytes:
    """A set as byte planes of the differences between its shingles' upper 48 bits, which compress well. Two sets of a thousand shingles differ by that in one of 10 ** 8 cases."""
    steps = np.diff(s >> np.uint64(16), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpacked(value: pa.BinaryScalar) -> np.ndarray:
    planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _packed_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            sets = _Sets(batch, n)
            own = np.flatnonzero(sets.nodes()[1] == np.asarray(batch.column("_node")))  # an id may have other texts too
            yield pa.RecordBatch.from_arrays([batch.column("_node").take(pa.array(own)), pa.array([_packed(sets.sets[i]) for i in own.tolist()], pa.binary())], ["_node", "_set"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("_a").filter(good), batch.column("_b").filter(good)], ["_a", "_b"])

    return run


def _forest(linked: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as join what all of them join; sets of one label are joined already."""
    left = np.ones(len(label), dtype=bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for start in range(len(label)):
        stack = [start] if left[start] else []
        left[start] = False
        while stack:
            x = stack.pop()
            kin = np.flatnonzero(left & (label == label[x]))
            left[kin] = False
            stack += kin.tolist()
            found = np.flatnonzero(linked[x] & left)
            _, once = np.unique(label[found], return_index=True)
            found = found[once]
            left[found] = False
            a.append(np.full(len(found), x)), b.append(found)
            stack += found.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([*a, none]).astype(np.int64), np.concatenate([*b, none]).astype(np.int64)


def _compared(percent: int):
    """Links between two chunks of a key's sets, or within one: common shingles by a matrix product.

    Rows ``(_a, _b, null)`` are links that join sets which aren't in one
    component, one at most for each set; rows ``(_a, null, n)`` the number of
    links of a set with those that it has no lesser frequent key in common with.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label, own = (table.column(c).to_numpy() for c in ("_node", "_label", "_own"))
        new_pair = node[:, None] < node[None, :]
        if table.column("_i")[0].as_py() != table.column("_j")[0].as_py():
            new_pair &= own[:, None] != own[None, :]
        new_pair &= ~_met(table.column("_often"), table.column("_key")[0].as_py())
        if not new_pair.any():
            return _COMPARED.empty_table()
        sets = [_unpacked(x) for x in table.column("_set")]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        new = np.concatenate(([True], every[1:] != every[:-1]))
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # a shingle of one set alone is common to no two
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 2048
        bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
        for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            has = np.zeros((len(sets), width), np.float32)
            has[owner[lo:hi], column[lo:hi] - k * width] = 1
            common += has @ has.T
        union = size[:, None] + size[None, :] - common
        good = (100 * common >= percent * union) & new_pair
        good |= good.T
        many = good.sum(axis=1, dtype=np.int64)
        a, b = _forest(good & (label[:, None] != label[None, :]), label)
        has = many > 0
        links = pa.table([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.nulls(len(a), pa.int64())], schema=_COMPARED)
        return pa.concat_tables([links, pa.table([pa.array(node[has]), pa.nulls(int(has.sum()), pa.int64()), pa.array(many[has])], schema=_COMPARED)])

    return run


_COMPARED = pa.schema([("_a", pa.int64()), ("_b", pa.int64()), ("_n", pa.int64())])


def _met(often: pa.ChunkedArray, key: int) -> np.ndarray:
    """Which two sets have a frequent key below ``key`` in common."""
    lists = [np.asarray(x.values.to_numpy()) for x in often]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keys = np.concatenate(lists)
    owner, keys = owner[keys < key], keys[keys < key]
    column = np.unique(keys, return_inverse=True)[1]
    met = np.zeros((len(lists), len(lists)), dtype=bool)
    width = 2048
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, width):
        inside = (column >= lo) & (column < lo + width)
        has = np.zeros((len(lists), width), np.float32)
        has[owner[inside], column[inside] - lo] = 1
        met |= has @ has.T > 0
    return met


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_y"))
    two = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_x"))
    return pairs.join(one.hint("merge"), "_b").join(two.hint("merge"), "_a").select("_a", "_b", "_x", "_y").mapInArrow(_verified(percent), "_a long, _b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(_node, _label) for every node of a link ``(_a, _b)``; the label is the least node reachable.

    Alternating large-star and small-star rounds, each written to the shared
    folder; their number grows with the logarithm of the number of nodes.
    """
    edges = written(links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).filter("_u <> _v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = both.filter("_v > _u").join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).filter("_u <> _v").distinct()
        large = written(large, "edges")
        low = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(low, "_u").select(F.greatest("_v", "_m").alias("_p"), F.least("_v", "_m").alias("_q"))
        small = small.unionByName(low.select(F.col("_u").alias("_p"), F.col("_m").alias("_q"))).filter("_p <> _q")
        after = written(small.select(F.col("_p").alias("_u"), F.col("_q").alias("_v")).distinct(), "edges")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_u", "_v").cast("decimal(20,0)")).alias("h")).first()
        discard(edges, large)
        edges = after
        if state == before or not state["n"]:
            break
        before = state
    return edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_label")).unionByName(edges.select(F.col("_v").alias("_node"), F.col("_v").alias("_label"))).distinct()


#: Sets, and about as many shingles, that a chunk of a frequent key has at most.
CHUNK, CHUNK_TOKENS = 1024, 1 << 19
#: Candidate sets up to which their ids are sent to every task instead of shuffling all texts.
BROADCAST_IDS = 200_000


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """Documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more, and what that links.

    Words are runs outside white space with A-Z lower-cased. A text with fewer
    than ``n`` words has its whole sequence as its one shingle; null, empty and
    blank texts have none and link with nothing. Returns one row for each row
    of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` (the least id
    reachable by links, its own included) and ``n_links`` (the number of other
    sets that its set is linked with, each counted once). Without ``count_links``
    that column is left out, and sets that are known to be in one component, whose
    comparison can't change it, are not compared again. Ids are
    integers; a null id counts as the smallest and is returned as null. Rows that
    repeat an id are compared as separate texts; an id with several texts takes
    part in the components of all of them, and each row shows its own text's. A
    very long text is a block by itself. An empty table gives an empty table.
    Other columns of ``docs`` are ignored, so none can clash.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("_id"), F.col(text_col).alias("_text"))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profiles = written(rows.mapInArrow(_profiles(n), "_id long, _n long, _node long"), "profiles")
    firsts = profiles.filter("_n > 0").groupBy("_node").agg(F.min("_id").alias("_first"))

    # Keys and sets are joined by merge at every size: they grow with the texts, and a
    # plan that broadcasts them on a small input says nothing about a large one.
    keys = rows.select("_text").mapInArrow(_key_rows(n, percent), "_key long, _node long, _how int")
    live = keys.repartition(wide, "_key").sortWithinPartitions("_key", "_node").mapInArrow(_live, "_key long, _node long, _how int, _frequent boolean")
    live = written(live, "live-keys")
    # A set with fewer frequent keys than any partner has in common with it has a rare one in common with each.
    level, need = F.col("_how") % 64, F.shiftright("_how", 6)
    counted = live.filter("_frequent").groupBy("_node", "_how").agg(F.count(F.lit(1)).cast("int").alias("_many"))
    rare = live.filter("not _frequent").join(counted.hint("merge"), ["_node", "_how"], "left")
    rare = written(rare.select("_key", "_node", level.cast("byte").alias("_level"), need.alias("_need"), F.coalesce("_many", F.lit(0)).alias("_hidden")), "rare-keys")
    # The others share as many frequent keys as they need, so one of them is among the first ones but those.
    place = F.row_number().over(Window.partitionBy("_node", "_how").orderBy("_key"))
    often = live.filter("_frequent").join(counted.hint("merge"), ["_node", "_how"]).filter(F.col("_many") >= need).withColumn("_place", place)
    often = written(often.filter(F.col("_place") <= F.col("_many") - need + 1).select("_key", "_node", level.cast("int").alias("_level")), "frequent-keys")
    discard(live)

    # What two partners have in common at the level where they meet: rare keys, all but the frequent ones.
    least = lambda n1, n2, h1, h2: F.greatest(F.lit(1), F.greatest(n1, n2) - F.greatest(h1, h2))
    leaders = rare.groupBy("_key").agg(F.min(F.struct("_node", "_need", "_hidden")).alias("_lead"))
    best = rare.join(leaders.hint("merge"), "_key").filter("_node <> _lead._node").groupBy("_node", F.col("_lead._node").alias("_a"), "_level").agg(F.count(F.lit(1)).alias("_many"), F.max(least(F.col("_need"), F.col("_lead._need"), F.col("_hidden"), F.col("_lead._hidden"))).alias("_least"))
    best = best.filter("_many >= _least").groupBy("_node").agg(F.max(F.struct("_many", "_a")).alias("_best"))
    more = often.join(often.groupBy("_key").agg(F.min("_node").alias("_a")).hint("merge"), "_key").filter("_node <> _a").groupBy("_node", "_a").agg(F.count(F.lit(1)).alias("_many")).groupBy("_node").agg(F.max(F.struct("_many", "_a")).alias("_best"))
    first_pairs = written(best.unionByName(more).select(F.col("_best._a").alias("_a"), F.col("_node").alias("_b")).distinct(), "pairs")

    ends = lambda pairs: pairs.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = written(nodes.join(firsts, "_node").select("_node", F.col("_first").alias("_id")), "wanted")
        chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        return written(rows.join(chosen, "_id").select("_node", "_text").mapInArrow(_packed_sets(n), "_node long, _set binary"), "sets")

    sets = sets_of(ends(first_pairs))
    links = written(_links(first_pairs, sets, percent), "links")
    labels = written(components(links), "labels")
    label = F.coalesce(F.col("_label"), F.col("_node"))
    side = lambda n: rare.select("_key", F.col("_node").alias(f"_{n}"), F.col("_need").alias(f"_n{n}"), F.col("_hidden").alias(f"_h{n}"), *(["_level"] if n == "a" else []))
    others = side("a").join(side("b").hint("merge"), "_key").filter("_a < _b").groupBy("_a", "_b", "_level").agg(F.count(F.lit(1)).alias("_many"), F.max(least(F.col("_na"), F.col("_nb"), F.col("_ha"), F.col("_hb"))).alias("_least"))
    others = others.filter("_many >= _least").select("_a", "_b").distinct()
    done = first_pairs.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    others = others.join(done.hint("merge"), ["_a", "_b"], "left_anti")
    if not count_links:
        named = lambda c: labels.select(F.col("_node").alias(c), F.col("_label").alias(f"_l{c}"))
        others = others.join(named("_a"), "_a", "left").join(named("_b"), "_b", "left").filter(F.coalesce("_l_a", "_a") != F.coalesce("_l_b", "_b")).select("_a", "_b")
    others = written(others, "pairs")

    crowd = often.join(labels.hint("merge"), "_node", "left").withColumn("_label", label)
    sizes = crowd.groupBy("_key").agg(F.count(F.lit(1)).alias("_many"), (F.min("_label") != F.max("_label")).alias("_apart")).filter("_many > 1")
    sizes = (sizes if count_links else sizes.filter("_apart")).drop("_apart")
    chunk = F.greatest(F.lit(16.0), F.least(F.lit(float(CHUNK)), F.lit(float(CHUNK_TOKENS)) / F.pow(F.lit(2.0), F.col("_level") + 2)))
    crowd = crowd.join(sizes.hint("merge"), "_key").withColumn("_parts", F.ceil(F.col("_many") / chunk).cast("int")).withColumn("_own", F.pmod(F.xxhash64("_node", "_key"), F.col("_parts")).cast("int"))
    crowd = written(crowd.select("_key", "_node", "_label", "_own", "_parts"), "crowds")

    needed = ends(others).unionByName(crowd.select("_node")).distinct().join(sets.hint("merge"), "_node", "left_anti")
    sets = sets.unionByName(sets_of(needed))
    single = written(links.unionByName(_links(others, sets, percent)).select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links")
    lists = written(often.groupBy("_node").agg(F.collect_set("_key").alias("_often")), "frequent-lists")
    dealt = crowd.select("_key", "_node", "_label", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_with")).withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with"))
    dealt = dealt.join(sets.hint("merge"), "_node").join(lists.hint("merge"), "_node").select("_key", "_i", "_j", "_own", "_node", "_label", "_often", "_set")
    blocked = written(dealt.groupBy("_key", "_i", "_j").applyInArrow(_compared(percent), "_a long, _b long, _n long"), "compared")
    labels = components(single.unionByName(blocked.filter("_n is null").select("_a", "_b")).distinct())

    if not count_links:
        single, blocked = single.limit(0), blocked.limit(0)
    # Pairs with a frequent key in common have been counted there.
    listed = lambda c: lists.select(F.col("_node").alias(c), F.col("_often").alias(f"_o{c}"))
    alone = single.join(listed("_a"), "_a", "left").join(listed("_b"), "_b", "left").filter(~F.coalesce(F.arrays_overlap("_o_a", "_o_b"), F.lit(False)))
    degrees = alone.select(F.explode(F.array("_a", "_b")).alias("_node"), F.lit(1).cast("long").alias("_n"))
    degrees = degrees.unionByName(blocked.filter("_n is not null").select(F.col("_a").alias("_node"), "_n")).groupBy("_node").agg(F.sum("_n").alias("_links"))
    heads = labels.join(firsts, "_node").groupBy("_label").agg(F.min("_first").alias("_component"))
    named = labels.join(heads, "_label").select("_node", "_component")
    placed = profiles.filter("_n > 0").join(firsts, "_node", "left").join(named, "_node", "left").join(degrees, "_node", "left")
    bare = profiles.filter("_n = 0").withColumns({"_first": F.lit(None).cast("long"), "_component": F.lit(None).cast("long"), "_links": F.lit(None).cast("long")})  # texts without words meet nobody
    out = placed.unionByName(bare)
    own = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.coalesce("_component", "_first"))
    back = lambda c: F.when(c != low, c).cast(kind)
    return out.select(back(F.col("_id")).alias(id_col), F.col("_n").alias("n_shingles"), back(own).alias("component_id"), *([F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []))
