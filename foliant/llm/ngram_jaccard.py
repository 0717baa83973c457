"""N-gram Jaccard join: exact links between shingle sets, found through pivots, Voronoi regions and triangle-inequality windows.

The outer level's pivots are single shingles. A set is at distance 1 - 1/n from each of its own shingles and at 1 from
all others; with ties broken by one global order (rare first) its Voronoi region is its first shingle. Two sets within
the join distance must share a shingle among their first n - ceil(t * n) + 1 ones, so the window that each set is
replicated to is exactly those regions. (Whole documents as outer pivots give nothing: nearly every document is at
distance 1 from nearly every pivot, and every window then covers everything.)

Inside a region the pivots are documents. Every member is first compared with one pivot; members linked to it are one
component and need no comparison with each other. Small regions then give their pairs between components. Regions that are
still large are split again and again: members go to their nearest of several pivots, and to every other pivot that is
farther by no more than twice the join distance, which by the triangle inequality keeps each linked pair in one region.
What is smaller, or what no pivot splits, is compared in tiles. Bounds from parity bits rule most pairs out before texts are compared.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, at_most, in_groups, removed, scratch_folder, sized_join, slices, staged, table, task, text_bytes
from .components import components
from .lm_scores import mix

_U = np.uint64
#: Shingles met at least LEAST_TOLD times are counted; the counts of the TOLD_KEYS most frequent (as whole powers of two of
#: the count) are told to all workers, the others count as equally rare. The order decides speed, never results.
LEAST_TOLD, TOLD_KEYS = 4, 2_000_000
#: Shingles sorted together before they are counted.
PACK_KEYS = 1_000_000
#: Regions of up to so many different sets give their pairs where they are found.
SMALL_CELL = 64
#: Regions of more than SPLIT members in different components are split by so many pivots, again and again up to DEPTH times;
#: others are compared in tiles of TILE by TILE members, which up to SPLIT members costs less than the distances to pivots.
PIVOTS, DEPTH, TILE, SPLIT = 8, 6, 512, 8192
#: Rounds of comparing tiles. All but the last give only the likeliest partner of each member of a tile with more than so many pairs a
#: member: its links join components, and the next round has less to compare.
ROUNDS, PAIRS_PER_MEMBER = 4, 2
#: A region that keeps more than this share of its members is not split further.
STALLED = 0.8
#: Members of a pivot that are compared in one task.
PER_TASK = 64
#: Bits of a frequent shingle by which its place is known; between places it is searched for.
PLACE_BITS = 21

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = _U(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the words of all texts, A-Z in lower case, text behind text; and the number of words of each text."""
    whole = b"\n".join([*texts, bytes(8)]).lower()  # words are read by eight bytes, the last one too
    white = _WHITE[np.frombuffer(whole, np.uint8)[: len(whole) - 8]]
    edges = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    n = (ends - starts + 7) // 8
    offsets = np.cumsum(n) - n
    piece = np.arange(n.sum()) - np.repeat(offsets, n)
    at = np.repeat(starts, n) + 8 * piece
    eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))[at] & _LOW_BYTES[np.minimum(np.repeat(ends, n) - at, 8)]
    keys = np.add.reduceat(mix(mix(eight) + piece.astype(np.uint64) * _ODD), offsets)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix(keys + (ends - starts).astype(np.uint64) * _ODD), np.diff(np.searchsorted(starts, begin))


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    h = ids[:n] + _U(width)
    for j in range(1, width):
        h = mix(h * _ODD + ids[j : n + j])
    return mix(h)


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit keys of its k-word shingles; of all its words as one if there are fewer; empty without words."""
    ids, n = word_ids(texts)
    rolled = _rolled(ids, k) if len(ids) >= k else ids[:0]
    found = []
    for end, size in zip(np.cumsum(n).tolist(), n.tolist(), strict=True):
        at = end - size
        if size >= k:
            found.append(_sorted_distinct(rolled[at : end - k + 1]))
        else:
            found.append(_rolled(ids[at:end], size) if size else ids[:0])
    return found


def shingle_set(text: bytes, k: int) -> np.ndarray:
    return shingle_sets([text], k)[0]


def all_shingles(texts: list[bytes], k: int) -> np.ndarray:
    """The keys of all texts' shingles, repeats included, in no order."""
    ids, n = word_ids(texts)
    ends = np.cumsum(n)
    short = [_rolled(ids[end - size : end], size) for end, size in zip(ends[n < k].tolist(), n[n < k].tolist(), strict=True) if size]
    if len(ids) < k:
        return np.concatenate([ids[:0], *short])
    left = np.repeat(ends, n) - np.arange(len(ids))  # shingles that cross the end of a text are none
    return np.concatenate([_rolled(ids, k)[left[: len(ids) - k + 1] >= k], *short])


class _Counts:
    """Counts of sorted keys of so many bits, for many keys at once."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        size = min(PLACE_BITS, bits)
        self.keys, self.counts, self.shift = keys, counts, _U(bits - size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << size))]).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for others."""
        place = (keys >> self.shift).astype(np.int64)
        at, end, out = self.first[place], self.first[place + 1], np.zeros(len(keys), np.uint32)
        look = np.flatnonzero(at < end)
        while len(look):
            there, key = self.keys[at[look]], keys[look]
            met = look[there == key]
            out[met] = self.counts[at[met]]
            look = look[there < key]
            at[look] += 1
            look = look[at[look] < end[look]]
        return out


def node_key(keys: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)


def linked(shared: int, a: int, b: int, num: int, den: int) -> bool:
    return shared > 0 and den * shared >= num * (a + b - shared)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _buckets(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return 1 << min(18, max(5, math.ceil(math.log2(max(1, size / (4 << 20))))))


def shingle_counts(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(keys, counts, levels) by ranges of keys: how often each shingle is met in all texts, from LEAST_TOLD times on.

    A key stands for the shingles that share its first 32 + log2(buckets) bits. levels has the number of keys by powers of two of the count.
    """
    import pyarrow as pa

    bits = buckets.bit_length() - 1
    names = ["bucket", "once", "more", "times"]

    def flush(held):
        keys = np.sort(np.concatenate(held) >> _U(32 - bits))
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        cuts = np.searchsorted(keys >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            low, times = (keys[cuts[i] : cuts[i + 1]] & _U(0xFFFFFFFF)).astype(np.uint32), n[cuts[i] : cuts[i + 1]]
            single = times == 1
            rows.append((i, low[single].tobytes(), low[~single].tobytes(), times[~single].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 3], strict=True)], names)

    def pack(batches):
        held, size = [], 0
        for batch in slices(batches, 4 << 20):
            for part in in_groups(batch.column(0).to_pylist(), 4 << 20):
                held.append(all_shingles(part, k))
                size += len(held[-1])
                if size >= max(PACK_KEYS, 64 * buckets):
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def counted(bucket, parts):
        keys, n = np.unique(np.concatenate([np.frombuffer(p[0], np.uint32) for p in parts]), return_counts=True)
        keys = np.concatenate([keys, *(np.frombuffer(p[1], np.uint32) for p in parts)])
        n = np.concatenate([n, *(np.frombuffer(p[2], np.uint32) for p in parts)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[new], np.add.reduceat(n, new)
        keep = n >= LEAST_TOLD
        keys, n = keys[keep].astype(np.int64) + (np.int64(bucket) << 32), n[keep]
        levels = np.bincount(np.log2(n).astype(np.int64), minlength=63).tolist()
        return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([levels], pa.list_(pa.int64()))], ["keys", "counts", "levels"])

    def count(batches):
        at, parts = None, []
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != bucket and parts:
                    yield counted(at, parts)
                    parts = []
                at = bucket
                parts.append(blobs)
        if parts:
            yield counted(at, parts)

    dealt = docs.select("t").mapInArrow(task(pack), "bucket int, once binary, more binary, times binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(task(count), "keys binary, counts binary, levels array<long>")


def told_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the most frequent shingles, at most TOLD_KEYS of them: all those from some power of two on."""
    import pyarrow as pa

    levels = {r["pos"]: r["n"] for r in counts.select(F.posexplode("levels").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    total, least = 0, 1
    for power in range(62, -1, -1):
        total += levels.get(power, 0)
        if total > TOLD_KEYS:
            least = 1 << (power + 1)
            break

    def often(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([keys[n >= least].tobytes()], pa.binary()), pa.array([n[n >= least].tobytes()], pa.binary())], ["keys", "counts"])

    found = counts.select("keys", "counts").mapInArrow(often, "keys binary, counts binary").collect()  # at most TOLD_KEYS keys
    keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in found] + [np.empty(0, np.int64)]).astype(np.uint64)
    n = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in found] + [np.empty(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], np.minimum(n[order], (1 << 32) - 1).astype(np.uint32)


def sets_and_cells(docs: DataFrame, told: tuple[np.ndarray, np.ndarray], k: int, num: int, den: int, buckets: int) -> DataFrame:
    """Rows of two kinds, from one reading of the texts; told are the counts of frequent shingles.

    kind 0: id, n and node (a key of the set; 0 without words) of each document. kind 1: per bucket the packed cells,
    nodes and sizes of the windows of many documents.
    """
    import pyarrow as pa

    frequent = docs.sparkSession.sparkContext.broadcast(told)
    bits = buckets.bit_length() - 1
    names = ["kind", "id", "n", "node", "bucket", "cells", "nodes", "sizes"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def window(keys: np.ndarray, often: np.ndarray, p: int) -> np.ndarray:
        rare = keys[often == 0]
        return rare[:p] if len(rare) >= p else keys[np.argsort(often, kind="stable")[:p]]

    def flush(held):
        cells = mix(np.concatenate([c for c, _, _ in held]))
        lengths = [len(c) for c, _, _ in held]
        nodes, sizes = np.repeat([x for _, x, _ in held], lengths), np.repeat([n for _, _, n in held], lengths)
        bucket = (cells >> _U(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cells = (cells >> _U(32 - bits)).astype(np.uint32)[order]
        nodes, sizes = nodes[order].astype(np.int64), sizes[order].astype(np.uint32)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        there = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        blobs = [[x[cuts[b] : cuts[b + 1]].tobytes() for b in there] for x in (cells, nodes, sizes)]
        none = [None] * len(there)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[1] * len(there), none, none, none, there, *blobs], types, strict=True)], names)

    def run(batches):
        held, size, counts = [], 0, _Counts(*frequent.value, 32 + bits)
        for batch in slices(batches):
            ids, ns, nodes = batch.column(0).to_pylist(), [], []
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            often, at = counts.of(np.concatenate([np.empty(0, np.uint64), *sets]) >> _U(32 - bits)), 0
            for keys in sets:
                ns.append(len(keys))
                nodes.append(node_key(keys) if len(keys) else 0)
                if len(keys):
                    held.append((window(keys, often[at : at + len(keys)], prefix_length(len(keys), num, den)), nodes[-1], len(keys)))
                    size += len(held[-1][0])
                    at += len(keys)
                if size >= max(250_000, 16 * buckets):
                    yield flush(held)
                    held, size = [], 0
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[0] * len(ids), ids, ns, nodes, none, none, none, none], types, strict=True)], names)
        if held:
            yield flush(held)

    return docs.select("id", "t").mapInArrow(task(run), "kind int, id long, n long, node long, bucket int, cells binary, nodes binary, sizes binary")


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate([*pairs, np.empty((2, 0), np.int64)], axis=1)
    both = both[:, np.lexsort((both[1], both[0]))]
    return both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)])[: both.shape[1]]]


def cell_candidates(cells: DataFrame, num: int, den: int) -> DataFrame:
    """From packed cells: rows of kind 0 are pairs (p, m) of a pivot and a member, kind 2 all other pairs of small cells, kind 1 members (cell, node, n) of large cells.

    A small cell's pivot is its least node, so that cells with the same members ask for the same pairs.
    """
    import pyarrow as pa

    names = ["kind", "p", "m", "cell", "node", "n"]

    def rows(kind: int, *columns: np.ndarray):
        n = len(columns[0])
        none = pa.nulls(n, pa.int64())
        mine = [pa.array(c.astype(np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *([none, none, *mine] if kind == 1 else [*mine, none, none, none])], names)

    def joined(bucket: int, parts):
        cell, node, size = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in enumerate((np.uint32, np.int64, np.uint32)))
        order = np.lexsort((node, size, cell))
        cell, node, size = cell[order], node[order], size[order].astype(np.int64)
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])])
        cell, node, size = cell[new], node[new], size[new]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lengths = np.diff(np.append(starts, len(cell)))
        length, pivot = np.repeat(lengths, lengths), np.repeat(np.minimum.reduceat(node, starts), lengths)
        keep = length > 1
        cell, node, size, length, pivot = cell[keep], node[keep], size[keep], length[keep], pivot[keep]
        if not len(cell):
            return
        stars, others = [], []
        small = length <= SMALL_CELL
        for d in range(1, min(SMALL_CELL, int(length.max()))):
            near = np.flatnonzero(small[:-d] & (cell[:-d] == cell[d:]) & (size[d:] * num <= size[:-d] * den))
            a, b = node[near], node[near + d]
            star = (a == pivot[near]) | (b == pivot[near])
            least, most = np.minimum(a, b), np.maximum(a, b)  # the pivot is the least node
            stars.append(np.stack([least[star], most[star]]))
            others.append(np.stack([least[~star], most[~star]]))
        crowd = np.flatnonzero(~small)
        if len(crowd):
            c_cell, c_node, c_size, c_pivot = cell[crowd], node[crowd], size[crowd], pivot[crowd]
            yield rows(1, (np.int64(bucket) << 32) + c_cell.astype(np.int64), c_node, c_size)
            at = np.repeat(c_size[np.flatnonzero(c_node == c_pivot)], np.bincount(np.cumsum(np.concatenate([[0], c_cell[1:] != c_cell[:-1]]))))
            fit = (c_size * num <= at * den) & (at * num <= c_size * den) & (c_node != c_pivot)
            stars.append(np.stack([c_pivot[fit], c_node[fit]]))
        for kind, pairs in ((0, stars), (2, others)):
            both = _distinct(pairs)
            if both.shape[1]:
                yield rows(kind, both[0], both[1])

    def run(batches):
        at, parts = None, []
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != bucket and parts:
                    yield from joined(at, parts)
                    parts = []
                at = bucket
                parts.append(blobs)
        if parts:
            yield from joined(at, parts)

    dealt = cells.select("bucket", "cells", "nodes", "sizes").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(task(run), "kind int, p long, m long, cell long, node long, n long")


def _meeting(pairs: DataFrame, of_node: DataFrame, folder: str) -> DataFrame:
    """(p, task, role, node, n, x): each pivot (role 0) followed by members (role 1), with what of_node (node, n, x) says of them.

    A pivot's members are dealt over tasks, and the pivot goes to each of them.
    """
    busy = pairs.groupBy("p").count().where(F.col("count") > PER_TASK).select("p", F.ceil(F.col("count") / PER_TASK).alias("tasks"))
    dealt = staged(sized_join(pairs, busy, ["p"], "left").select("p", "m", F.pmod(F.xxhash64("m"), F.coalesce("tasks", F.lit(1))).cast("int").alias("task")), folder)
    members = dealt.select(F.col("m").alias("node"), "p", "task", F.lit(1).alias("role"))
    asked = members.unionByName(dealt.select(F.col("p").alias("node"), "p", "task", F.lit(0).alias("role")).distinct())
    asked = of_node.join(F.broadcast(asked) if at_most(asked, BROADCAST_ROWS) else asked, "node").select("p", "task", "role", "node", "n", "x")
    return asked.repartition("p", "task").sortWithinPartitions("p", "task", "role")


def _met(batches, prepare):
    """(pivot's node, n and x, member's node, n and x) of the rows of _meeting, batch by batch; prepare is applied to each x once."""
    at = pivot = None
    for batch in batches:
        out = []
        for p, task, role, node, n, x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            x = prepare(x)
            if role == 0:
                at, pivot = (p, task), (node, n, x)
            elif at == (p, task):
                out.append((pivot, (node, n, x)))
        yield out


def plausible(pairs: DataFrame, bits: DataFrame, num: int, den: int, folder: str) -> DataFrame:
    """The pairs whose parity bits do not rule a link out; a tenth of the texts' bytes travel for it."""
    import pyarrow as pa

    def run(batches):
        for met in _met(batches, lambda x: np.frombuffer(x, np.uint64)):
            kept = []
            for (p, n, a), (m, k, b) in met:
                size = min(len(a), len(b))
                differ = np.bitwise_xor.reduce(a.reshape(-1, size), axis=0) ^ np.bitwise_xor.reduce(b.reshape(-1, size), axis=0)
                if int(np.bitwise_count(differ).sum()) * (num + den) <= (n + k) * (den - num):
                    kept.append((p, m))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["p", "m"])

    return _meeting(pairs, bits.withColumnRenamed("bits", "x"), folder).mapInArrow(task(run), "p long, m long")


def measure(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int, folder: str) -> DataFrame:
    """(p, m, far, link) of each pair of nodes: the Jaccard distance of their sets, and whether they are linked.

    texts (node, n, t) has a text for every node of a pair.
    """
    import pyarrow as pa

    def run(batches):
        for met in _met(batches, lambda t: shingle_set(t, k)):
            out = []
            for (p, _, pivot), (m, _, keys) in met:
                where = np.minimum(np.searchsorted(pivot, keys), len(pivot) - 1)
                shared = int((pivot[where] == keys).sum())
                out.append((p, m, 1.0 - shared / (len(keys) + len(pivot) - shared), linked(shared, len(keys), len(pivot), num, den)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.bool_()], strict=True)], ["p", "m", "far", "link"])

    return _meeting(pairs, texts.select("node", "n", F.col("t").alias("x")), folder).mapInArrow(task(run), "p long, m long, far double, link boolean")


#: Most bits, and bits per id, of the table below.
MAX_ID_BITS, BITS_PER_ID = 1 << 26, 16


def texts_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, n, t, bits) of the documents with these ids, and of a few others, without shuffling texts.

    A bit table of hashed ids, at most MAX_ID_BITS in 64-bit words, is broadcast. What passes beyond the ids is not asked for.
    """
    import pyarrow as pa

    n_bits = min(MAX_ID_BITS, max(1 << 12, 1 << (ids.count() * BITS_PER_ID).bit_length()))
    at = lambda df: df.withColumn("_at", F.pmod(F.xxhash64("id"), F.lit(n_bits))).withColumns({"_word": F.floor(F.col("_at") / 64).cast("int"), "_bit": (F.col("_at") % 64).cast("int")})
    words = at(ids).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    some = at(docs.select("id", "t")).join(F.broadcast(words), "_word").where("getbit(_bits, _bit) = 1").select("t")

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), k)
            nodes, sizes, bits = pa.array(map(node_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(parity_bits, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, sizes, batch.column(0), bits], ["node", "n", "t", "bits"])

    return some.mapInArrow(task(run), "node long, n long, t binary, bits binary")


def parity_bits(keys: np.ndarray) -> bytes:
    """A bit per hash class of the set's keys: whether an odd number of keys fall in it; at least 512 classes, and two a key.

    Two sets' bits differ in no more places than the sets do, also after both are folded to fewer classes.
    """
    classes = 1 << max(9, int(2 * len(keys) - 1).bit_length())
    odd = np.bincount((mix(keys) & _U(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Rows of 64-bit words of the bits folded to `size` bytes; rows that are shorter stay zero."""
    out = np.zeros((len(bits), size // 8), np.uint64)
    for i, b in enumerate(bits):
        if len(b) >= size:
            out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def tile_pairs(members: list[tuple], num: int, den: int, everything: bool) -> list[tuple[int, int]]:
    """Pairs of members in different components, at least one of them at home in this tile, that may be linked.

    Members are (home, node, n, comp, bits). Out are pairs whose sizes or parity bits differ by more than a link allows, and,
    unless everything is asked for, in a tile with many pairs all but the one of each member that looks nearest.
    """
    members = sorted(members, key=lambda m: (m[2], m[1]))
    home, node, n, comp = (np.array([m[i] for m in members], np.int64) for i in range(4))
    if (comp == comp[0]).all():
        return []
    bits = [m[4] for m in members]
    folds: dict[int, np.ndarray] = {}
    found, nearest = [], []
    for i in range(len(members) - 1):
        later = slice(i + 1, i + 1 + int(np.searchsorted(n[i + 1 :] * num, n[i] * den, "right")))
        at = np.flatnonzero((comp[later] != comp[i]) & ((home[later] + home[i]) > 0)) + i + 1
        if not len(at):
            continue
        size = len(bits[i])
        if size not in folds:
            folds[size] = _folded(bits, size)
        differ = np.bitwise_count(folds[size][at] ^ folds[size][i]).sum(1)
        near = differ * (num + den) <= (n[at] + n[i]) * (den - num)
        at, differ = at[near], differ[near]
        if len(at):
            found.append((i, at))
            nearest.append((int(node[i]), int(node[at[int(np.argmin(differ / (n[at] + n[i])))]])))
    if not everything and sum(len(at) for _, at in found) > PAIRS_PER_MEMBER * len(members):
        return nearest
    return [(int(node[i]), j) for i, at in found for j in node[at].tolist()]


def with_components(rows: DataFrame, comps: DataFrame, name: str, comp: str) -> DataFrame:
    """rows with the component of the node in column `name`: the node itself where it has no links."""
    known = comps.select(F.col("node").alias(name), F.col("comp").alias(comp))
    return sized_join(rows, known, [name], "left", salts=8).withColumn(comp, F.coalesce(comp, name))


def open_regions(regions: DataFrame, comps: DataFrame, folder: str) -> DataFrame:
    """(region, node, n, comp, g, main) of the regions with members of different components; g members each, main is their largest component."""
    now = staged(with_components(regions, comps, "node", "comp").select("region", "node", "n", "comp"), folder)
    each = now.groupBy("region", "comp").agg(F.count("*").alias("c"))
    open_ = each.groupBy("region").agg(F.sum("c").alias("g"), F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1")
    return sized_join(now, staged(open_.select("region", "g", "main"), folder), ["region"])


def split_regions(large: DataFrame, measured: DataFrame, texts: DataFrame, k: int, num: int, den: int, depth: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The regions of (region, node, n, comp, g) split by pivots, as (parent, region, node, n), and the distances measured for it.

    Pivots are one member each of a region's largest components. A member goes to its nearest pivot and to those within
    twice the join distance of that: two sets within the join distance then meet at the nearest pivot of either.
    """
    reach = 1.0 - num / den + 1e-9
    chosen = large.groupBy("region", "comp").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64(F.lit(depth), "node").alias("h"), "node")).alias("least"))
    first = Window.partitionBy("region").orderBy(F.desc("c"), "least")
    chosen = chosen.withColumn("r", F.row_number().over(first)).where(F.col("r") <= PIVOTS).select("region", F.col("least.node").alias("p"))
    chosen = chosen.groupBy("region").agg(F.collect_list("p").alias("ps"))  # at most PIVOTS
    asked = staged(sized_join(large, chosen, ["region"]).select("region", "node", "n", F.explode("ps").alias("p")), folder)
    pairs = asked.where("p <> node").select("p", F.col("node").alias("m")).distinct()
    pairs = pairs.join(measured.select("p", "m"), ["p", "m"], "left_anti")
    more = staged(measure(pairs, texts, k, num, den, folder), folder)
    far = measured.unionByName(more).select("p", F.col("m").alias("node"), "far")
    met = asked.join(far, ["p", "node"], "left").withColumn("far", F.when(F.col("p") == F.col("node"), F.lit(0.0)).otherwise(F.col("far")))
    met = met.groupBy("region", "node").agg(F.first("n").alias("n"), F.min("far").alias("near"), F.collect_list(F.struct("far", "p")).alias("ps"))
    parts = met.withColumn("x", F.explode(F.filter("ps", lambda x: x["far"] <= F.col("near") + 2 * reach)))
    return staged(parts.select(F.col("region").alias("parent"), F.xxhash64("region", "x.p").alias("region"), "node", "n"), folder), more


def between_components(rows: DataFrame, bits: DataFrame, everything: bool, num: int, den: int) -> DataFrame:
    """Pairs (p, m) of members of different components in one region of (region, node, n, comp, g, main) that may be linked.

    A region with more than TILE members is cut into blocks. The members of its largest component stay in theirs, all
    others visit every block, so that no region meets in one task and a component that is linked already is not multiplied.
    """
    import pyarrow as pa

    rows = rows.withColumn("blocks", F.ceil(F.col("g") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    visits = F.when(F.col("comp") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("block", F.explode(visits)).join(bits.select("node", "bits"), "node")
    rows = rows.select("region", "block", (F.col("block") == F.col("own")).cast("int").alias("home"), "node", "n", "comp", "bits")

    def run(batches):
        at, members = None, []

        def done():
            pairs = tile_pairs(members, num, den, everything)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["p", "m"])

        for batch in batches:
            for region, block, *member in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if at != (region, block):
                    if members:
                        yield done()
                    at, members = (region, block), []
                members.append(member)
        if members:
            yield done()

    return rows.repartition("region", "block").sortWithinPartitions("region", "block").mapInArrow(task(run), "p long, m long")


def split_large(regions: DataFrame, comps: DataFrame, measured: DataFrame, texts: DataFrame, k: int, num: int, den: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(region, node, n) with regions of more than SPLIT members in different components split again and again, the distances measured so far, and the components by them."""
    leaves = []
    for depth in range(DEPTH + 1):
        now = staged(open_regions(regions, comps, folder), folder)
        fits = (F.col("g") <= SPLIT) | F.lit(depth == DEPTH)
        leaves.append(now.where(fits))
        large = now.where(~fits)
        if not large.limit(1).count():
            break
        parts, more = split_regions(large, measured, texts, k, num, den, depth, folder)
        measured = measured.unionByName(more)
        sizes = parts.groupBy("parent", "region").count().groupBy("parent").agg(F.max("count").alias("most"))
        wholes = large.select(F.col("region").alias("parent"), "g").distinct()
        stuck = staged(sizes.join(wholes, "parent").where(F.col("most") > STALLED * F.col("g")).select("parent"), folder)
        leaves.append(large.join(stuck.withColumnRenamed("parent", "region"), "region", "left_semi"))
        regions = parts.join(stuck, "parent", "left_anti").select("region", "node", "n")
        if more.where("link").limit(1).count():
            comps = components(measured.where("link"), "p", "m", folder)
    every = leaves[0]
    for leaf in leaves[1:]:
        every = every.unionByName(leaf)
    return every.select("region", "node", "n"), measured, comps


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p", "m").alias("p"), F.greatest("p", "m").alias("m")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Sets of k-word shingles are linked when den * intersection >= num * union. Null or empty texts have no shingles and
    are linked with nothing. Equal sets are one node, so copies are never paired. Keys are 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("t"))
    folder = scratch_folder(docs.sparkSession)
    buckets = _buckets(docs)
    told = told_counts(staged(shingle_counts(docs, k, buckets), folder))
    both = staged(sets_and_cells(docs, told, k, num, den, buckets), folder)
    sets = staged(both.where("kind = 0").select("id", "n", "node"))
    nodes = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"))
    found = staged(cell_candidates(both.where("kind = 1"), num, den), folder)
    stars, others = found.where("kind = 0").select("p", "m").distinct(), found.where("kind = 2").select("p", "m").distinct()
    crowded = found.where("kind = 1").select("cell", "node", "n")
    ends = found.select(F.explode(F.array("p", "m", "node")).alias("node")).where("node IS NOT NULL").distinct()
    texts = staged(texts_of(docs, nodes.join(ends, "node", "left_semi").select(F.col("rep").alias("id")), k), folder)
    bits = staged(texts.select("node", "n", "bits").dropDuplicates(["node"]), folder)
    measured = staged(measure(plausible(stars, bits, num, den, folder), texts, k, num, den, folder), folder)
    comps = components(measured.where("link"), "p", "m", folder)

    apart = with_components(with_components(others, comps, "p", "a"), comps, "m", "b").where("a <> b").select("p", "m")
    pairs = plausible(apart, bits, num, den, folder)
    regions = None
    if crowded.limit(1).count():
        regions, measured, comps = split_large(crowded.select(F.col("cell").alias("region"), "node", "n"), comps, measured, texts, k, num, den, folder)
    for round_ in range(ROUNDS if regions is not None else 1):
        if regions is not None:
            tiles = between_components(open_regions(regions, comps, folder), bits, round_ == ROUNDS - 1, num, den)
            pairs = tiles if round_ else pairs.unionByName(tiles)
        pairs = staged(unordered(pairs).join(unordered(measured), ["p", "m"], "left_anti"), folder)
        if not pairs.limit(1).count():
            continue
        more = staged(measure(pairs, texts, k, num, den, folder), folder)
        measured = measured.unionByName(more)
        if more.where("link").limit(1).count():
            comps = components(measured.where("link"), "p", "m", folder)

    of_node = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("c")).join(comps, "node", "left")
    of_node = of_node.withColumn("comp", F.coalesce("comp", "node"))
    least = of_node.groupBy("comp").agg(F.min("id").alias("component_id"), F.sum("c").alias("docs")).where("docs > 1")
    shared = staged(sized_join(of_node, least, ["comp"], salts=8).select("node", "component_id"))
    removed(docs.sparkSession, folder)
    out = sized_join(sets, shared, ["node"], "left", salts=8)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of one document per component: the one with the smallest id.

    Rows that repeat both id and text stay once. Rows without an id stay as they are; they stand for no other row.
    """
    found = jaccard_components(docs.where(F.col(id_col).isNotNull()), k, num, den, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return named.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, r.least AS component_id FROM s JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""
