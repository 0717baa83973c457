"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat neighbour arrays; shard results are merged."""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Rows a shard aims at: so many times the square root of all rows, within bounds, since each query visits each shard.
SHARD_GROWTH, LEAST_SHARD, MOST_SHARD = 32, 4096, 131_072
#: Links per node (twice as many on the ground level), and beam widths for building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 128
#: Queries handled together, blocks of them that one task takes to a shard at least, and tasks a shard. More tasks than these only where
#: there are so many shards that the copies of the index are outweighed by those of the queries.
BLOCK_QUERIES, BLOCKS_PER_TASK, SHARD_TASKS, SHARDS_A_TASK = 128, 4, 4, 32
NEIGHBOURS, QUERY_EVERY = 20, 20


class Graph:
    """The graph of one shard's distinct vectors. Nearness is the inner product of vectors that were brought to one length."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry
        self.seen, self.turn = np.zeros(len(vectors), np.int32), 0

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The `width` nearest (inner product, node) found on a level, in no order."""
        links, vectors, seen = self.links[level], self.vectors, self.seen
        self.turn += 1
        turn = self.turn
        todo, best = [], []
        for s, v in start:
            seen[v] = turn
            heappush(todo, (-s, v))
            heappush(best, (s, v))
        while len(best) > width:
            heappop(best)
        while todo:
            s, v = heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            near = links[v]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            scores = vectors[near] @ q
            if len(best) >= width:
                good = scores > best[0][0]
                near, scores = near[good], scores[good]
            for x, w in zip(scores.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heappush(best, (x, w))
                elif x > best[0][0]:
                    heapreplace(best, (x, w))
                else:
                    continue
                heappush(todo, (-x, w))
        return best

    def descend(self, q: np.ndarray, to_level: int) -> list[tuple[float, int]]:
        at = [(float(self.vectors[self.entry] @ q), self.entry)]
        for level in range(int(self.levels[self.entry]), to_level, -1):
            at = [max(self.beam(q, at, 1, level))]
        return at

    def search(self, q: np.ndarray, width: int) -> list[int]:
        return [v for _, v in self.beam(q, self.descend(q, 0), width, 0)]


def _diverse(vectors: np.ndarray, around: int, nodes: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the nodes, nearest first, each nearer to `around` than to those already kept; then the nearest others."""
    if len(nodes) <= most:
        return nodes
    own = vectors[nodes] @ vectors[around]
    order = np.argsort(-own, kind="stable")
    nodes, own = nodes[order], own[order]
    among = vectors[nodes] @ vectors[nodes].T
    kept, closest = [], np.full(len(nodes), -np.inf)
    for i in range(len(nodes)):
        if own[i] > closest[i]:
            kept.append(i)
            if len(kept) == most:
                break
            closest = np.maximum(closest, among[i])
    if len(kept) < most:
        left = np.setdiff1d(np.arange(len(nodes)), kept, assume_unique=True)
        kept += left[: most - len(kept)].tolist()
    return nodes[kept]


def build_graph(vectors: np.ndarray, seed: int, links: int = LINKS, width: int = BUILD_BEAM) -> Graph:
    """Insert the vectors, which must be of one length, in the given order; levels are drawn from the seed."""
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    levels = np.minimum((-np.log(1 - draws) / np.log(links)).astype(np.int64), 12)
    tables = [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(levels.max()) + 1)]
    graph = Graph(vectors, levels, tables, 0)
    for v in range(1, n):
        q, top = vectors[v], int(levels[graph.entry])
        at = graph.descend(q, min(int(levels[v]), top))
        for level in range(min(int(levels[v]), top), -1, -1):
            at = graph.beam(q, at, width, level)
            rows = tables[level]
            chosen = _diverse(vectors, v, np.array([w for _, w in at], np.int32), links)
            rows[v, : len(chosen)] = chosen
            for w in chosen.tolist():
                row = rows[w]
                if row[-1] < 0:
                    row[int(np.argmax(row < 0))] = v
                else:
                    row[:] = _diverse(vectors, w, np.append(row, np.int32(v)), len(row))
        if levels[v] > top:
            graph.entry = v
    return graph


def _doubles(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their dimension.

    Null ids, null and zero vectors and those holding null, NaN or infinite components take no part. Vectors of more than one
    dimension have no inner product and are an error.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    return rows, most or 0


def nearest(rows: DataFrame, neighbours: int = NEIGHBOURS, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, width: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, id, score: for each row whose id is divisible by query_every, its nearest other rows by inner product.

    Every row is in the index of its shard, equal vectors as one node that lists their ids; the largest inner products
    are found as nearest neighbours after one more component has brought all vectors to the greatest length. Scores
    are double-precision inner products of the given vectors; ties go to the smaller id. Rows that repeat an id are all
    candidates, except that a query is never its own id's neighbour. No valid rows give no rows.
    """
    import pandas as pd
    import pyarrow as pa

    valid, size = valid_vectors(rows, id_col, vector_col)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, longest = valid.agg(F.count("*"), F.max(norm2)).first()
    shard_rows = shard_rows or int(min(MOST_SHARD, max(LEAST_SHARD, SHARD_GROWTH * count**0.5)))
    shards = max(1, -(-count // shard_rows))
    reach = float(longest or 0.0)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values("id", kind="stable")
        ids, x = group["id"].to_numpy(np.int64), _doubles(group["v"])
        distinct, which = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        ends = np.cumsum(np.bincount(which.ravel(), minlength=len(distinct)))
        last = np.sqrt(np.maximum(reach - (distinct * distinct).sum(1), 0.0))
        mixed = np.random.default_rng(shard).permutation(len(distinct))  # sorted vectors would make a poor insertion order
        graph = build_graph(np.ascontiguousarray(np.column_stack([distinct, last])[mixed], np.float32), shard)
        place = np.empty(len(distinct), np.int64)
        place[mixed] = np.arange(len(distinct))
        starts = np.concatenate([[0], ends[:-1]])
        return pd.DataFrame(
            {
                "shard": [shard], "entry": [graph.entry], "vectors": [distinct[mixed].tobytes()], "lengths": [last[mixed].astype(np.float32).tobytes()], "levels": [graph.levels.tobytes()],
                "links": [[t.tobytes() for t in graph.links]], "ids": [ids[order].tobytes()], "starts": [starts[mixed].tobytes()], "ends": [ends[mixed].tobytes()],
            }
        )

    fields = "shard int, entry int, vectors binary, lengths binary, levels binary, links array<binary>, ids binary, starts binary, ends binary"
    sharded = valid.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = staged(sharded.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(build, fields))  # a task a shard

    asked = valid.where(F.col("id") % query_every == 0).distinct()
    blocks = max(1, -(-count // (query_every * BLOCK_QUERIES)))
    tasks = min(-(-blocks // BLOCKS_PER_TASK), max(SHARD_TASKS, shards // SHARDS_A_TASK))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "ids": [group["id"].to_numpy(np.int64).tobytes()], "vectors": [_doubles(group["v"]).tobytes()]})

    packed = staged(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, vectors binary"))
    none = F.lit(None).cast("binary")
    index_side = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(-1).alias("block"), "entry", "vectors", "lengths", "levels", "links", "ids", "starts", "ends")
    query_side = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("block") % tasks).cast("int").alias("task"), "block", F.lit(None).cast("int").alias("entry"),
        "vectors", none.alias("lengths"), none.alias("levels"), F.lit(None).cast("array<binary>").alias("links"), "ids", none.alias("starts"), none.alias("ends"),
    )

    def search(batches):
        graph = at = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] < 0:
                    at = (r["shard"], r["task"])
                    exact = np.frombuffer(r["vectors"], np.float64).reshape(-1, size)
                    full = np.column_stack([exact, np.frombuffer(r["lengths"], np.float32)]).astype(np.float32)
                    graph = Graph(full, np.frombuffer(r["levels"], np.int64), [np.frombuffer(t, np.int32).reshape(len(full), -1) for t in r["links"]], r["entry"])
                    ids, starts, ends = (np.frombuffer(r[c], np.int64) for c in ("ids", "starts", "ends"))
                    continue
                if at != (r["shard"], r["task"]):
                    continue  # a shard without rows
                out = []
                for query, q in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["vectors"], np.float64).reshape(-1, size), strict=True):
                    nodes = np.array(graph.search(np.append(q, 0.0).astype(np.float32), max(width, neighbours)), np.int64)
                    scores = np.array([float(np.dot(exact[v], q)) for v in nodes])
                    found = []
                    for v in np.argsort(-scores, kind="stable").tolist():
                        if len(found) >= neighbours and scores[v] < found[neighbours - 1][0]:
                            break
                        own = ids[starts[nodes[v]] : ends[nodes[v]]]
                        found += [(scores[v], i) for i in own[own != query][:neighbours].tolist()]
                    found.sort(key=lambda f: (-f[0], f[1]))
                    out += [(query, i, s) for s, i in found[:neighbours]]
                columns = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64()], strict=True)], ["query_id", "id", "score"])

    both = index_side.unionByName(query_side).repartition(max(8, shards * tasks), "shard", "task").sortWithinPartitions("shard", "task", "block")
    found = both.mapInArrow(search, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
