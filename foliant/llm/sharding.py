"""Sharding by a weighted hash tree: a row descends region, rack and shard, and at each level its hash draws one of the node's children."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_bytes

#: {region: {rack: {shard number: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]

#: Shards of the tree that others are added to, and how it is laid out.
BASE, REGIONS, RACKS = 8, 2, 2
#: Hexadecimal digits of a row's hash that name its range of slots; slots that one task gives to equal rows at once.
RANGE_DIGITS, CHUNK = 4, 1 << 16
_HEX, _SPAN = 13, float(1 << 52)
_CHILDREN = "array<array<struct<name:string,weight:double,node:int,shard:int>>>"


def shard_tree(shards: int) -> Tree:
    """The tree of so many shards of weight 1: the first BASE in regions and racks of equal sizes, each further one by grown_tree."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    tree: Tree = {}
    for s in range(min(shards, BASE)):
        racks = tree.setdefault(f"r{s * REGIONS // BASE}", {})
        racks.setdefault(f"k{s * REGIONS * RACKS // BASE % RACKS}", {})[s] = 1.0
    for _ in range(BASE, shards):
        tree = grown_tree(tree)
    return tree


def grown_tree(tree: Tree, weight: float = 1.0) -> Tree:
    """tree with one more shard, as a region and rack of its own, so that rows move into it and nowhere else.

    A shard that joins an existing rack raises the weights above it too; rows drawn into that region then go to any of its
    racks, which is right for the weights but moves rows between old shards.
    """
    number = 1 + max(s for racks in tree.values() for rack in racks.values() for s in rack)
    return tree | {f"r{len(tree)}": {"k0": {number: weight}}}


def tree_nodes(tree: Tree) -> list[list[dict]]:
    """The children of each node, the root first: (name, weight, node, shard). Children of weight 0 are left out.

    A child's name is its path, so its draws do not depend on what else the tree holds.
    """
    nodes: list[list[dict]] = [[]]

    def add(node: int, name: str, below) -> float:
        total = 0.0
        for key, sub in below.items():
            path = f"{name}/{key}" if name else str(key)
            inner = isinstance(sub, dict)
            if inner:
                nodes.append([])
                at = len(nodes) - 1
                weight = add(at, path, sub)
            else:
                at, weight = -1, float(sub)
            if not 0 <= weight < float("inf"):
                raise ValueError(f"weight of {path}")
            if weight > 0:
                nodes[node].append({"name": path, "weight": weight, "node": at, "shard": None if inner else int(key)})
            total += weight
        return total

    if add(0, "", tree) == 0:
        raise ValueError("all weights are 0")
    return nodes


def drawn_place(key: Column, tree: Tree) -> Column:
    """struct<names: array<string>, shard: int>: the nodes that a key descends through, and the shard it comes to.

    Of a node's children the one with the least -ln(u) / weight is drawn, u being uniform by a hash of the child's name
    and the key. Another weight of one child changes only its own draw, so rows move into or out of that subtree and none
    moves between its siblings. A null key is a key of its own.
    """
    nodes = tree_nodes(tree)
    children = F.from_json(F.lit(json.dumps(nodes)), _CHILDREN)
    text = F.coalesce(key.cast("string"), F.lit("~"))

    def draw(c: Column) -> Column:
        digits = F.substring(F.md5(F.concat(c["name"], F.lit("|"), text).cast("binary")), 1, _HEX)
        u = (F.conv(digits, 16, 10).cast("long") + 0.5) / _SPAN
        return F.struct((-F.log(u) / c["weight"]).alias("score"), c["name"], c["node"], c["shard"])

    def descend(state: Column, _: Column) -> Column:
        drawn = F.transform(F.array(F.array_min(F.transform(F.element_at(children, state["node"] + 1), draw))), lambda d: F.struct(d["node"].alias("node"), F.concat(state["names"], F.array(d["name"])).alias("names"), d["shard"].alias("shard")))
        return drawn[0]

    start = F.struct(F.lit(0).alias("node"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("int").alias("shard"))
    levels = F.array(*[F.lit(i) for i in range(3)])
    return F.aggregate(levels, start, descend, lambda s: F.struct(s["names"].alias("names"), s["shard"].alias("shard")))


def placed(docs: DataFrame, tree: Tree, id_col: str = "doc_id") -> DataFrame:
    """region, rack, shard and row, a struct of all columns of docs under their own names: a projection that shuffles nothing.

    Repeated ids go to one shard, rows without an id too. An empty table gives no rows.
    """
    at = docs.select(drawn_place(F.col(f"`{id_col}`"), tree).alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    part = lambda i: F.element_at(F.split(F.col("at.names")[i], "/"), -1)
    return at.select(part(0).alias("region"), part(1).alias("rack"), F.col("at.shard").alias("shard"), "row")


def write_shards(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id") -> None:
    """The documents as Parquet in folders region=/rack=/shard=, each task writing what it has read; a hot shard is many files."""
    placed(docs, tree, id_col).write.partitionBy("region", "rack", "shard").parquet(path)


def slotted(rows: DataFrame, shard_col: str = "shard") -> DataFrame:
    """rows with slot: 0, 1, ... within each shard, in the order of a hash of the other columns.

    Equal rows are counted before anything is ordered and get neighbouring slots, which are dealt out in chunks, so a row
    that is repeated without end is no task's burden. A shard's slots are given range by range of the hash: rows are
    ranked within a range, and ranges begin where those before end.
    """
    columns = [c for c in rows.columns if c != shard_col]
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns])
    mark = F.md5(text.cast("binary"))
    groups = rows.groupBy(*[f"`{c}`" for c in rows.columns]).agg(F.count("*").alias("_n")).withColumn("_mark", mark).withColumn("_range", F.substring("_mark", 1, RANGE_DIGITS))
    inside = Window.partitionBy(shard_col, "_range").orderBy("_mark", *columns).rowsBetween(Window.unboundedPreceding, 0)
    ranked = groups.withColumn("_upto", F.sum("_n").over(inside))
    totals = groups.groupBy(shard_col, "_range").agg(F.sum("_n").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(shard_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_all")
    ranked = ranked.join(totals.select(shard_col, "_range", before.alias("_before")), [shard_col, "_range"])
    first = F.col("_before") + F.col("_upto") - F.col("_n")
    chunks = ranked.select(*rows.columns, "_n", first.alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))).alias("_chunk"))
    begin = F.col("_first") + F.col("_chunk") * CHUNK
    chunks = chunks.select(*rows.columns, begin.alias("_begin"), F.least(F.lit(CHUNK).cast("long"), F.col("_n") - F.col("_chunk") * CHUNK).alias("_m"))
    spread = chunks.repartition(F.col(shard_col), F.col("_begin"))
    return spread.select(*rows.columns, F.explode(F.sequence(F.col("_begin"), F.col("_begin") + F.col("_m") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes + 1), text_crc32, law, region, rack, shard, slot and grown_shard.

    The law is `key`: a document's id and the tree decide. grown_shard is its shard in the tree `grown`. Null texts count
    as empty; rows without an id share a shard; repeated rows each get a slot; texts of any length are only measured;
    other columns are not looked at, whatever their names; an empty table gives no rows.
    """
    key = F.col(f"`{id_col}`")
    body = text_bytes(F.col(f"`{text_col}`"))
    small = docs.select(key.alias("doc_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), drawn_place(key, tree).alias("at"), drawn_place(key, grown or tree)["shard"].alias("grown_shard"))
    rows = staged(small.select("doc_id", "size", "text_crc32", F.col("at.names")[1].alias("path"), F.col("at.shard").alias("shard"), "grown_shard"))
    part = F.split("path", "/")
    return slotted(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", F.col("grown_shard") if grown else F.lit(None).cast("int").alias("grown_shard"), part[0].alias("region"), part[1].alias("rack"))


def op11_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shard_tree(BASE), shard_tree(BASE + 1))


def _drawn_sql(shards: int, level: int, parent: str) -> str:
    """SQL of the child's name that the row draws below the node `parent`, an expression, at one level of shard_tree(shards)."""
    return f"(SELECT arg_min(c.name, -ln((('0x' || substr(md5(c.name || '|' || d.key), 1, {_HEX}))::BIGINT + 0.5) / {int(_SPAN)}.0) / c.weight) FROM children c WHERE c.tree = {shards} AND c.level = {level} AND c.parent = {parent})"


def _tree_sql(shards: int) -> str:
    out = [(shards, 0, "", r, sum(sum(k.values()) for k in racks.values())) for r, racks in shard_tree(shards).items()]
    for r, racks in shard_tree(shards).items():
        out += [(shards, 1, r, f"{r}/{k}", sum(s.values())) for k, s in racks.items()]
        out += [(shards, 2, f"{r}/{k}", f"{r}/{k}/{s}", w) for k, ws in racks.items() for s, w in ws.items()]
    return ", ".join(str(x) for x in out)


#: The CRC-32 is folded over the bytes with a table of 256 entries that the SQL makes from the polynomial.
OP11_SQL = f"""
WITH children(tree, level, parent, name, weight) AS (VALUES {_tree_sql(BASE)}, {_tree_sql(BASE + 1)}),
crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '~') AS key, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crcs),
regions AS (SELECT *, {_drawn_sql(BASE, 0, "''")} AS a, {_drawn_sql(BASE + 1, 0, "''")} AS b FROM d),
racks AS (SELECT * REPLACE ({_drawn_sql(BASE, 1, "d.a")} AS a, {_drawn_sql(BASE + 1, 1, "d.b")} AS b) FROM regions d),
shards AS (SELECT * REPLACE ({_drawn_sql(BASE, 2, "d.a")} AS a, {_drawn_sql(BASE + 1, 2, "d.b")} AS b) FROM racks d),
named AS (SELECT doc_id, size, text_crc32, split_part(a, '/', 1) AS region, split_part(a, '/', 2) AS rack, split_part(a, '/', 3)::INT AS shard, split_part(b, '/', 3)::INT AS grown_shard FROM shards)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', coalesce(doc_id::VARCHAR, '~'), size, text_crc32, region || '/' || rack, grown_shard))) - 1 AS slot,
    grown_shard, region, rack
FROM named
"""
