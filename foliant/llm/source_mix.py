"""Mixing sources to target weights with DataFrame functions alone: exact block quotas, split among shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, sized_join, staged, table

WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
REPEATS = 3
#: Words of a block that are aimed at, and the least number of blocks a source is dealt into.
BLOCK_WORDS, LEAST_BLOCKS = 1 << 20, 128
#: Output shards, a power of two: so many at least, and one for so many words of the sources.
SHARDS, SHARD_WORDS = 16, 1 << 27
SEED = 20_240_613
_SPAN = 1 << 40


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources by code point, null last, take the weights in turn. They share the total by weight; a source stops at
    `repeats` times its size and the excess is shared by weight among the others. That is a common level L with
    target = min(repeats * size, L * weight), found from the sources ordered by where they stop.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    rows = sources.withColumn("weight", w).withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    stopped = F.coalesce(F.sum("most").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - stopped) / open_weight).withColumn("at", F.row_number().over(by_stop))
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight") * (1 + 1e-12), F.struct("at", "level"))).over(every)["level"]
    return rows.withColumn("target", F.least("most", first * F.col("weight"))).drop("level", "at", "most")


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items out of `population` are among its `marked` ones, by inverting the distribution at u in [0, 1).

    The probabilities are built from their ratios over 12 standard deviations on either side of the mode; what lies
    outside is less than a double's last place.
    """
    n, k, m = (c.cast("double") for c in (population, marked, drawn))
    low, high = F.greatest(F.lit(0.0), m + k - n), F.least(k, m)
    mode = F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")
    spread = F.sqrt(F.greatest(m * k * (n - k) * (n - m), F.lit(0.0)) / F.greatest(n * n * (n - 1), F.lit(1.0))) * 12 + 12
    first = F.greatest(low, F.floor(mode - spread)).cast("long")
    last = F.least(high, F.ceil(mode + spread)).cast("long")

    def draw(r: Column) -> Column:
        after = lambda x: (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))  # noqa: E731  p(x + 1) / p(x)
        steps = F.sequence(r["first"], r["last"])
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        total = F.aggregate(steps, start, lambda a, x: F.struct((a["p"] * after(x.cast("double"))).alias("p"), (a["sum"] + a["p"]).alias("sum")), lambda a: a["sum"])

        def invert(t: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), r["first"].alias("x"))
            step = lambda a, x: F.struct(
                (a["p"] * after(x.cast("double"))).alias("p"), (a["sum"] + a["p"]).alias("sum"), F.when((a["sum"] + a["p"]) <= t * u, F.least(x + 1, r["last"])).otherwise(a["x"]).alias("x")
            )
            return F.aggregate(steps, begin, step, lambda a: a["x"])

        return _let(total, invert)

    return _let(F.struct(first.alias("first"), last.alias("last")), draw)


def _deal(level: int, seed: int):
    """The fold of split_quotas: state (n blocks left, m of them to go left, what went), next source x."""

    def step(a: Column, x: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["src"]), F.lit(_SPAN)) / float(_SPAN)
        take = F.when((x["q"] == 0) | (a["m"] == 0), F.lit(0).cast("long")).otherwise(hypergeometric(a["n"], x["q"], a["m"], u))

        def moved(k: Column) -> Column:
            went = F.concat(a["out"], F.array(F.struct(x["src"].alias("src"), k.alias("q"))))
            return F.struct((a["n"] - x["q"]).alias("n"), (a["m"] - k).alias("m"), went.alias("out"))

        return _let(take, moved)

    return step


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(src, shard, q) from (src, q): each node of a binary tree hands a random half of its blocks to its left child.

    How many of each source go left is drawn source by source, each given those before it, which is the multivariate
    hypergeometric distribution. Quotas are kept exactly: over the shards a source's q sum to its own. The tree is
    one row a node with one entry a source, and its levels are projections, not shuffles.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("src", "q"))).alias("qs")).withColumn("node", F.lit(0))
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards must be a power of two")
    for level in range(levels):
        whole = F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        empty = F.array().cast("array<struct<src:string,q:bigint>>")

        half = F.floor(whole / 2).cast("long")
        left = F.aggregate("qs", F.struct(whole.alias("n"), half.alias("m"), empty.alias("out")), _deal(level, seed), lambda a: a["out"])
        node = node.withColumn("left", left)
        right = F.zip_with("qs", "left", lambda x, y: F.struct(x["src"].alias("src"), (x["q"] - y["q"]).alias("q")))
        node = node.select(F.posexplode(F.array(F.col("left"), right)).alias("side", "qs"), "node").select("qs", (F.col("node") * 2 + F.col("side")).alias("node"))
    return node.select(F.col("node").alias("shard"), F.explode("qs").alias("x")).select("x.src", "shard", "x.q")


@dataclass
class Mix:
    """What with_draws needs to know of each block, and of the documents in the blocks that are taken in part."""

    blocks: DataFrame
    parts: DataFrame
    n_blocks: int
    seed: int


def block_of(doc_id: Column, n_blocks: int, seed: int) -> Column:
    """Documents are dealt into their source's blocks by a hash, so that blocks are exchangeable."""
    return F.floor(F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(_SPAN)) * n_blocks / _SPAN).cast("int")


def plan_mix(sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mix:
    """From rows (doc_id, source, size): which blocks each epoch draws, which shard each draw goes to, and what is taken of the last block.

    A source is taken floor(target / size) times whole; of the remaining words whole blocks are drawn in an order of
    their hashes, and the block that crosses the target gives documents, in an order of theirs, until it is met.
    """
    sized = sized.withColumn("src", source_key(F.col("source")))
    sources = staged(targets(sized.groupBy("src", "source").agg(F.sum("size").alias("source_size")), weights, repeats))
    largest, total = (x or 0 for x in sources.agg(F.max("source_size"), F.sum("source_size")).first())
    n_blocks = max(LEAST_BLOCKS, -(-largest // block_words))
    shards = shards or max(SHARDS, 1 << (total // SHARD_WORDS).bit_length())
    cap = F.when(F.col("source_size") > 0, F.least(F.lit(repeats), F.floor(F.col("target") / F.col("source_size"))).cast("int")).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", cap).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    blocks = sized.groupBy("src", block_of(F.col("doc_id"), n_blocks, seed).alias("block")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block"), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    blocks = blocks.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    blocks = blocks.withColumn("n", F.count("*").over(Window.partitionBy("src")))
    blocks = staged(blocks.join(sources, "src"))
    more = (F.col("before") < F.col("rest")) & (F.col("words") > 0)
    blocks = blocks.withColumn("drawn", F.when(~more, F.lit(0)).when(F.col("before") + F.col("words") <= F.col("rest"), F.lit(2)).otherwise(F.lit(1)))

    quota = F.max(F.col("epochs") * F.col("n")) + F.coalesce(F.max(F.when(F.col("drawn") > 0, F.col("rank") + 1)), F.lit(0))
    leaves = split_quotas(blocks.groupBy("src").agg(quota.cast("long").alias("q")), shards, seed)
    upto = F.sum("q").over(Window.partitionBy("src").orderBy("shard"))
    bounds = leaves.withColumn("upto", upto).groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("bounds"))
    blocks = staged(blocks.join(bounds, "src").select("src", "block", "rank", "n", "epochs", "drawn", (F.col("rest") - F.col("before")).alias("room"), "source_size", "target", "bounds"))

    crossing = blocks.where("drawn = 1").select("src", "block", "room")
    inside = sized.withColumn("block", block_of(F.col("doc_id"), n_blocks, seed))
    inside = sized_join(inside, crossing, ["src", "block"]).groupBy("src", "room", "doc_id").agg(F.sum("size").alias("all"))
    line = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id")
    inside = inside.withColumn("left", F.col("room") - F.sum("all").over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col("all"))
    parts = inside.where("left > 0 AND all > 0").select("src", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.least(F.lit(1.0), F.col("left") / F.col("all")).alias("share"))
    return Mix(blocks, staged(parts), n_blocks, seed)


def with_draws(rows: DataFrame, mix: Mix, size: Column, whole_documents: bool = False) -> DataFrame:
    """rows (with doc_id and source) plus _size, _source_size, _target and _draws, an array of (epoch, shard, words).

    With whole_documents the one document a source that is cut at its target is taken whole if half of it is, else not.
    """
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), "doc_id", "source", size.alias("_size"))  # names of rows' own columns meet none of the plan's
    keyed = whole.withColumn("src", source_key(F.col("source"))).withColumn("block", block_of(F.col("doc_id"), mix.n_blocks, mix.seed))
    found = sized_join(keyed, mix.blocks, ["src", "block"])
    shard = lambda i: F.size(F.filter("bounds", lambda b: b <= i))
    shift = lambda e: F.pmod(F.col("rank") + F.xxhash64(F.lit(mix.seed), "src", e), F.col("n"))
    full = F.when(
        F.col("epochs") > 0,
        F.transform(F.sequence(F.lit(0), F.col("epochs") - 1), lambda e: F.struct(e.cast("int").alias("epoch"), shard(e * F.col("n") + shift(e)).alias("shard"), F.col("_size").alias("words"))),
    ).otherwise(F.array().cast("array<struct<epoch:int,shard:int,words:bigint>>"))
    last = lambda words: F.array(F.struct(F.col("epochs").cast("int").alias("epoch"), shard(F.col("epochs") * F.col("n") + F.col("rank")).alias("shard"), words.alias("words")))

    plain = found.where("drawn <> 1").withColumn("_draws", F.when(F.col("drawn") == 2, F.concat(full, last(F.col("_size")))).otherwise(full))
    cut = found.where("drawn = 1").withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull())
    cut = sized_join(cut, mix.parts, ["src", "_id", "_none"], "left")
    words = F.round(F.col("_size") * F.coalesce("share", F.lit(0.0))).cast("long")
    if whole_documents:
        words = F.when(F.coalesce("share", F.lit(0.0)) >= 0.5, F.col("_size")).otherwise(F.lit(0).cast("long"))
    cut = cut.withColumn("_words", words).withColumn("_draws", F.when(F.col("_words") > 0, F.concat(full, last(F.col("_words")))).otherwise(full))
    out = [*[F.col("_row").getField(c).alias(c) for c in rows.columns], "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_draws"]
    return plain.select(*out).unionByName(cut.select(*out))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, draws and taken (the words of its draws).

    Null texts have size 0 and null sources are a source of their own, the last. Documents without words take none.
    Repeated rows are dealt together and share what their id takes. The same table gives the same draws again.
    """
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    found = with_draws(sized, plan_mix(sized, **options), F.col("size"))
    taken = F.aggregate("_draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_draws").alias("draws"), taken.alias("taken"))


def mixed_documents(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mix itself: docs' rows, all columns, repeated as drawn, by shard and in a hash order within it; whole documents only.

    Rows without words are never drawn. Repeated rows are drawn alike. An empty table gives no rows. Other columns may have
    any names but those that begin with an underscore and are used here: _row, _size, _source_size, _target, _draws, _draw, _at.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    found = with_draws(docs, plan_mix(sized, shards=shards, **options), word_count(F.col("text")), whole_documents=True)
    rows = found.withColumn("_draw", F.explode("_draws")).withColumn("_at", F.xxhash64(F.lit(SEED), "doc_id", "_draw.epoch"))
    # a shard's rows are dealt over many partitions by the same hash, so that none grows with the data
    spread = rows.repartition(F.col("_draw.shard"), F.pmod("_at", F.lit(4096))).sortWithinPartitions("_draw.shard", "_at", "doc_id")
    return spread.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))
