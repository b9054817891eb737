"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of its documents. The mix draws an exact number of blocks of each source: whole
passes over all its blocks, then a part of a last pass, whose last block ends at the document nearest the target. A binary
tree over the output shards splits the vector of these block quotas: a node with k of its parent's shards draws its share
of blocks without replacement, multivariate-hypergeometric over the sources. So the leaves' quotas add up exactly, and
each leaf draws its own disjoint range of every source's permuted blocks. A document is taken as often as leaves have
drawn its block; each shard shuffles what it has drawn by hash.

Sources, blocks, nodes and draws are tables. A node holds two numbers for each source that it draws from; nothing else is
gathered in one place but a few sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import Scratch, narrowed, read_table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents that a block has, more or less.
BLOCK_DOCS = 64
SHARD_WORDS = 4_000_000
#: Nodes of the tree that are split further in parallel.
NODES = 256
SEED = 20240229
#: Multipliers that permute blocks; the first that shares no factor with their number is taken.
PRIMES = (1_000_003, 998_244_353)
#: Cells in which a source's blocks are summed up before the blocks themselves, as a power of 2.
CELL_BITS = 6


def split(quotas: np.ndarray, low: int, high: int) -> np.ndarray:
    """What the left half of the shards from ``low`` to before ``high`` draws of each source. The same whenever and wherever it is asked for."""
    k, n = (high - low) // 2, high - low
    rng = np.random.Generator(np.random.PCG64([SEED, low, high]))
    return rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * k // n, method="marginals")


def splitting_tree(low: int, high: int, quotas: np.ndarray, starts: np.ndarray, sources: np.ndarray, nodes: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves below a node, ``(low, high, sources, quotas, starts)``, or nodes, about so many of them, that have something to draw.

    ``starts`` is where the node's range of each source's permuted blocks begins.
    """
    width = 1 if nodes is None else max(1, (high - low) // nodes)
    todo = [(low, high, sources, quotas, starts)]
    while todo:
        low, high, sources, quotas, starts = todo.pop()
        some = quotas > 0
        sources, quotas, starts = sources[some], quotas[some], starts[some]
        if not len(quotas):
            continue
        if high - low <= width:
            yield low, high, sources, quotas, starts
            continue
        left, mid = split(quotas, low, high), low + (high - low) // 2
        todo.append((mid, high, sources, quotas - left, starts + left))
        todo.append((low, mid, sources, left, starts))


_NODE = "low long, high long, sources array<bigint>, quotas array<bigint>, starts array<bigint>"


def _expanded(nodes: int | None):
    def run(batches):
        for b in batches:
            for low, high, *vectors in zip(*(c.to_pylist() for c in b.columns)):
                sources, quotas, starts = (np.array(v, np.int64) for v in vectors)
                for at, to, *found in splitting_tree(low, high, quotas, starts, sources, nodes):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([to], pa.int64()), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in found)], ["low", "high", "sources", "quotas", "starts"])

    return run


def _targets(per: DataFrame, total: float, most: float) -> Column:
    """Shares of ``total`` by ``weight``; a share stops at ``most`` times ``words``, the excess goes to the others by weight.

    Each round, one sum over the sources, raises what a unit of weight gets, until no further share is above its limit.
    """
    unit, capped = None, -1
    limit = F.col("words") * most
    while True:
        over = F.lit(False) if unit is None else F.col("weight") * unit > limit
        r = per.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, limit).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if r.n == capped or not r.free:
            return limit if not r.free else F.when(over, limit).otherwise(F.col("weight") * unit)
        unit, capped = (total - r.given) / r.free, r.n


def _hash(doc_id: str, text: str, source: str) -> Column:
    """63 bits that order a source's documents at random."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(source).cast("string"), F.col(doc_id), F.col(text)), 1)


def _permuted(rank: Column, of: Column, turn: Column) -> Column:
    prime = F.when(of % PRIMES[0] != 0, PRIMES[0]).otherwise(PRIMES[1]).cast("long")
    return (rank * prime + turn * 7919) % of


def plan(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """``sized(source, size, h)`` -> one row per source, and the draws of each block that is drawn: ``sid, block, draws``.

    The former has ``source, sid, source_size, target, bits, base`` and where the last pass ends: in ``cut_block``, before
    the hash ``cut_h``, of whose ``ties`` documents ``tie_take`` are still taken.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1)
    per = scratch.save(per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))), "sources")
    total = per.agg(F.sum("words")).first()[0] or 0
    per = per.withColumn("target", _targets(per, float(total), most).cast("double"))
    ratio = F.coalesce(F.try_divide("target", "words"), F.lit(0.0))
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.col("n") / BLOCK_DOCS, F.lit(1.0))))))
    per = per.withColumn("base", F.least(F.floor(ratio + 1e-12), F.lit(most)).cast("int")).withColumn("bits", bits.cast("int"))
    per = scratch.save(per.withColumn("want", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("words"))), "targets")
    blocked = _numbered(sized.select("source", "size", "h"), per.select("source", "sid", "bits"))
    sums = scratch.save(blocked.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("bits").alias("bits")), "blocks")
    # Words and blocks before each block: first over some cells of a source, then within each cell.
    cell = F.expr(f"shiftright(block, greatest(bits - {CELL_BITS}, 0))")
    sums = sums.withColumn("cell", cell)
    along, within = Window.partitionBy("sid").orderBy("cell"), Window.partitionBy("sid", "cell").orderBy("block")
    cells = sums.groupBy("sid", "cell").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    cells = cells.select("sid", "cell", (F.sum("w").over(along) - F.col("w")).alias("w0"), (F.sum("n").over(along) - F.col("n")).alias("n0"))
    ranked = sums.join(scratch.save(cells, "cells"), ["sid", "cell"])
    ranked = scratch.save(ranked.select("sid", "block", (F.col("w0") + F.sum("words").over(within) - F.col("words")).alias("before"), (F.col("n0") + F.row_number().over(within) - 1).alias("rank")), "ranked")
    ended = ranked.join(per.select("sid", "want"), "sid").groupBy("sid").agg(
        F.count("*").alias("blocks"), F.count(F.when(F.col("before") < F.col("want"), 1)).alias("part"), F.max(F.when(F.col("before") < F.col("want"), F.struct("rank", "block", (F.col("want") - F.col("before")).alias("rest")))).alias("last")
    )
    ended = scratch.save(ended.select("sid", "blocks", "part", F.col("last.block").alias("cut_block"), F.col("last.rest").alias("rest")), "ends")
    inside = blocked.join(ended.select("sid", F.col("cut_block").alias("block"), "rest"), ["sid", "block"]).groupBy("sid", "h").agg(F.sum("size").alias("words"), F.max("size").alias("each"), F.count("*").alias("ties"), F.first("rest").alias("rest"))
    start = inside.withColumn("start", F.sum("words").over(Window.partitionBy("sid").orderBy("h")) - F.col("words")).where("start < rest")
    at = start.groupBy("sid").agg(F.max(F.struct("h", "ties", "each", "start", "rest")).alias("x"))
    take = F.when(F.col("x.each") == 0, F.col("x.ties")).otherwise(F.least(F.col("x.ties"), F.floor((F.col("x.rest") - F.col("x.start")) / F.col("x.each") + 0.5)))
    at = at.select("sid", F.col("x.h").alias("cut_h"), F.col("x.ties").alias("ties"), take.cast("long").alias("tie_take"))
    found = per.join(ended.drop("rest"), "sid", "left").join(at, "sid", "left")
    per = scratch.save(found.select("source", "sid", F.col("words").alias("source_size"), "target", "bits", "base", "cut_block", "cut_h", "ties", "tie_take", "blocks", "part"), "plan")
    # The tree: from all shards to nodes, and from each node to its leaves.
    shards = max(1, -(-total // SHARD_WORDS))
    quota = F.col("base") * F.col("blocks") + F.col("part")
    every = F.array_sort(F.collect_list(F.struct("sid", quota.alias("q"))))
    root = per.where("blocks is not null").agg(every.alias("all")).select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.col("all.sid").alias("sources"), F.col("all.q").alias("quotas"), F.transform("all", lambda x: F.lit(0).cast("long")).alias("starts"))
    nodes = scratch.save(root.mapInArrow(_expanded(NODES), _NODE), "nodes").repartition("low")
    leaves = scratch.save(nodes.mapInArrow(_expanded(None), _NODE), "leaves")
    ranges = leaves.select("low", F.explode(F.arrays_zip("sources", "quotas", "starts")).alias("x")).where("x.quotas > 0")
    places = ranges.select(F.col("x.sources").alias("sid"), F.col("low").alias("shard"), F.explode(F.sequence(F.col("x.starts"), F.col("x.starts") + F.col("x.quotas") - 1)).alias("number"))
    numbers = ranked.join(per.select("sid", "base", "blocks", "part"), "sid").select("sid", "block", "rank", "base", "blocks", "part", F.explode(F.sequence(F.lit(0), F.col("base"))).alias("turn")).where("turn < base or rank < part")
    mine = F.col("turn") * F.col("blocks") + _permuted(F.col("rank"), F.when(F.col("turn") < F.col("base"), F.col("blocks")).otherwise(F.col("part")), F.col("turn"))
    drawn = numbers.select("sid", "block", "turn", mine.alias("number")).join(places, ["sid", "number"])
    draws = scratch.save(drawn.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("draws")), "draws")
    return per, draws


def _numbered(rows: DataFrame, per: DataFrame) -> DataFrame:
    """With the columns of ``per`` for each row's source, and the row's block."""
    per = per.withColumnRenamed("source", "own_source")
    return rows.join(per, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source").withColumn("block", F.expr("shiftright(h, 63 - bits)"))


def _taken(rows: DataFrame, per: DataFrame, draws: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(.., source, h)`` with ``source_size, target`` and ``draws``: for each time that a row is taken its shard and its place in the shard's order."""
    own = _numbered(rows, per)
    last = (F.col("block") == F.col("cut_block")) & (F.col("h") >= F.col("cut_h"))
    own = own.withColumn("part", ~F.coalesce(last, F.lit(False)))
    tied = F.coalesce((F.col("block") == F.col("cut_block")) & (F.col("h") == F.col("cut_h")), F.lit(False))
    if per.where("ties > tie_take and tie_take > 0").isEmpty():
        own = own.withColumn("part", F.col("part") | tied & (F.col("tie_take") >= F.col("ties")))
    else:
        # Rows that no hash tells apart, of which only some are taken, are numbered, in pieces of some 100,000.
        salted = scratch.save(own.where(tied).withColumn("salt", F.pmod(F.monotonically_increasing_id(), 1 + F.floor(F.col("ties") / 100_000))), "ties")
        ahead = Window.partitionBy("sid").orderBy("salt")
        counts = salted.groupBy("sid", "salt").agg(F.count("*").alias("n")).select("sid", "salt", (F.sum("n").over(ahead) - F.col("n")).alias("before"))
        number = F.col("before") + F.row_number().over(Window.partitionBy("sid", "salt").orderBy(F.lit(0)))
        some = salted.join(counts, ["sid", "salt"]).withColumn("part", number <= F.col("tie_take")).select(own.columns)
        own = own.where(~tied).unionByName(some)
    own = own.join(draws, ["sid", "block"], "left")
    mine = F.filter(F.coalesce("draws", F.array().cast("array<struct<turn:int,shard:bigint>>")), lambda d: (d["turn"] < F.col("base")) | F.col("part"))
    placed = F.transform(mine, lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(SEED), F.col("h"), d["turn"]).alias("place")))
    return own.withColumn("draws", placed)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies, draws``.

    ``copies`` is how many leaves have drawn the document, ``taken`` that times ``size``; ``draws`` holds for each copy
    its shard and its place in the shard's order. A null source is one source, the last; null and empty texts have size 0
    and are taken without weight. Of rows equal in id, source and text any may be taken more often than another, by one
    copy; so each source comes within half a document of its target, whatever repeats. An empty table gives no rows;
    further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = narrowed(docs, doc_id=id_col, text=text_col, source=source_col).withColumn("source", F.col("source").cast("string"))
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash("doc_id", "text", "source").alias("h")), "sized")
    per, draws = plan(sized, scratch)
    out = _taken(sized, per, draws, scratch).withColumn("copies", F.size("draws"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "draws")


def _laid(docs: DataFrame) -> DataFrame:
    """``row, shard, place``: rows as structs, so that no column of theirs meets one of ours."""
    scratch = Scratch(docs.sparkSession, "mix")
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["source"].cast("string").alias("source"), _hash("doc_id", "text", "source").alias("h"))
    sized = scratch.save(docs.select(docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), _hash("doc_id", "text", "source").alias("h")), "sized")
    per, draws = plan(sized, scratch)
    out = _taken(whole, per, draws, scratch).select("row", F.explode("draws").alias("draw")).select("row", "draw.shard", "draw.place")
    return out.repartition("shard").sortWithinPartitions("shard", "place")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns as they are, each repeated as often as it is taken, laid out as by ``shuffled``.

    ``docs`` has ``doc_id``, ``text`` and ``source`` and may have columns of any other name. Nulls, empty texts, repeated
    rows and empty tables are as in ``mixture``.
    """
    return _laid(docs).select("row.*")


def shuffled(docs: DataFrame) -> DataFrame:
    """The mix laid out: rows as by ``mixed`` with ``mix_shard`` and ``mix_place``, which take the place of columns so named; each shard is in one partition, in its shuffled order."""
    out = _laid(docs.drop("mix_shard", "mix_place"))
    return out.select("row.*", F.col("shard").alias("mix_shard"), F.col("place").alias("mix_place"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "draws")
