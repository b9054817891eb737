"""Embedding near-deduplication by products of int8 tiles with rigorous error bounds.

Every vector is scaled to length 1 and quantised to int8 with its own step; the length of what quantising cut off is
measured per vector. For two vectors, the exact cosine differs from the quantised product by at most what these two
lengths allow (Cauchy-Schwarz), so a tile product tells most pairs surely above or surely below the threshold. Only the
pairs between are computed again in double precision. Blocks are compared pairwise, in the upper triangle; each pair of
blocks gives the number of links per vector and a spanning forest of its links, never the links themselves. Only the vectors
are moved: a task quantises the two blocks that it compares.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, narrowed, read_table
from ._graph import components, forest

THRESHOLD = 0.95
#: Bytes and vectors of a block at most: a task compares two blocks, tile by tile. A vector goes to as many tasks as there are blocks.
BLOCK_BYTES, BLOCK = 16 << 20, 16384
#: Tiles of a product.
STRIPE, TILE = 256, 2048


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their steps, and an upper bound of each row's error in length."""
    step = np.abs(unit).max(axis=1, initial=0) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * step[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-14
    return q, step, error


def _linked(left: dict, right: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked vectors of two blocks; of pairs within a block those with the smaller position first."""
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x in range(0, len(left["step"]), TILE):
        for y in range(x if same else 0, len(right["step"]), TILE):
            i, j = _tiles(_part(left, x), _part(right, y), same and x == y, threshold)
            rows.append(i + x)
            cols.append(j + y)
    return np.concatenate(rows), np.concatenate(cols)


def _part(block: dict, at: int) -> dict:
    part = slice(at, at + TILE)
    return {k: block[k][part] for k in ("q", "step", "error")} | {"unit": lambda i: block["unit"](i + at)}


def _tiles(left: dict, right: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked vectors of two tiles; of pairs within a tile those with the smaller position first."""
    rows, cols = [], []
    slack = 1e-9
    qr, sr, er = right["q"].astype(np.float32).T, right["step"], right["error"]
    longest = er.max(initial=0)
    for at in range(0, len(left["step"]), STRIPE):
        part = slice(at, at + STRIPE)
        # int8 products of up to 1040 dimensions are whole numbers that float32 holds exactly.
        dot = left["q"][part].astype(np.float32) @ qr if left["q"].shape[1] <= 1040 else left["q"][part].astype(np.float64) @ qr.astype(np.float64)
        # |u.v - u'.v'| <= eu |v'| + ev |u'| + eu ev, and |u'| <= 1 + eu. A coarse floor first, in quantised units.
        floor = (threshold - (left["error"][part] + longest) - 3 * left["error"][part] * longest - slack) / left["step"][part]
        i, j = np.nonzero(dot >= (floor[:, None] / sr[None, :]).astype(np.float32) * np.float32(1 - 1e-6) - np.float32(1))
        if same:
            ok = i + at < j
            i, j = i[ok], j[ok]
        i += at
        value = dot[i - at, j].astype(np.float64) * left["step"][i] * sr[j]
        eu, ev = left["error"][i], er[j]
        bound = eu * (1 + ev) + ev * (1 + eu) + eu * ev + slack
        maybe = value + bound >= threshold
        i, j, sure = i[maybe], j[maybe], (value - bound >= threshold)[maybe]
        for k in range(0, len(i), 65536):
            unsure = np.flatnonzero(~sure[k : k + 65536]) + k
            sure[unsure] = (left["unit"](i[unsure]) * right["unit"](j[unsure])).sum(axis=1) >= threshold
        rows.append(i[sure])
        cols.append(j[sure])
    return np.concatenate(rows), np.concatenate(cols)


def _tile(table: pa.Table, width: int) -> dict:
    n = table.num_rows
    values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, width)

    def unit(at: np.ndarray) -> np.ndarray:
        x = values[at].astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    parts = [quantised(unit(np.arange(at, min(at + TILE, n)))) for at in range(0, n, TILE)] or [quantised(np.empty((0, width)))]
    q, step, error = (np.concatenate(x) for x in zip(*parts))
    return {"q": q, "step": step, "error": error, "unit": unit} | {k: table.column(k).to_numpy() for k in ("vec_id", "copies")}


def _compared(threshold: float):
    def run(key, table):
        width, x, y = key[0].as_py(), key[1].as_py(), key[2].as_py()
        block = table.column("block").to_numpy()
        left = _tile(table.filter(pa.array(block == x)), width)
        right = left if x == y else _tile(table.filter(pa.array(block == y)), width)
        if not len(left["step"]) or not len(right["step"]):
            i = j = np.empty(0, np.int64)
        else:
            i, j = _linked(left, right, x == y, threshold)
        at = 0 if x == y else len(left["vec_id"])
        ids = left["vec_id"] if x == y else np.concatenate([left["vec_id"], right["vec_id"]])
        count = np.bincount(i, right["copies"][j], len(ids)) + np.bincount(j + at, left["copies"][i], len(ids))
        node, root = forest(len(ids), i, j + at)
        return pa.table({"vec_id": ids[node], "root": ids[root], "links": count[node].astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal length are linked when their cosine in double precision is at least ``threshold``; ``n_links``
    counts other rows linked, ``component_id`` is the smallest id reachable. Null vectors, zero vectors, empty ones and
    those with a null or non-finite component link with nothing. Equal vectors are one class and compared once. Rows
    that share an id share its component; a row with a null id has a null component and is kept. An empty table gives no
    rows; further columns are ignored. The work grows with the square of the number of distinct vectors, as all pairs
    are asked for; a task holds two blocks of bounded size.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = narrowed(vectors, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    # -0.0 and 0.0 are one value; keys of two hashes and the vector itself.
    rows = rows.withColumn("ok", usable)
    keyed = rows.where("ok").withColumn("embedding", F.expr("transform(embedding, x -> if(x = 0, cast(0 as %s), x))" % element))
    classes = keyed.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    tiled = scratch.save(classes.select(F.col("rep").alias("vec_id"), "copies", "embedding", F.size("embedding").alias("width")), "classes")
    size = tiled.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    blocks = max(math.ceil(size.n / BLOCK), math.ceil(size.n * 8 * (size.width or 0) / BLOCK_BYTES), 1)
    # Some more blocks where there are few, so that all cores have pairs to compare.
    blocks = max(blocks, min(math.ceil(size.n / TILE), math.isqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 16), 1)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = tiled.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"x": F.least("block", "o"), "y": F.greatest("block", "o")}).drop("o")
    dealt = dealt.select("width", "x", "y", "block", "vec_id", "copies", "embedding").repartition(blocks * (blocks + 1) // 2, "width", "x", "y")
    found = scratch.save(dealt.groupBy("width", "x", "y").applyInArrow(_compared(threshold), "vec_id long, root long, links long"), "found")
    of = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    by_class = tiled.select("vec_id", "copies", "embedding").join(links, "vec_id", "left").join(of, F.col("vec_id") == F.col("node"), "left")
    by_class = by_class.select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    by_class = scratch.save(by_class, "by_class")
    linked = keyed.join(by_class, keyed.embedding == by_class.e).select(keyed.vec_id, "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
