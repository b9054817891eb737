"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A bucket is the set of rows whose hash starts with its prefix. It splits on one more bit while it is over the byte
limit, so a row's shard is its shortest prefix whose bucket fits. Bucket sizes come from one histogram of the longest
prefixes, summed up level by level; only cells of the histogram that are still oversized are cut further.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, narrowed, read_table

LIMIT = 16 << 20
HASH_BITS = 60
#: Histograms of up to so many bits have at most 65,536 rows of six numbers, some 3 MB, and are sent to all executors.
SMALL_BITS = 16


def _hashed(docs: DataFrame) -> DataFrame:
    """``row`` (a struct, so that no column of the input meets one of ours), ``h`` (the first 60 bits of an md5 of id and text) and ``bytes``."""
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(","), F.md5(text))
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    return docs.select(row, F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("h"), F.octet_length(text).cast("long").alias("bytes"))


def _levels(rows: DataFrame, base: int, bits: int) -> DataFrame:
    """Histogram cells of ``rows(h, bytes, n)`` by the first base + bits bits -> ``cell, depth, shard_bytes, shard_docs``; depth null where even the cell is oversized."""
    cells = rows.groupBy(F.shiftright("h", HASH_BITS - base - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    at = cells.withColumn("depth", F.explode(F.expr(f"sequence({base}, {base + bits})"))).withColumn("prefix", F.expr(f"shiftright(cell, {base + bits} - depth)"))
    sums = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    return at.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"])


def directory(sized: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """``sized(h, bytes)`` -> for each round the length of its cells and ``cell, depth, shard_bytes, shard_docs`` of the cells it settled."""
    rows = sized.select("h", "bytes", F.lit(1).alias("n"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    out, base, bits = [], 0, min(22, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    while True:
        last = base + bits >= HASH_BITS
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | F.lit(last) & (F.col("depth") == HASH_BITS)
        leaf = F.min(F.when(fits, F.struct("depth", "shard_bytes", "shard_docs"))).alias("leaf")
        found = scratch.save(_levels(rows, base, bits).groupBy("cell").agg(leaf).select("cell", "leaf.depth", "leaf.shard_bytes", "leaf.shard_docs"), "cells")
        out.append((base + bits, found.where("depth is not null")))
        over = found.where("depth is null").select("cell")
        if over.isEmpty():
            return out
        rows = rows.join(over, F.shiftright("h", HASH_BITS - base - bits) == F.col("cell"), "left_semi")
        base, bits = base + bits, min(8, HASH_BITS - base - bits)


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All rows and columns of ``docs`` (it needs ``doc_id`` and ``text``) with ``shard_id, depth, n_bytes, shard_bytes, shard_docs``.

    ``shard_id`` is the shard's hash prefix in binary digits, empty if all fits one shard. Sizes are UTF-8 bytes of the
    text, 0 for null or empty ones. A shard is over the limit only if it holds one row, or rows equal in id and text, which no hash
    separates. Null ids count as empty. An empty table gives no rows; input columns with the names of the results give
    way to these.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    new = ["shard_id", "depth", "n_bytes", "shard_bytes", "shard_docs"]
    docs = docs.drop(*new)
    sized = scratch.save(_hashed(narrowed(docs, doc_id="doc_id", text="text")).select("h", "bytes"), "sized")
    rounds, hashed, parts = directory(sized, limit, scratch), _hashed(docs), []
    for length, leaves in rounds:
        parts.append(hashed.join(F.broadcast(leaves) if length <= SMALL_BITS else leaves, F.shiftright("h", HASH_BITS - length) == F.col("cell")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    digits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftright(h, {HASH_BITS} - depth)), depth, '0')"))
    return out.select("row.*", digits.alias("shard_id"), F.col("depth").cast("long").alias("depth"), F.col("bytes").alias("n_bytes"), "shard_bytes", "shard_docs")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(narrowed(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")).select("doc_id", "shard_id", "depth", "n_bytes", "shard_bytes", "shard_docs")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ',' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT doc_id, n_bytes, h, depth, h >> ({HASH_BITS} - depth) AS prefix FROM d, (SELECT unnest(generate_series(0, {HASH_BITS})) AS depth)),
s AS (SELECT *, sum(n_bytes) OVER b AS shard_bytes, count(*) OVER b AS shard_docs FROM p WINDOW b AS (PARTITION BY depth, prefix))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard_id, CAST(depth AS BIGINT) AS depth, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM s WHERE shard_bytes <= {LIMIT} OR shard_docs = 1 OR depth = {HASH_BITS}
QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) = 1
"""
