"""MinHash near-deduplication by an inverted join of signature coordinates.

Every distinct shingle set gets a signature of K minima. Sets are posted under each (coordinate, value). Two sets that
agree in at least T of K coordinates share one of the K-T+1 rarest of either's (prefix), so only these are joined, and
values that one set alone holds are skipped without being posted at all: a set with fewer than T shared values has no
partner. Pairs above the match threshold are confirmed on the full sets.

No long list is expanded into its pairs. In a first round each member of a list meets the smallest one, which joins groups
of copies whatever their size by as many pairs as they have members. In a second, members of short lists meet those that are
not in their component yet. Documents of long lists that still hold several components are compared block by block with
exact products of their shingle sets, which give a spanning forest of the links; that work grows with the square of such a group.

The T - 1 longest lists of a document aren't merged: whether a candidate is in them is looked up in its signature. Two sets
with a similarity of 0.75 agree in 48 coordinates on average and in fewer than T = 32 in 5 of a million pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, narrowed, pieces, raw, read_table
from ._graph import components, forest

WORDS, PERCENT = 5, 75
K, T = 64, 32
#: Lists up to this length are joined with themselves; documents that longer ones join are compared in blocks.
LONG, BLOCK = 64, 512
#: Shingles that a block may hold, more or less.
BLOCK_SHINGLES = 1 << 20
#: Shingles in one product of a block comparison.
COLUMNS = 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of so many words, in ASCII lower case; of all its words if fewer."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    acc = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        acc = _mixed(acc * _MIX + h[j : len(w) - n + 1 + j])
    return np.unique(acc)


def signature(found: np.ndarray) -> np.ndarray:
    """K minima of 32 bits."""
    out = np.full(K, np.uint64(2**64 - 1))
    for at in range(0, len(found), 4096):
        h = found[at : at + 4096]
        np.minimum(out, (_A[:, None] * h[None, :] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


_FEATURES = "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>"


def _featured(words: int):
    def run(batches):
        for b in pieces(batches):
            n, s, sigs = [], np.zeros((b.num_rows, 2), np.int64), np.zeros((b.num_rows, K), np.int32)
            for i, t in enumerate(raw(b.column(1))):
                found = shingles(t, words)
                n.append(len(found))
                if len(found):
                    s[i] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                    sigs[i] = signature(found)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * K), pa.array(sigs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), sig], ["doc_id", "n_shingles", "s1", "s2", "sig"])

    return run


def _sets(words: int):
    def run(batches):
        for b in pieces(batches, 200):
            found = [shingles(t, words).view(np.int64) for t in raw(b.column(1))]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))], ["doc_id", "shingles"])

    return run


def _compared(percent: int):
    """Links within a block of documents or between two, as a forest, by exact counts of shared shingles."""

    def run(key, table):
        side = table.column("right").to_numpy(zero_copy_only=False)
        ids = table.column("rep").to_numpy()
        sets = table.column("shingles").combine_chunks()
        n = sets.value_lengths().to_numpy().astype(np.int64)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        within = not len(right) and key[1].as_py() == key[2].as_py()
        if within:
            right = left
        value, col = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        # Shingles of a single document can't be shared.
        often = np.bincount(col, minlength=len(value)) > 1
        number = np.cumsum(often) - 1
        row, col = row[often[col]], number[col[often[col]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(often.sum()), COLUMNS):
            lo, hi = np.searchsorted(col, [at, at + COLUMNS])
            part = np.zeros((len(n), COLUMNS), np.float32)
            part[row[lo:hi], col[lo:hi] - at] = 1
            both += part[left] @ part[right].T
        both = both.astype(np.int64)
        i, j = np.nonzero(100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
        i, j = left[i], right[j]
        ok = i < j if within else np.ones(len(i), bool)
        node, root = forest(len(ids), i[ok], j[ok])
        return pa.table({"u": ids[node], "v": ids[root]})

    return run


def _dense(hot: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links among documents that long lists join: ``hot(key, rep, n)`` -> ``u, v``.

    Documents joined by long lists, directly or over others, are dealt to cells of similar size, cells to blocks of at most
    some BLOCK documents, and blocks are compared with those of their own and the next cell. A document goes to as many
    tasks as there are such blocks, and a task gives a forest, so nothing grows with the number of pairs but the products.
    """
    firsts = hot.groupBy("key").agg(F.min("rep").alias("v"))
    group = components(hot.join(firsts, "key").select(F.col("rep").alias("u"), "v"), scratch)
    docs = hot.select("rep", "n").distinct().join(group, F.col("rep") == F.col("node"))
    # Sets of n and m shingles are similar only if their cells are the same or neighbours.
    docs = docs.select("rep", F.col("component").alias("g"), "n", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("int").alias("cell"))
    blocks = scratch.save(docs.groupBy("g", "cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "cells")
    near = blocks.select("g", F.col("cell").alias("c"), F.col("blocks").alias("b"))
    own = docs.join(blocks, ["g", "cell"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = own.join(near, "g").where("c between cell - 1 and cell + 1").withColumn("o", F.explode(F.expr("sequence(0, b - 1)")))
    one, other = F.struct("cell", "i"), F.struct(F.col("c").alias("cell"), F.col("o").alias("i"))
    dealt = met.select("g", F.least(one, other).alias("x"), F.greatest(one, other).alias("y"), (other < one).alias("right"), "rep")
    return dealt.join(sets, F.col("rep") == F.col("doc_id")).select("g", "x", "y", "right", "rep", "shingles").groupBy("g", "x", "y").applyInArrow(_compared(percent), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles;
    ``component_id`` is the smallest id reachable over links. Null, empty and blank texts have empty sets and stand
    alone, as do rows whose id is null (component null, kept). Rows that share an id share its component. Very long
    texts are hashed whole. An empty table gives no rows; further columns of the input are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = narrowed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    features = scratch.save(docs.mapInArrow(_featured(words), _FEATURES), "features")
    # Equal sets are one class, so copies cost one row from here on.
    classes = scratch.save(
        features.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    posts = classes.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    rare = F.expr(f"slice(array_sort(collect_list(struct(df, key))), 1, greatest(0, count(1) - {T - 1}))")
    prefix = scratch.save(posts.join(shared, "key").groupBy("rep").agg(rare.alias("p")).where("size(p) > 0").select("rep", F.explode("p.key").alias("key")), "prefix")
    members = prefix.select("rep").distinct()
    sets = scratch.save(
        docs.join(members, docs.doc_id == members.rep, "left_semi").select("doc_id", "text").mapInArrow(_sets(words), "doc_id long, shingles array<long>"), "sets"
    )
    sized = scratch.save(classes.select("rep", "n", "sig").join(members, "rep", "left_semi"), "sized")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
        return both.where(f"100 * i >= {percent} * (t - i)").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs of near enough size that agree in T coordinates."""
        a, b = (sized.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
        same = F.expr("aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (t, x) -> t + x)")
        return pairs.join(b, "b").join(a, "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").where(same >= T).select("a", "b")

    lists = scratch.save(prefix.groupBy("key").agg(F.count("*").alias("len"), F.min("rep").alias("a")).where("len > 1"), "lists")
    pairs = prefix.withColumnRenamed("rep", "b").join(lists.select("key", "a"), "key").where("a <> b").select("a", "b").distinct()
    links = scratch.save(confirmed(scratch.save(alike(pairs), "first")), "links")
    found = components(links, scratch)

    # Second round: lists that still hold several components.
    labelled = prefix.join(lists.select("key", "len"), "key").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "len", F.coalesce("component", "rep").alias("comp"))
    labelled = scratch.save(labelled, "labelled")
    mixed = scratch.save(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
    open_ = scratch.save(labelled.where("len > 2").join(mixed, "key", "left_semi").join(sized.select("rep", "n"), "rep").select("key", "rep", "comp", "n", "len"), "open")
    hot, rest = open_.where(F.col("len") > LONG).select("key", "rep", "n"), open_.where(F.col("len") <= LONG)
    if not hot.isEmpty():
        links = links.unionByName(scratch.save(_dense(hot, sets, percent, scratch), "dense"))
    p, q = rest.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na")), rest.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    more = p.join(q, "key").where(f"a < b and ca <> cb and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
    links = links.unionByName(scratch.save(confirmed(alike(more)), "more"))
    found = components(links, scratch)

    named = classes.join(found, classes.rep == found.node, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    whole = features.select("doc_id", "n_shingles", "s1", "s2")
    out = whole.where("n_shingles > 0 and doc_id is not null").join(named, ["s1", "s2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = whole.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``near_duplicates`` keeps; rows that repeat a kept id stay.

    ``docs`` has ``doc_id`` and ``text`` and may have columns of any other name. Null ids, null and empty texts stay; an
    empty table gives no rows.
    """
    found = near_duplicates(docs, words=words, percent=percent)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")
