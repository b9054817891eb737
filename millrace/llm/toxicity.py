"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's subwords are the byte n-grams of its ASCII-lower-cased form that lie inside one word, the separators before
and after a word marking its ends; so an unseen misspelling shares most n-gram vectors with what it was made from. Each
n-gram has a vector (hashed buckets); a document is the mean of its n-grams' vectors, weighted by how surely they tell the classes apart;
a softmax over two classes follows. Vectors and softmax are trained together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import narrowed, pieces, raw, read_table

NGRAMS = (4, 5, 6)
BUCKETS_LOG2 = 17
DIM = 8
EPOCHS, BATCH, RATE = 12, 64, 0.5
#: The classifier is fitted on at most so many labelled rows of each class, chosen by hash of the id.
SAMPLE_PER_CLASS = 1500
THRESHOLD = 0.7
#: An n-gram whose shares of the two classes lie so many standard errors apart keeps half its weight; weaker ones keep less.
HALF_Z = 4.0
#: Least norm of a document's weights: a few weak n-grams don't count as much as many strong ones.
FLOOR = 8.0

_P = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.full(256, 1, np.uint8)  # 1: part of a word
for _c in range(256):
    if _c < 0x30 or 0x3A <= _c <= 0x40 or 0x5B <= _c <= 0x60 or 0x7B <= _c <= 0x7F:
        _KIND[_c] = 0


def buckets(text: bytes | None) -> np.ndarray:
    """Bucket of each subword occurrence of a whole text."""
    b = np.frombuffer(b" " + (text or b"").lower() + b" ", np.uint8)
    inside = _KIND[b].astype(bool)
    b = np.where(inside, b, 32).astype(np.uint64)
    out = []
    # inside[i+1 .. i+n-2] must all be parts of a word
    run = np.cumsum(~inside)
    for n in NGRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ b[j : len(b) - n + 1 + j]) * _P
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)[run[n - 2 :][: len(h)] - run[: len(h)] == 0])
    return np.concatenate(out) if out else np.empty(0, np.int32)


def associations(df: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Averaging weight of each bucket: how many standard errors its shares of the two classes lie apart, smoothly shrunk.

    Every bucket seen has a weight above 0; a bucket never seen has nothing to say.
    """
    p0, p1 = (df[0] + 0.5) / (n0 + 1), (df[1] + 0.5) / (n1 + 1)
    z = np.abs(p1 - p0) / np.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)
    return np.where(df.sum(0) > 0, z**3 / (z * z + HALF_Z**2), 0).astype(np.float32)


def fit(texts: list[bytes], toxic: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Trains on the given rows; gives each bucket's averaging weight, its logit (vector times softmax) and the bias.

    Without rows, or with one class only, the logits are 0 and the score is the smoothed share of class 1.
    """
    size = 1 << BUCKETS_LOG2
    y = np.array(toxic, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return np.ones(size, np.float32), np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    rows = []
    df = np.zeros((2, size), np.int32)
    for t, label in zip(texts, toxic):
        u, c = np.unique(buckets(t), return_counts=True)
        rows.append((u, np.log1p(c).astype(np.float32)))
        df[label, u] += 1
    weight = associations(df, len(y) - int(y.sum()), int(y.sum()))
    rows = [(u[weight[u] > 0], c[weight[u] > 0]) for u, c in rows]
    xs = []
    for u, c in rows:
        x = c * weight[u]
        xs.append(x / max(float(np.sqrt((x * x).sum())), FLOOR))
    rng = np.random.Generator(np.random.PCG64(7))
    vectors = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1] = rng.normal(0, 0.5, DIM)
    soft[:, 0] = -soft[:, 1]
    bias = np.zeros(2, np.float32)
    pace = [np.full(p.shape[0] if p.ndim > 1 else p.shape, 1e-6, np.float32) for p in (vectors, soft, bias)]
    onehot = np.stack([1 - y, y], 1).astype(np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = [i for i in order[at : at + BATCH] if len(rows[i][0])]
            if not some:
                continue
            idx = np.concatenate([rows[i][0] for i in some])
            val = np.concatenate([xs[i] for i in some])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in some)])[:-1]
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            hidden = np.add.reduceat(vectors[idx] * val[:, None], starts)
            z = hidden @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = (p - onehot[some]) / len(some)
            own = np.flatnonzero(np.bincount(idx, minlength=size))
            back = (g @ soft.T)[owner] * val[:, None]
            grad = np.stack([np.bincount(idx, back[:, d], size)[own] for d in range(DIM)], 1).astype(np.float32)
            pace[0][own] += (grad * grad).sum(1)
            rate = RATE * (1 - epoch / EPOCHS)
            vectors[own] -= rate * 0.3 * grad / np.sqrt(pace[0][own])[:, None]
            gs, gb = hidden.T @ g, g.sum(0)
            pace[1] += (gs * gs).sum(1)
            pace[2] += gb * gb
            soft -= rate * gs / np.sqrt(pace[1])[:, None] * 0.1
            bias -= rate * gb / np.sqrt(pace[2]) * 0.1
    return weight, (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(text: bytes | None, model: tuple[np.ndarray, np.ndarray, float]) -> float:
    weight, logit, bias = model
    found = buckets(text)
    found = found[weight[found] > 0]
    z = bias
    if len(found):
        u, c = np.unique(found, return_counts=True)
        x = np.log1p(c) * weight[u]
        z += float(x @ logit[u] / max(float(np.sqrt(x @ x)), FLOOR))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on at most ``per_class`` labelled documents of each class that aren't held out, the first by hash of their id.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice counts by its larger label, and
    an id with several texts by the least of them.
    """
    own = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    key = F.xxhash64(F.lit(11), "doc_id")
    picked = own.where("toxic = 1").orderBy(key, "doc_id").limit(per_class).unionByName(own.where("toxic = 0").orderBy(key, "doc_id").limit(per_class))
    # At most 2 * per_class rows of two numbers: small whatever the input.
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text.encode() for r in rows], [r.toxic for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null, empty and wordless texts get the model's prior. Texts of any length count whole. Without usable labels all
    scores are one half. Repeated rows get equal scores; further columns of either table are ignored.
    """
    docs = narrowed(docs, doc_id=id_col, text=text_col)
    model = train(docs, narrowed(labels, doc_id="doc_id", toxic="toxic"), per_class)

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t, model) for t in raw(b.column(1))], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``text`` scores below the threshold.

    ``docs`` has ``doc_id`` and ``text`` and may have columns of any other name. Nulls, empty texts and missing labels as in
    ``toxicity``; rows with one text all stay or all go; an empty table gives no rows.
    """
    model = train(narrowed(docs, doc_id="doc_id", text="text"), narrowed(labels, doc_id="doc_id", toxic="toxic"), per_class)
    at = docs.columns.index("text")
    # Rows go as structs: Spark can't hand columns with dots in their names to Arrow functions.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array([score(t, model) < threshold for t in raw(b.column(0).field(at))], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
