"""Finding every window of units (words or bytes) that starts more than once in a corpus.

In each window the least of its seeds (short runs of units, by hash) is selected, so equal windows select equal seeds at
equal places. Only selected seeds are posted. Consecutive windows that select the same seed occurrence form a piece.
Pieces of seeds that occur twice are compared: equal pieces repeat in whole, and only of seeds with several different
pieces are single windows looked at, one representative of each distinct piece. So thousands of copies cost one.

A row is known by a number of its own, written with its text, so rows equal in all columns stay apart. Where a piece lies
is one long, ``place``: the first window start, how far the seed lies from it, and how many windows follow it.
Window ranges are longs too: the first start, and in the lower half the last.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch, pieces, raw

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_BYTE = np.random.Generator(np.random.PCG64(97)).integers(0, 2**63, 256, dtype=np.uint64)
_LOW = 0xFFFFFFFF
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        if size > 1 << 22:
            return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])
        have = _powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
    return have[:n]


@dataclass(frozen=True)
class Units:
    """What a window is made of: ``window`` units, seeds of ``seed`` units; a window has at most 256 seeds."""

    window: int
    seed: int
    words: bool

    def __post_init__(self):
        if not 0 < self.seed <= self.window <= self.seed + 255:
            raise ValueError("a window has 1 to 256 seeds")

    def split(self, text: bytes | None):
        return (text or b"").split() if self.words else (text or b"")

    def hashes(self, units) -> np.ndarray:
        if self.words:
            return np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))
        return _BYTE[np.frombuffer(units, np.uint8)]

    def content(self, units, first: int, last: int) -> bytes:
        part = units[first : last + self.window]
        return b" ".join(part) if self.words else part

    def selected(self, units) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the seed at each place, and for each window the place of the seed it selects, the first of equals."""
        h = self.hashes(units)
        n, k = len(h), self.seed
        if n < self.window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * _power(_BASE, n))])
        g = (total[k:] - total[:-k]) * _power(_BACK, n - k + 1)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(29)
        key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        w = self.window - k + 1
        padded = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = len(key) - w + 1
        return g, (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(_LOW)).astype(np.int64)


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text`` with ``rid``, the row's own number, written so that every later read gives the same."""
    return scratch.save(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "docs")


def posted(docs: DataFrame, units: Units) -> DataFrame:
    """``fp, rid, place``: every selected seed of every document."""

    def run(batches):
        for b in pieces(batches, 500):
            fps, rids, places = [], [], []
            for rid, t in zip(b.column(0).to_pylist(), raw(b.column(1))):
                g, s = units.selected(units.split(t))
                if len(s):
                    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    last = np.concatenate([first[1:], [len(s)]]) - 1
                    fps.append(g[s[first]])
                    places.append(first << 16 | (s[first] - first) << 8 | (last - first))
                    rids.append(np.full(len(first), rid, np.int64))
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in fps], rids, places)], ["fp", "rid", "place"])

    return docs.select("rid", "text").mapInArrow(run, "fp long, rid long, place long")


def repeated(posts: DataFrame, hits: DataFrame) -> DataFrame:
    """Of each document the posts whose seeds are in ``hits(fp)``, a written table, so that a seed with very many posts is split."""
    return posts.join(hits, "fp", "left_semi").groupBy("rid").agg(F.collect_list("fp").alias("fps"), F.collect_list("place").alias("places"))


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def digested(docs: DataFrame, found: DataFrame, units: Units) -> DataFrame:
    """Pieces of ``found(rid, fps, places)`` without their content: ``fp, p1, p2, rid, place``; p1 and p2 are the content's digest."""

    def run(batches):
        for b in pieces(batches, 200):
            out: list[tuple] = []
            for rid, t, fps, places in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                u = units.split(t)
                for fp, place in zip(fps, places):
                    a = place >> 16
                    out.append((fp, *_signed(xxhash.xxh3_128_digest(units.content(u, a, a + (place & 255)))), rid, place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["fp", "p1", "p2", "rid", "place"])

    both = docs.select("rid", "text").join(found, "rid").select("rid", "text", "fps", "places")
    return both.mapInArrow(run, "fp long, p1 long, p2 long, rid long, place long")


_CONTENT = "fp long, p1 long, p2 long, n long, anchor int, content binary"


def contested(docs: DataFrame, parts: DataFrame, units: Units, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces ``fp, p1, p2, n``, and of seeds with several of them, one alone at least, each piece once with its content: ``anchor`` is where its seed lies."""
    kinds = scratch.save(parts.groupBy("fp", "p1", "p2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("rep")), "kinds")
    several = scratch.save(kinds.groupBy("fp").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("fp"), "seeds")
    reps = kinds.join(several, "fp", "left_semi").groupBy(F.col("rep.rid").alias("rid")).agg(*(F.collect_list(c).alias(a) for c, a in (("fp", "fps"), ("p1", "p1s"), ("p2", "p2s"), ("n", "ns"), ("rep.place", "places"))))

    def run(batches):
        for b in pieces(batches, 200):
            out: list[tuple] = []
            for t, *cols in zip(raw(b.column(0)), *(b.column(i).to_pylist() for i in range(1, 6))):
                u = units.split(t)
                for fp, p1, p2, n, place in zip(*cols):
                    a = place >> 16
                    out.append((fp, p1, p2, n, place >> 8 & 255, units.content(u, a, a + (place & 255))))
            if out:
                kinds = (*(pa.int64(),) * 4, pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["fp", "p1", "p2", "n", "anchor", "content"])

    content = docs.select("rid", "text").join(reps, "rid").select("text", "fps", "p1s", "p2s", "ns", "places").mapInArrow(run, _CONTENT)
    return kinds, scratch.save(content, "contested")


def ranges(parts: DataFrame, kinds: DataFrame, single: DataFrame, scratch: Scratch) -> DataFrame:
    """Ranges of window starts that repeat, per document: ``rid, ranges``.

    Whole pieces where a piece occurs twice, else the ranges within the piece in ``single(fp, p1, p2, rs)``.
    """
    more = scratch.save(kinds.where("n > 1").select("fp", "p1", "p2", F.lit(None).cast("array<bigint>").alias("rs")).unionByName(single), "repeats")
    own = parts.join(more, ["fp", "p1", "p2"]).select("rid", "place", "rs")
    own = own.withColumn("first", F.expr("shiftright(place, 16)"))
    at = F.expr(f"if(rs is null, array(shiftleft(first, 32) + first + (place & 255)), transform(rs, r -> shiftleft(first + shiftright(r, 32), 32) + first + (r & {_LOW})))")
    return scratch.save(own.select("rid", at.alias("r")).groupBy("rid").agg(F.flatten(F.collect_list("r")).alias("ranges")), "ranges")


def _spans(found: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of units under windows that start in the given ranges: starts and ends."""
    found = np.sort(found)
    a, z = found >> 32, np.maximum.accumulate((found & _LOW) + window)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    return a[new], z[np.concatenate([new[1:], [len(a)]]) - 1]


def removed(docs: DataFrame, starts: DataFrame, units: Units, kind: str) -> DataFrame:
    """Per document ``doc_id, n_units, n_removed, n_spans, kept`` after the units under the window starts in ``starts(rid, ranges)`` are gone."""

    def run(batches):
        for b in pieces(batches, 500):
            rows: list[tuple] = []
            lists = b.column(2)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            for i, t in enumerate(raw(b.column(1))):
                u = units.split(t)
                n = len(u)
                if at[i] == at[i + 1]:
                    rows.append((n, 0, 0, b" ".join(u) if units.words else u))
                    continue
                a, z = _spans(values[at[i] : at[i + 1]], units.window)
                keep = [u[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), n])]
                rows.append((n, int((z - a).sum()), len(a), b" ".join(w for k in keep for w in k) if units.words else b"".join(keep)))
            n, gone, spans, kept = zip(*rows) if rows else ((),) * 4
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_units", "n_removed", "n_spans", "kept", "kept_sha256"])

    both = docs.join(starts, "rid", "left").select("doc_id", "text", F.coalesce("ranges", F.array().cast("array<bigint>")).alias("ranges"))
    return both.mapInArrow(run, f"doc_id {kind}, n_units long, n_removed long, n_spans long, kept binary, kept_sha256 string")
