"""Byte-substring deduplication with suffix arrays built by linear grouping.

``suffix_array`` sorts suffixes without recursion. First they are grouped by Lyndon prefix: groups are processed in
descending order; each member's previous-smaller suffix is found by following pointers over what is processed, and the
suffixes so found move, by how often they were found, to new groups just above their old ones. Then the groups are
filled in ascending order: each suffix placed puts the one before it, and those on its chain of previous-smaller
pointers, into the next free places of their groups.

In the corpus, candidate pieces come from selected seeds (see ``_repeats``). The different pieces of a seed meet in one
suffix array. They are aligned at the seed, so between the places where two of them begin or cease to agree all their
windows agree or differ alike: the bytes between two such places are one symbol, ranked by its bytes, and one window
stands for all that start there. Windows next to each other in the suffix array are compared symbol by symbol.
The pieces of a seed that has very many are cut into families of neighbouring windows that share all but their margins;
a family that is still too large for one array is sorted in several, and the windows that differ within each are
merged by their 128-bit digests.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, narrowed, pieces, read_table
from ._repeats import Units, contested, digested, numbered, posted, ranges, removed, repeated

WINDOW, SEED = 200, 40
#: Neighbouring window starts of a family.
FAMILY = 16
#: Strings of one seed or family that meet in one suffix array.
ARRAY_ROWS = 2000
#: Bytes that a suffix array is made for, and that a task sorts, more or less.
ARRAY_BYTES, TASK_BYTES = 1 << 18, 1 << 22


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of the suffixes; the last symbol must be smaller than all others."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    members: list[list[int]] = []
    group, rank = [0] * n, {}
    for c in sorted(set(symbols)):
        rank[c] = len(members)
        members.append([])
    for i, c in enumerate(symbols):
        group[i] = rank[c]
        members[rank[c]].append(i)
    lower, higher = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    smaller, done = [-1] * n, bytearray(n)
    order: list[list[int]] = []
    current = len(members) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        own.sort()
        found: dict[int, int] = {}
        for i in own:
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        order.append(own)
        members[current] = []
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in found.items():
            moved.setdefault((group[j], times), []).append(j)
        top: dict[int, int] = {}
        for old, times in sorted(moved):
            # Directly above the group that the same old group's members with fewer such suffixes went to.
            below, new = top.get(old, old), len(members)
            members.append(moved[old, times])
            for j in members[new]:
                group[j] = new
            lower.append(below)
            higher.append(higher[below])
            lower[higher[below]] = new
            higher[below] = top[old] = new
        current = lower[current]
    free, at, start = [0] * len(order), 0, [0] * n
    for k in range(len(order) - 1, -1, -1):
        for i in order[k]:
            start[i] = k
        free[k] = at
        at += len(order[k])
    out, placed = [-1] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    free[start[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            k = start[j]
            out[free[k]] = j
            free[k] += 1
            j = smaller[j]
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    least = 0
    while most - least > 1:
        mid = (least + most) // 2
        if a[least:mid] == b[least:mid]:
            least = mid
        else:
            most = mid
    return least


def _agreement(strings: list[bytes]) -> tuple[list[int], set[int]]:
    """For each string the longest prefix that it shares with another, and all lengths at which some part ways."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    most, ways = [0] * len(strings), set()
    for x, y in zip(order, order[1:]):
        n = _shared(strings[x], strings[y])
        ways.add(n)
        most[x], most[y] = max(most[x], n), max(most[y], n)
    return most, ways


class _Group:
    """Strings ``(anchor, content)`` aligned at their anchors, as symbols. A window is known by how many of its bytes lie before the anchor.

    ``spread``: equal windows may be elsewhere too, so all windows are kept and not only those that some other string may share.
    """

    def __init__(self, strings: list[tuple[int, bytes]], window: int, spread: bool):
        left, cuts = _agreement([c[:a][::-1] for a, c in strings])
        right, ends = _agreement([c[a:] for a, c in strings])
        if spread:
            left, right = [a for a, _ in strings], [len(c) - a for a, c in strings]
            cuts, ends = cuts | set(left), ends | set(right)
        self.strings, self.window = strings, window
        #: Where windows may begin or cease to be equal.
        self.at = sorted({0} | {n + 1 for n in cuts} | {max(0, window - n) for n in ends})
        valid = [(max(0, window - r), x) for x, r in zip(left, right)]
        self.rows = [i for i, (x, y) in enumerate(valid) if x <= y]
        self.used = [o for o in self.at if any(valid[i][0] <= o <= valid[i][1] for i in self.rows)]
        place = {o: i for i, o in enumerate(self.used)}
        self.span = {i: (min(own), max(own)) for i in self.rows if (own := [place[o] for o in self.used if valid[i][0] <= o <= valid[i][1]])}

    def symbols(self, i: int) -> list[tuple[int, bytes]]:
        """String i as cells ``(which, bytes)`` from its first window to the end of its last."""
        (a, c), (low, high), u, w = self.strings[i], self.span[i], self.used, self.window
        m = len(u) - 1
        before = [(m - k, c[a - u[k] : a - (u[k - 1] if k else 0)]) for k in range(high, -1, -1)]
        return before + [(2 * m + 1 - k, c[a + (w - u[k + 1] if k < m else 0) : a + w - u[k]]) for k in range(m, low - 1, -1)]

    def starts(self, k: int) -> range:
        """The windows that the k-th stands for, by their bytes before the anchor."""
        o = self.used[k]
        return range(o, min((x for x in self.at if x > o), default=o + 1))


def equal_windows(groups: list[_Group]) -> list[tuple[int, int, list[int]]]:
    """Classes of equal windows, ``(group, window, strings)``, of all groups by one suffix array; those of one string too."""
    cells: dict[tuple[int, int, bytes], int] = {}
    texts: list[tuple[int, int, list[tuple[int, int, bytes]]]] = []
    for g, group in enumerate(groups):
        for i in group.span:
            text = [(g, which, part) for which, part in group.symbols(i)]
            texts.append((g, i, text))
            cells.update(dict.fromkeys(text))
    # Symbols are ranked by group, place and bytes; 1 ends a string, 0 all.
    for n, cell in enumerate(sorted(cells)):
        cells[cell] = n + 2
    symbols: list[int] = []
    owner: dict[int, tuple[int, int, int]] = {}
    for g, i, text in texts:
        low, high = groups[g].span[i]
        owner |= {len(symbols) + high - k: (g, i, k) for k in range(low, high + 1)}
        symbols += [cells[cell] for cell in text]
        symbols.append(1)
    symbols.append(0)
    out: list[tuple[int, int, list[int]]] = []
    last: list[int] | None = None
    for s in suffix_array(symbols):
        if s not in owner:
            continue
        g, i, k = owner[s]
        own = symbols[s : s + len(groups[g].used) + 1]
        if own == last:
            out[-1][2].append(i)
        else:
            out.append((g, k, [i]))
        last = own
    return out


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


_STRINGS = "fp long, common long, p1 long, p2 long, single boolean, first int, anchor int, content binary"


def _families(units: Units):
    """Cuttings of pieces around FAMILY neighbouring windows, with a key from the bytes that all these windows share and a digest of the whole."""

    def run(batches):
        for b in pieces(batches, 1000):
            out: list[tuple] = []
            for fp, p1, p2, n, anchor, c in zip(*(b.column(k).to_pylist() for k in ("fp", "p1", "p2", "n", "anchor", "content"))):
                least = anchor - (len(c) - units.window)
                for f in range(max(least, 0) // FAMILY, anchor // FAMILY + 1):
                    first, last = anchor - min(FAMILY * f + FAMILY - 1, anchor), anchor - max(FAMILY * f, least)
                    at = anchor - FAMILY * f
                    common = xxhash.xxh3_64_intdigest(c[at : at + units.window - FAMILY + 1], f) >> 1
                    cut = c[first : last + units.window]
                    out.append((fp, common, p1, p2, n == 1, first, anchor - first, cut, *_signed(xxhash.xxh3_128_digest(cut, anchor - first))))
            if out:
                kinds = (*(pa.int64(),) * 4, pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [*(c.split()[0] for c in _STRINGS.split(", ")), "d1", "d2"])

    return run


_ORDERED = "fp long, p1 long, p2 long, r long, h1 long, h2 long, single boolean"


def _sorted(window: int):
    """Strings of whole groups -> ranges of windows that repeat; of spread groups also each class of windows with a digest."""

    def run(table):
        t = table.sort_by([(c, "ascending") for c in ("fp", "common", "chunk", "p1", "p2", "first")])
        fp, common, chunk, p1, p2, single, spread, first, anchor, content = (t.column(c).to_pylist() for c in ("fp", "common", "chunk", "p1", "p2", "single", "spread", "first", "anchor", "content"))
        keys = list(zip(fp, common, chunk))
        begins = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        groups = [_Group(list(zip(anchor[a:z], content[a:z])), window, spread[a]) for a, z in zip(begins, [*begins[1:], len(keys)])]
        out: list[tuple] = []
        for g, k, members in equal_windows(groups):
            rows = [begins[g] + i for i in members]
            starts = groups[g].starts(k)
            if len(rows) > 1:
                out += [(fp[x], p1[x], p2[x], (first[x] + anchor[x] - starts[-1]) << 32 | first[x] + anchor[x] - starts[0], None, None, True) for x in rows if single[x]]
            if spread[rows[0]]:
                x = rows[0]
                for o in starts:
                    at = anchor[x] - o
                    out.append((fp[x], p1[x], p2[x], (first[x] + at) << 32 | first[x] + at, *_signed(xxhash.xxh3_128_digest(content[x][at : at + window])), len(rows) == 1 and single[x]))
        kinds = (*(pa.int64(),) * 6, pa.bool_())
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out) if out else ((),) * 7, kinds)], names=[c.split()[0] for c in _ORDERED.split(", ")])

    return run


def _hot(content: DataFrame, units: Units, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Strings of families, equal ones once, for the suffix arrays; and ranges of cuttings that occur in several pieces."""
    family = scratch.save(content.mapInArrow(_families(units), f"{_STRINGS}, d1 long, d2 long"), "families")
    # Equal cuttings of different pieces repeat in whole and go to the suffix arrays once.
    one = F.min(F.struct("p1", "p2", "first", "single", "anchor")).alias("one")
    same = scratch.save(family.groupBy("fp", "common", "d1", "d2").agg(F.count("*").alias("c"), one), "cuttings")
    alone = (F.col("c") == 1) & F.col("one.single")
    sizes = scratch.save(same.groupBy("fp", "common").agg(F.count("*").alias("n"), F.max(alone).alias("any")).where("n > 1 and any"), "sizes")
    reps = same.join(sizes, ["fp", "common"]).select("fp", "common", "n", "one.p1", "one.p2", "one.first", alone.alias("alone"))
    strings = family.drop("single").join(reps, ["fp", "common", "p1", "p2", "first"]).withColumnRenamed("alone", "single")
    twice = scratch.save(same.where("c > 1").select("fp", "common", "d1", "d2"), "twice")
    copied = family.where("single").join(twice, ["fp", "common", "d1", "d2"], "left_semi")
    return strings, copied.select("fp", "p1", "p2", F.expr(f"shiftleft(cast(first as bigint), 32) + first + octet_length(content) - {units.window}").alias("r"))


def _repeats(content: DataFrame, units: Units, scratch: Scratch) -> DataFrame:
    """Window ranges that repeat in contested pieces that occur once: ``fp, p1, p2, r``."""
    hot = scratch.save(content.groupBy("fp").agg(F.count("*").alias("k")).where(F.col("k") > ARRAY_ROWS).select("fp"), "hot")
    whole = (F.lit(0).cast("long").alias("common"), F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("spread"))
    strings = content.join(hot, "fp", "left_anti").select("fp", *whole, "p1", "p2", (F.col("n") == 1).alias("single"), F.lit(0).alias("first"), "anchor", "content")
    copied = None
    if not hot.isEmpty():
        cut, copied = _hot(content.join(hot, "fp", "left_semi"), units, scratch)
        parts = F.ceil(F.col("n") / ARRAY_ROWS)
        chunk = F.pmod(F.xxhash64("p1", "p2", "first"), parts)
        strings = strings.unionByName(cut.select("fp", "common", chunk.alias("chunk"), (parts > 1).alias("spread"), "p1", "p2", "single", "first", "anchor", "content"))
    size = content.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    arrays, tasks = max(1, -(-size // ARRAY_BYTES)), max(1, -(-size // TASK_BYTES))
    dealt = strings.withColumn("array", F.pmod(F.xxhash64("fp", "common", "chunk"), F.lit(arrays))).repartition(tasks, "array")
    ordered = scratch.save(dealt.groupBy("array").applyInArrow(_sorted(units.window), _ORDERED), "ordered")
    out = ordered.where("h1 is null").select("fp", "p1", "p2", "r")
    if copied is not None:
        twice = scratch.save(ordered.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "merged")
        met = ordered.where("h1 is not null and single").join(twice, ["h1", "h2"], "left_semi").select("fp", "p1", "p2", "r")
        out = out.unionByName(copied).unionByName(met)
    return out


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_units, n_removed, n_spans, kept, kept_sha256``; units are UTF-8 bytes.

    Every byte under a string of ``window`` bytes that also starts anywhere else in the table, the same document
    included, is removed; strings are judged on the input and never cross documents. Null and empty texts have no bytes;
    texts shorter than a window are never touched; long ones are read whole. Rows equal in id and text are separate
    documents that repeat each other; null ids are ids. An empty table gives no rows; further columns are ignored.
    """
    scratch, units = Scratch(docs.sparkSession, "suffixes"), Units(window, seed, False)
    docs = numbered(narrowed(docs, doc_id=id_col, text=text_col), scratch)
    posts = scratch.save(posted(docs, units), "posts")
    hits = scratch.save(posts.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "hits")
    found = scratch.save(repeated(posts, hits), "found")
    scratch.drop(posts)
    parts = scratch.save(digested(docs, found, units), "pieces")
    scratch.drop(found)
    kinds, content = contested(docs, parts, units, scratch)
    single = _repeats(content, units, scratch).groupBy("fp", "p1", "p2").agg(F.collect_list("r").alias("rs"))
    return removed(docs, ranges(parts, kinds, single, scratch), units, docs.schema["doc_id"].dataType.simpleString())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(read_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
