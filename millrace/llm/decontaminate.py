"""Benchmark decontamination by a positional inverted index that is partitioned by document.

Each block of documents is a shard of the index: its terms in order, and for every term the sorted positions at which the
shard's tokens have it. The index is a table, one row per shard, and serves any number of test sets. A phrase starts from
the posting list of its term that is rarest in the shard; each start (position less offset) is looked up in the next
rarest term's list, and so on, until all terms agree. All phrases are advanced together, so a step is one search over the
starts still alive. Lists never leave their shard, so no key can be hot and nothing but the results is shuffled. The
phrases go to all shards in slices of bounded size, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import ALNUM_WORD, Scratch, narrowed, pieces, read_table

WINDOW = 13
#: Words of test items that one pass over the index may carry to all executors.
SLICE_WORDS = 2_000_000
#: Documents in a shard of the index, and bytes of text, more or less.
SHARD_ROWS, SHARD_BYTES = 500, 4 << 20
#: Bytes of a row group of the index, more or less. Spark's reader holds a row group's shards at once, however long the task's part of the file.
GROUP_BYTES = 4 << 20
#: Each byte as words have it, 0 for those between words.
_WORD_BYTES = bytes(c if ALNUM_WORD.match(bytes([c])) else 0 for c in bytes(range(256)).lower())


def terms(text: bytes | None) -> list[bytes]:
    return ALNUM_WORD.findall((text or b"").lower())


def _column_terms(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all texts: ``terms`` of a column of texts at once."""
    column = pa.compute.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    text = np.frombuffer((b"" if data is None else data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()).translate(_WORD_BYTES), np.uint8)
    at = offsets - offsets[0]
    word = text != 0
    # A text's first byte starts a word and its last one ends a word, whatever its neighbours hold.
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = at[(at > 0) & (at < len(text))]
    first[edge], last[edge - 1] = word[edge], word[edge - 1]
    start = np.flatnonzero(first)
    places = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)]).astype(np.int32)
    return np.diff(np.searchsorted(start, at)), pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(text[word])])


def _sorted_places(term: np.ndarray, n: int) -> np.ndarray:
    """Places in order of their terms, which are less than ``n``; of equal ones as they stand. Sixteen bits at a time, as numpy sorts those by counting."""
    order = np.argsort(term.astype(np.uint16), kind="stable")
    for bits in range(16, max(n - 1, 0).bit_length(), 16):
        order = order[np.argsort((term >> bits).astype(np.uint16)[order], kind="stable")]
    return order


class Phrases:
    """Test phrases of ``window`` consecutive words, or whole items of fewer, with the items that hold each; items without id come last, as one."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        at = {x: n for n, x in enumerate(self.items)}
        ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            w = [ids.setdefault(t, len(ids)) for t in terms(text)]
            for k in range(max(len(w) - window + 1, min(1, len(w)))):
                found.setdefault(tuple(w[k : k + window]), set()).add(at[item])
        self.terms = pa.array(list(ids), pa.binary())
        self.words = np.array([len(p) for p in found], np.int64)
        self.width = max(map(len, found), default=0)
        self.term = np.full((len(found), self.width), -1, np.int64)
        for n, p in enumerate(found):
            self.term[n, : len(p)] = p
        self.owners = [np.array(sorted(x), np.int64) for x in found.values()]


class Shard:
    """Positional postings of a block of documents: ``terms`` in order, the positions of each, and how many words each document has.

    Documents lie one after the other with a gap between them that is larger than ``gap``, so nothing within it spans two.
    """

    def __init__(self, n_words: np.ndarray, own: pa.Array | list[bytes], counts: np.ndarray, position: np.ndarray, gap: int):
        self.n_words, self.terms = n_words, pa.array(own, pa.binary())
        self.count, self.start = counts, np.concatenate([[0], np.cumsum(counts)])
        # Stored positions count words only; the gaps come in here.
        dense = np.concatenate([[0], np.cumsum(n_words)])
        self.position = position + (np.repeat(np.arange(len(n_words)), n_words) * (gap + 1))[position]
        self.first = dense + np.arange(len(dense)) * (gap + 1)
        self.span = int(self.first[-1]) + 1
        self.key = np.repeat(np.arange(len(own)), counts) * self.span + self.position

    @staticmethod
    def inverted(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Words per document, terms in order, how often each occurs, and the positions term by term."""
        n, words = _column_terms(column)
        coded = words.dictionary_encode()
        order = pa.compute.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        term = rank[coded.indices.to_numpy()]
        return n, coded.dictionary.take(order), np.bincount(term, minlength=len(rank)), _sorted_places(term, len(rank))

    @staticmethod
    def postings(texts: list[bytes | None]) -> tuple[list[int], list[bytes], list[int], np.ndarray]:
        """``inverted`` of a list of texts, as lists."""
        n, names, counts, positions = Shard.inverted(pa.array(texts, pa.binary()))
        return n.tolist(), names.to_pylist(), counts.tolist(), positions

    def local(self, asked: pa.Array) -> np.ndarray:
        """Place in ``terms`` of each term asked for, -1 for those that the shard lacks."""
        return pa.compute.fill_null(pa.compute.index_in(asked, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = term * self.span + at
        k = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return (self.key[k] == key) & (at >= 0) & (at < self.span) if len(self.key) else np.zeros(len(key), bool)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and start of every exact occurrence."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(phrases.words) or not len(self.key):
            return none
        own = np.append(self.local(phrases.terms), -2)  # -2 pads phrases that are shorter than the longest
        term = own[phrases.term]
        # A term that the shard lacks rules its phrases out.
        alive = np.flatnonzero((term != -1).all(axis=1))
        if not len(alive):
            return none
        rarity = np.where(term[alive] >= 0, self.count[term[alive]], np.iinfo(np.int64).max)
        order = np.zeros_like(term)
        order[alive] = np.argsort(rarity, axis=1, kind="stable")
        rarest = term[alive, order[alive, 0]]
        times = self.count[rarest]
        phrase = np.repeat(alive, times)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(times) - times, times)
        start = self.position[np.repeat(self.start[rarest], times) + within] - order[phrase, 0]
        for step in range(1, phrases.width):
            offset = order[phrase, step]
            other = term[phrase, offset]
            ok = (other < 0) | self.has(np.maximum(other, 0), start + offset)
            phrase, start = phrase[ok], start[ok]
        ok = start >= 0
        return phrase[ok], start[ok]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def near(self, own: np.ndarray, slop: int, anchor: int | None = None) -> np.ndarray:
        """Positions of the rarest of some terms, or of ``anchor``, about which all of them occur, in any order, within ``slop`` words to either side."""
        if not len(own) or (own < 0).any():
            return np.empty(0, np.int64)
        own = own[np.argsort(self.count[own], kind="stable")]
        if anchor is not None:
            own = np.concatenate([[anchor], own])
        at = self.position[self.start[own[0]] : self.start[own[0] + 1]]
        for x in own[1:]:
            there = self.position[self.start[x] : self.start[x + 1]]
            document = self.document(at)
            lo, hi = np.maximum(self.first[document], at - slop), np.minimum(self.first[document + 1] - 1, at + slop)
            at = at[np.searchsorted(there, hi, side="right") > np.searchsorted(there, lo, side="left")]
        return at


_POSTINGS = "n_words array<int>, terms array<binary>, counts array<int>, positions array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as shards hold them: some rows, fewer if their texts are long."""
    for b in pieces(batches, SHARD_ROWS):
        at, size, column = 0, 0, b.column(b.schema.get_field_index("text"))
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            size += n or 0
            if size > SHARD_BYTES and i > at:
                yield b.slice(at, i - at)
                at, size = i, n or 0
        yield b.slice(at)


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all tokens of all texts: one row per shard, ``ids, n_words, terms, counts, positions``.

    ``positions`` are word places in the shard, term by term as ``terms`` has them in order, ``counts`` of them each.
    Words are runs of ASCII letters and digits and of other than ASCII characters, in ASCII lower case; null texts have none.
    """
    docs = narrowed(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in _blocks(batches):
            if not b.num_rows:
                continue
            n, names, counts, positions = Shard.inverted(b.column(1))
            lists = (b.column(0), pa.array(n, pa.int32()), names, pa.array(counts, pa.int32()), pa.array(positions, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["ids", "n_words", "terms", "counts", "positions"])

    return docs.mapInArrow(run, f"ids array<{kind}>, {_POSTINGS}")


def _shards(b: pa.RecordBatch, gap: int) -> Iterator[Shard]:
    n, names, counts, positions = (b.column(b.schema.get_field_index(c)) for c in ("n_words", "terms", "counts", "positions"))
    for i in range(b.num_rows):
        yield Shard(n[i].values.to_numpy().astype(np.int64), names[i].values, counts[i].values.to_numpy().astype(np.int64), positions[i].values.to_numpy().astype(np.int64), gap)


def _saved(index: DataFrame, scratch: Scratch) -> DataFrame:
    """The index as a table, its shards numbered."""
    return scratch.save(index.select(F.monotonically_increasing_id().alias("shard"), "*"), "index", group=GROUP_BYTES)


_MATCHES = "shard long, row int, spans array<struct<first:int,last:int>>, items array<string>, nameless boolean"


def _slices(benchmark: DataFrame, scratch: Scratch) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The test items in lists of at most SLICE_WORDS words, each small enough to be sent to all executors; one at a time is gathered."""
    sized = scratch.save(benchmark.select("item_id", "text", (F.octet_length(F.coalesce("text", F.lit(""))) / 2 + 1).cast("long").alias("size")), "items")
    total = sized.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // (SLICE_WORDS // 2)))
    dealt = sized.withColumn("slice", F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(n)))
    for k in range(n):
        yield [(r.item_id, None if r.text is None else r.text.encode()) for r in dealt.where(F.col("slice") == k).select("item_id", "text").collect()]


def _tests(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return narrowed(benchmark, item_id=item_col, text=item_text).withColumn("item_id", F.col("item_id").cast("string"))


def _matched(sent):
    """Of each shard the documents in which a phrase occurs; ``sent`` is a broadcast of the phrases."""

    def run(batches):
        phrases = sent.value
        for b in batches:
            for number, shard in zip(b.column(0).to_pylist(), _shards(b, phrases.width)):
                rows = _found(shard, phrases)
                if rows:
                    row, spans, items, nameless = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(row), pa.int64()), pa.array(row, pa.int32()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string())), pa.array(nameless, pa.bool_())],
                        ["shard", "row", "spans", "items", "nameless"],
                    )

    return run


def _found(shard: Shard, phrases: Phrases) -> list[tuple[int, list[dict], list[str], bool]]:
    """Row in the shard, word ranges hit, items, and whether an item without id is among them, of each document that is hit."""
    phrase, start = shard.search(phrases)
    doc = shard.document(start)
    order, out = np.argsort(doc, kind="stable"), []
    for d, rows in zip(*_grouped(doc[order], order)):
        s = start[rows] - shard.first[d]
        edge = np.zeros(int(shard.n_words[d]) + 1, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + phrases.words[phrase[rows]], -1)
        hit = np.cumsum(edge[:-1]) > 0
        step = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        own = np.unique(np.concatenate([phrases.owners[p] for p in np.unique(phrase[rows])]))
        ids = [phrases.items[i] for i in own]
        out.append((int(d), [{"first": int(a), "last": int(z) - 1} for a, z in zip(step[::2], step[1::2])], sorted(i for i in ids if i is not None), None in ids))
    return out


def _grouped(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    u, at = np.unique(keys, return_index=True)
    return u, np.split(rows, at[1:]) if len(u) else []


def _covered(spans: Column) -> Column:
    """Words in sorted ranges that may overlap."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda t, s: F.struct(F.greatest(t["end"], s["last"]).alias("end"), (t["n"] + F.greatest(s["last"] - F.greatest(s["first"] - 1, t["end"]), F.lit(0))).cast("long").alias("n")), lambda t: t["n"])


def phrase_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, null_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, spans, items, nameless``; spans are word ranges hit, first and last included.

    A phrase is a run of ``window`` words of an item, or a whole item of fewer. Words are runs of ASCII letters and
    digits and of other than ASCII characters, in ASCII lower case. Null and wordless texts have no words and no match;
    wordless items are no phrases, nor are items with null ids unless ``null_ids``: then these hit as others do, are left
    out of ``items`` and set ``nameless``. Repeated rows are each judged; texts are read whole. With no items
    nothing matches; an empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    return index_matches(_saved(positional_index(docs, id_col, text_col), scratch), benchmark, scratch, item_col, item_text, window, null_ids)


def index_matches(index: DataFrame, benchmark: DataFrame, scratch: Scratch, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, null_ids: bool = False) -> DataFrame:
    """``phrase_matches`` on a stored index with ``shard``, the shards' numbers: the documents aren't read again."""
    tests = _tests(benchmark, item_col, item_text)
    tests = tests if null_ids else tests.where("item_id is not null")
    found, slices = None, 0
    for items in _slices(tests, scratch):
        # Written before the next slice is gathered, so that one slice is held at a time.
        sent = index.sparkSession.sparkContext.broadcast(Phrases(items, window))
        part = scratch.save(index.drop("ids").mapInArrow(_matched(sent), _MATCHES), "matches")
        sent.destroy()
        found, slices = part if found is None else found.unionByName(part), slices + 1
    if slices > 1:
        found = found.groupBy("shard", "row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("nameless").alias("nameless"))
    every = index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("row", "x")).select("shard", "row", F.col("x.ids").alias("doc_id"), F.col("x.n_words").cast("long").alias("n_words"))
    out = every.join(found, ["shard", "row"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    return out.select("doc_id", "n_words", _covered(spans).alias("n_hit"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("nameless", F.lit(False)).alias("nameless"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = WINDOW) -> DataFrame:
    """One row per document and item that meet: ``doc_id, item_id, positions``, the places of the item's anchor about which all its words occur.

    The anchor is the item's word that is rarest in all documents, the least of equals; the others may stand in any
    order within ``slop`` words to either side of it. Words are as in ``phrase_matches``, counted from 0. Each row of
    either table is matched by itself, null ids too; wordless items meet nothing; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    index = _saved(positional_index(docs, id_col, text_col), scratch)
    kind, out = index.schema["ids"].dataType.elementType.simpleString(), None
    for items in _slices(_tests(benchmark, item_col, item_text), scratch):
        asked = {t: None for _, text in items for t in terms(text)}
        counts = _counts(index, list(asked))
        sent = index.sparkSession.sparkContext.broadcast([(i, w, min(w, key=lambda x: (counts[x], x))) for i, t in items if (w := sorted(set(terms(t)))) and all(x in counts for x in w)])
        part = scratch.save(index.mapInArrow(_near(sent, slop), f"doc_id {kind}, item_id string, positions array<long>"), "near")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _counts(index: DataFrame, asked: list[bytes]) -> dict[bytes, int]:
    """How often each of some terms, at most those of one slice, occurs in all documents."""
    own = index.sparkSession.createDataFrame([(bytearray(t),) for t in asked], "term binary")
    found = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    return {bytes(r.term): r.n for r in found.join(own, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _near(sent, slop: int):
    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            for i, shard in enumerate(_shards(b, slop)):
                own = {t: k for k, t in enumerate(shard.terms.to_pylist())}
                rows, names, places = [], [], []
                for item, words, anchor in sent.value:
                    at = shard.near(np.array([own.get(w, -1) for w in words], np.int64), slop, own.get(anchor, -1))
                    for d, p in zip(*_grouped(shard.document(at), at)):
                        rows.append(int(d))
                        names.append(item)
                        places.append((p - shard.first[d]).tolist())
                yield pa.RecordBatch.from_arrays([ids[i].values.take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int64()))], ["doc_id", "item_id", "positions"])

    return run


_VERDICT = "n_hit > 0 and 20 * n_hit >= n_words"


def contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``phrase_matches``, by items with null ids too, with the verdict: at least a twentieth of a document's words, and one at least, are hit."""
    return phrase_matches(docs, benchmark, null_ids=True, **columns).withColumn("contaminated", F.expr(_VERDICT))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``contamination`` clears.

    ``docs`` has ``doc_id`` and ``text`` and may have columns of any other name. Null and wordless texts stay; of rows equal
    in id and text all stay or all go; an empty table, or no test items, leave all as it is.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    index = _saved(positional_index(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text"), "key", "text"), scratch)
    bad = scratch.save(index_matches(index, benchmark, scratch, null_ids=True).where(_VERDICT).select("doc_id.*").distinct(), "bad")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    gone = F.col("row.doc_id").eqNullSafe(bad["doc_id"]) & F.xxhash64("row.text").eqNullSafe(bad["h"])
    return rows.join(bad, gone, "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", (F.size("items") + F.col("nameless").cast("int")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + 12], ' ') AS phrase FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
o AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT o.r, o.i, o.k, p.item FROM o JOIN p ON o.phrase = p.phrase AND o.k = p.k),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""
