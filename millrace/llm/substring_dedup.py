"""Substring deduplication over a log-structured fingerprint index.

The index is a log of immutable runs of the fingerprints of windows seen so far, each with how often. A run is a table
bucketed and sorted by fingerprint, so a new batch, written as a run itself, is merge-joined with the older ones without
moving or sorting either; what it shares with them, or holds twice, is a hit. When runs are many they are compacted into
one. A log lives in a folder: it can be opened again and given the next batch without reading what came before. Hits are
verified on the windows themselves. A window is posted under the fingerprint of its selected seed (see ``_repeats``), so
windows that repeat always hit.
"""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, narrowed, pieces, read_table
from ._repeats import Units, contested, digested, numbered, posted, ranges, removed, repeated

WINDOW, SEED = 35, 12
#: Runs that may stand side by side before they are compacted, and batches that the query cuts its table in, so that it compacts.
FAN_IN, BATCHES = 3, 4
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class FingerprintLog:
    """Runs ``fp, n`` under one folder that driver and executors share.

    A run is named ``run-FIRST-LAST`` after the batches in it and counts once its ``_SUCCESS`` is there; a compacted run
    replaces those within it. So a job that dies leaves a log that opens as it was. The number of buckets is fixed by the
    first run: one file per bucket, which a merge join reads in order.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        fixed = [int(n.split("-")[1]) for n in names if n.startswith("buckets-")]
        self.buckets = fixed[0] if fixed else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not fixed:
            self._fs.mkdirs(self._path(f"{self.folder}/buckets-{self.buckets}"))
        whole = [n for n in names if n.startswith("run-") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        self.runs: list[tuple[int, int, str]] = []
        for first, last in sorted(((int(n.split("-")[1]), int(n.split("-")[2])) for n in whole), key=lambda x: (x[0], -x[1])):
            if not self.runs or first > self.runs[-1][1]:
                self.runs.append((first, last, self._table(f"run-{first}-{last}")))

    def _table(self, name: str) -> str:
        """A name under which Spark knows the run's buckets."""
        table = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return table

    def _write(self, counts: DataFrame, first: int, last: int) -> None:
        name = f"run-{first}-{last}"
        table = f"fingerprints_{uuid.uuid4().hex}"
        counts.repartition(self.buckets, "fp").write.mode("overwrite").bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(table)
        self.runs.append((first, last, table))

    @contextlib.contextmanager
    def _in_order(self):
        """Buckets of one file each are read as sorted; Spark asks for this to be said."""
        before = self.spark.conf.get(_SORTED, None)
        self.spark.conf.set(_SORTED, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(_SORTED)
            else:
                self.spark.conf.set(_SORTED, before)

    def shared(self, with_run: int = -1) -> DataFrame:
        """Fingerprints of a run that it holds twice or shares with an older one."""
        new, old = self.spark.table(self.runs[with_run][2]), [self.spark.table(t) for _, _, t in self.runs[:with_run]]
        out = new.where("n > 1").select("fp")
        for run in old:
            out = out.unionByName(new.hint("merge").join(run.select("fp"), "fp", "left_semi").select("fp"))
        return out

    def ingest(self, batch: DataFrame, scratch: Scratch) -> DataFrame:
        """Adds a batch ``(fp)`` as a run; gives the fingerprints that have repeated by now and are in the batch. Null fingerprints are left out."""
        k = self.runs[-1][1] + 1 if self.runs else 0
        self._write(batch.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")), k, k)
        with self._in_order():
            hits = scratch.save(self.shared(), "hits").distinct()
        if len(self.runs) >= FAN_IN:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merges all runs into one; the old ones are deleted when it is complete."""
        old, self.runs = self.runs, []
        # Read as plain files: Spark 4.1 takes a union of bucketed tables for one of their partitionings and would not bring equal keys together.
        every = self.spark.read.schema("fp long, n long").parquet(*(f"{self.folder}/run-{first}-{last}" for first, last, _ in old))
        self._write(every.groupBy("fp").agg(F.sum("n").alias("n")), old[0][0], old[-1][1])
        for first, last, t in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self._fs.delete(self._path(f"{self.folder}/run-{first}-{last}"), True)

    def forget(self) -> None:
        """Deletes the log."""
        for _, _, t in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._fs.delete(self._path(self.folder), True)


def _windows(units: Units):
    """Digests of the windows of pieces."""

    def run(batches):
        for b in pieces(batches, 2000):
            out: list[tuple] = []
            for fp, p1, p2, n, c in zip(*(b.column(k).to_pylist() for k in ("fp", "p1", "p2", "n", "content"))):
                u = units.split(c)
                for k in range(len(u) - units.window + 1):
                    d = xxhash.xxh3_128_digest(units.content(u, k, k))
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), fp, p1, p2, k, n == 1))
            if out:
                kinds = (pa.int64(),) * 6 + (pa.bool_(),)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["h1", "h2", "fp", "p1", "p2", "k", "single"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    """One row per document: ``doc_id, n_units, n_removed, n_spans, kept, kept_sha256``; units are words.

    Every word under a window of ``window`` words whose sequence starts anywhere else in the table is removed; windows
    are judged on the input. ``kept`` is the words that stay, joined by one space, in UTF-8. Null and empty texts have no words;
    texts shorter than a window are never touched; long ones are read whole. Rows equal in id and text are separate
    documents that repeat each other; null ids are ids. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch, units = Scratch(spark, "substrings"), Units(window, seed, True)
    docs = numbered(narrowed(docs, doc_id=id_col, text=text_col), scratch)
    posts = scratch.save(posted(docs, units), "posts")
    log, hits = FingerprintLog(spark, f"{scratch.root}/log"), None
    for k in range(batches):
        new = log.ingest(posts.where(F.pmod(F.xxhash64("rid"), F.lit(batches)) == k).select("fp"), scratch)
        hits = new if hits is None else hits.unionByName(new)
    log.forget()
    found = scratch.save(repeated(posts, scratch.save(hits.distinct(), "hits")), "found")
    scratch.drop(posts)
    parts = scratch.save(digested(docs, found, units), "pieces")
    scratch.drop(found)
    kinds, content = contested(docs, parts, units, scratch)
    windows = scratch.save(content.mapInArrow(_windows(units), "h1 long, h2 long, fp long, p1 long, p2 long, k long, single boolean"), "windows")
    twice = scratch.save(windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "twice")
    single = windows.where("single").join(twice, ["h1", "h2"], "left_semi").groupBy("fp", "p1", "p2").agg(F.collect_list(F.expr("shiftleft(k, 32) + k")).alias("rs"))
    return removed(docs, ranges(parts, kinds, single, scratch), units, docs.schema["doc_id"].dataType.simpleString())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")
