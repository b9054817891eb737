"""What the operators of this package share: scratch tables, whole-text Arrow batches, word rules, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters and digits and of all bytes beyond ASCII.
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset a new local folder, on a single machine only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir() or there
    return there.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str, codec: str = "zstd", group: int | None = None) -> DataFrame:
        """The table as written; ``group``: bytes of a row group, more or less, for rows so large that a few fill one."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        # Parquet's writer looks at what it holds after 100 rows only, unless told otherwise; a dictionary begun anew for so few rows costs time and saves nothing.
        sizes = {} if group is None else {"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
        df.write.option("compression", codec).options(**sizes).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing columns of the input cannot interfere."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows: what is held at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text.isNull() | (body == ""), F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")
