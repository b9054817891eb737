"""Logs as rows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import LINE_BYTES


def split_lines(text: Column) -> Column:
    """Array of a text's lines: ``\\n`` ends a line, one ``\\r`` before it belongs to the end, an empty rest is no line.

    Reading stops before the first line of 1 MiB or more. Null and empty texts have no lines.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    cut = F.array_position(F.transform(parts, lambda x: F.octet_length(x) >= LINE_BYTES - 1), True)
    parts = F.when(F.octet_length(text) < LINE_BYTES, parts).when(cut > 0, F.slice(parts, 1, (cut - 1).cast("int"))).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def lines_of(logs: DataFrame, id_col: str = "log_id", text_col: str = "text") -> DataFrame:
    """Whole logs -> ``log_id, line_no, line``; one row per line, numbered from 1. No shuffle."""
    named = logs.select(F.col(id_col).cast("string").alias("log_id"), F.posexplode(split_lines(F.col(text_col))).alias("p", "line"))
    return named.select("log_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """One log per file: ``log_id`` (its path) and ``text``."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text"))


def read_stdin(spark: SparkSession, stream, log_id: str = "-") -> DataFrame:
    """What a byte stream holds, as one log. It is read by the driver, so it is as long as the driver's memory allows; larger logs come from files."""
    return spark.createDataFrame([(log_id, bytearray(stream.read()))], "log_id string, raw binary").select("log_id", F.col("raw").cast("string").alias("text"))


def concatenated(parts: DataFrame) -> DataFrame:
    """``log_id, k, text``: the texts of a log in the order of ``k``, with a line end between them -> ``log_id, text``."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    return parts.groupBy("log_id").agg(joined.alias("text"))


def read_concatenated(spark: SparkSession, *paths: str, log_id: str = "-") -> DataFrame:
    """Files read as one log, in the order given, with a line end between them."""
    parts = None
    for k, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(log_id).alias("log_id"), F.lit(k).alias("k"), F.col("value").alias("text"))
        parts = one if parts is None else parts.unionByName(one)
    return concatenated(parts)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Large files line by line, without holding a file in a row; numbers come from where a line lies in its file."""
    from pyspark.sql.window import Window

    raw = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value"
    )
    order = Window.partitionBy("log_id").orderBy("at", "k")
    # Reading stops before the first line of 1 MiB or more, as of whole logs.
    over = F.max((F.octet_length("value") >= LINE_BYTES - 1).cast("int")).over(order)
    line = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return raw.select("log_id", F.row_number().over(order).cast("long").alias("line_no"), line.alias("line"), over.alias("over")).where("over = 0").drop("over")


def input_lines(text: Column) -> Column:
    """Line ends, plus one if the text doesn't end with one."""
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(ends + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0), F.lit(0)).cast("long")


def samples(lines: DataFrame, size: int) -> DataFrame:
    """The first ``size`` bytes of each log, from its lines: ``log_id, sample``."""
    from pyspark.sql.window import Window

    before = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    head = lines.withColumn("at", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0))).where(F.col("at") < size)
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    return head.groupBy("log_id").agg(text.alias("whole")).select("log_id", prefix(F.col("whole"), size).alias("sample"))


def prefix(text: Column, size: int | Column) -> Column:
    """The first bytes of a text, as text; of a character cut in two nothing is left."""
    whole, size = F.encode(text, "UTF-8"), F.lit(size)
    # Up to three bytes of a cut character go: the longest prefix that is valid is taken.
    cut = F.coalesce(*(F.when(F.is_valid_utf8(part := F.substring(whole, F.lit(1), size - k).cast("string")), part) for k in range(4)))
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)
