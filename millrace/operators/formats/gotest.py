"""go test: text by a fold, JSON by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions import patterns as P
from ...functions.text import group, matches, trimmed
from ...streaming.folds import GotestFold
from ..folding import fold_logs
from .segments import blocks

_JSON = "Action string, Package string, Test string, Output string, Elapsed double"


def parse_text(lines: DataFrame) -> DataFrame:
    return fold_logs(lines, "gotest", GotestFold)


def parse_json(lines: DataFrame) -> DataFrame:
    """Output of each test's attempt, given where the attempt fails. Lines that aren't JSON are skipped."""
    read = lines.select("log_id", "line_no", F.from_json("line", _JSON).alias("j")).where("j.Action is not null")
    rows = read.select("log_id", "line_no", F.col("j.Action").alias("action"), F.coalesce("j.Package", F.lit("")).alias("package"), F.coalesce("j.Test", F.lit("")).alias("test"), F.regexp_replace(F.coalesce("j.Output", F.lit("")), "\n+$", "").alias("line"))
    built = rows.where((F.col("action") == "output") & (F.col("test") == "") & matches(F.col("line"), P.GO_BUILD_ERROR))
    errors = blocks(built.select("log_id", F.col("line_no").alias("emit"), F.array("line").alias("body"), "line", "package"), "gotest", F.lit("build_failure"), F.lit("error"), F.col("line"), {"package": F.col("package")})
    ends = F.col("action").isin("fail", "pass", "skip")
    before = Window.partitionBy("log_id", "package", "test").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    tried = rows.where((F.col("test") != "") & (ends | (F.col("action") == "output"))).withColumn("attempt", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    framing = F.lit(False)
    for start in P.GO_JSON_FRAMING:
        framing = framing | trimmed(F.col("line")).startswith(start)
    said = (F.col("action") == "output") & (F.col("line") != "") & ~framing
    kept = F.collect_list(F.when(said, F.struct("line_no", "line")))
    failed = tried.groupBy("log_id", "package", "test", "attempt").agg(F.max(F.when(F.col("action") == "fail", F.col("line_no"))).alias("emit"), kept.alias("said")).where("emit is not null")
    failed = failed.withColumn("body", F.transform(F.array_sort("said"), lambda x: x["line"]))
    return errors.unionByName(blocks(failed, "gotest", F.lit("test_failure"), F.lit("error"), F.lit(""), {"test_id": F.col("test"), "package": F.col("package")}))


def parse(lines: DataFrame) -> DataFrame:
    """Blocks; a log whose first line that isn't blank starts a JSON report is read as JSON."""
    first = lines.where(trimmed(F.col("line")) != "").groupBy("log_id").agg(F.min_by("line", "line_no").alias("first"))
    as_json = first.where(F.col("first").startswith(P.GO_JSON_START)).select("log_id")
    return parse_json(lines.join(as_json, "log_id", "left_semi")).unionByName(parse_text(lines.join(as_json, "log_id", "left_anti")))
