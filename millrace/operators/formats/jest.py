"""jest: one block per bullet, up to the next bullet or file header; all ends at the first summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import patterns as P
from ...functions.text import group, matches, strip_ansi, trimmed
from .segments import blocks, bodies, ever, running, so_far


def parse(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    header = matches(line, P.JEST_FILE)
    marked = lines.withColumns({"header": header, "summary": ~header & matches(line, P.JEST_SUMMARY)})
    marked = marked.withColumn("over", ever(F.col("summary"))).where("not over")
    marked = marked.withColumn("bullet", ~F.col("header") & matches(strip_ansi(line), P.JEST_BULLET)).withColumn("opens", F.col("header") | F.col("bullet"))
    marked = marked.where(F.col("opens") | ~matches(line, P.JEST_VERBOSE))
    suite = F.last(F.when(F.col("header"), group(line, P.JEST_FILE, 2)), ignorenulls=True).over(so_far())
    islands = marked.withColumns({"island": running(F.col("opens")), "suite": suite}).where("island > 0")
    found = bodies(islands, "island", line="line", bullet="bullet", suite="suite").where("bullet")
    return blocks(found, "jest", F.lit("test_failure"), F.lit("error"), trimmed(group(strip_ansi(F.col("line")), P.JEST_BULLET, 1)), {"suite_file": F.col("suite")})
