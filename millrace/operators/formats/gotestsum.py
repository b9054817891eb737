"""gotestsum: sections that start with a failure header and end at the next, or at a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import patterns as P
from ...functions.text import group, matches, trimmed
from .segments import blocks, bodies, running


def parse(lines: DataFrame) -> DataFrame:
    fail, done = matches(F.col("line"), P.SUM_FAIL), F.col("line").startswith(P.SUM_DONE)
    marked = lines.withColumns({"fail": fail, "done": ~fail & done})
    islands = marked.withColumn("island", running(F.col("fail") | F.col("done"))).where("island > 0")
    found = bodies(islands, "island", line="line", fail="fail").where("fail")
    head = F.col("line")
    out = blocks(found, "gotestsum", F.lit("test_failure"), F.lit("error"), trimmed(group(head, P.SUM_FAIL, 1)), {"subject": trimmed(group(head, P.SUM_FAIL, 1)), "duration": group(head, P.SUM_FAIL, 2)})
    # A log without a failure section gives its last failing summary.
    failing = F.lit(False)
    for part in P.SUM_FAILING:
        failing = failing | F.col("line").contains(part)
    tally = marked.groupBy("log_id").agg(F.max("fail").alias("any"), F.max(F.when(F.col("done") & failing, F.struct("line_no", "line"))).alias("last"))
    only = tally.where("not any and last is not null").select("log_id", F.col("last.line_no").alias("emit"), F.array("last.line").alias("body"), F.col("last.line").alias("line"))
    return out.unionByName(blocks(only, "gotestsum", F.lit("test_failure"), F.lit("error"), F.col("line"), {"summary_only": F.lit("true")}))
