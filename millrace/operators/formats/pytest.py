"""pytest: sections by banner, blocks by underlined name, warnings by entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import patterns as P
from ...functions.text import group, matches, trimmed
from ...streaming.folds import RANK
from .segments import before, blocks, bodies, ever, running, so_far

def parse(lines: DataFrame, least: str = "error") -> DataFrame:
    line, inside = F.col("line"), so_far("section")
    control = (
        F.when(matches(line, P.PY_SUMMARY) | matches(line, P.PY_RESULT), "summary")
        .when(matches(line, P.PY_FAILURES), "failures").when(matches(line, P.PY_ERRORS), "errors").when(matches(line, P.PY_WARNINGS), "warnings")
    )
    bare = trimmed(line)
    entry = ~F.substring(line, 1, 1).isin(" ", "\t") & matches(line, P.PY_ENTRY)
    banner = bare.startswith("==") & bare.endswith("==") & (F.regexp_replace(bare, "^[= ]+|[= ]+$", "") != "")
    marked = lines.withColumns({"control": control, "entry": entry, "banner": banner, "under": matches(line, P.PY_UNDERLINE)})
    # A warnings banner within an open warnings section is dropped without closing the entry before it.
    mark = F.coalesce("control", F.when(F.col("banner") & ~F.col("entry"), "banner"))
    again = (F.col("control") == "warnings") & (F.last(mark, ignorenulls=True).over(before()) == "warnings")
    marked = marked.withColumn("again", F.coalesce(again, F.lit(False)))
    marked = marked.withColumns({"section": running(F.col("control").isNotNull() & ~F.col("again")), "failed": ever(F.col("control") == "failures", before())}).where("section > 0 and not again")
    typed = marked.withColumns({"type": F.first("control").over(inside), "seen": F.first("failed").over(inside)}).where("type <> 'summary' and control is null")

    named = typed.where("type in ('failures', 'errors')").withColumn("block", running(F.col("under"), inside)).where("block > 0")
    named = named.withColumn("over", ever(F.col("banner") & ~F.col("under"), inside)).where("not over")
    found = bodies(named, "section", "block", line="line", type="type", seen="seen")
    name = trimmed(group(F.col("line"), P.PY_UNDERLINE, 1))
    kind = F.when(matches(name, P.PY_COLLECTING), "collection_error").when(F.col("type") == "failures", "test_failure").when(F.col("seen"), "test_error").otherwise("collection_error")
    out = blocks(found, "pytest", kind, F.lit("error"), name)
    if RANK["warn"] < RANK.get(least, 0):
        return out
    listed = typed.where("type = 'warnings'").withColumn("over", ever(F.col("banner") & ~F.col("entry"), inside)).where("not over")
    listed = listed.withColumn("block", running(F.col("entry"), inside)).where("block > 0")
    return out.unionByName(blocks(bodies(listed, "section", "block", line="line"), "pytest", F.lit("warning"), F.lit("warn"), F.col("line")))
