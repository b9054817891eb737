"""One row per log: what was read, found, emitted and dropped, and the exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exit_code(emitted: Column, dropped: Column, truncated: Column) -> Column:
    """3 if the budget forced drops or cuts, else 1 if nothing was emitted, else 0."""
    return F.when((dropped > 0) | (truncated > 0), 3).when(emitted == 0, 1).otherwise(0)


def forced_drops(summary: DataFrame) -> Column:
    return (summary.events_dropped_budget > 0) | (summary.events_truncated > 0)


def summarise(logs: DataFrame, events: DataFrame, decisions: DataFrame | None = None, estimator: str = "heuristic", passthrough: bool = False) -> DataFrame:
    """``logs(log_id, input_lines, format, envelope)`` and final events -> the summary. Partial sums are made before the exchange.

    With ``passthrough`` a log without events that has bytes to pass on exits with 0.
    """
    seen = events.groupBy("log_id").agg(
        F.count("*").alias("events_emitted"), F.sum(F.greatest(F.col("count") - 1, F.lit(0))).cast("long").alias("events_deduped"), F.sum("frames_collapsed").cast("long").alias("frames_collapsed")
    )
    out = logs.join(seen, "log_id", "left")
    if decisions is None:
        zero = F.lit(0).cast("long")
        out = out.withColumns({"events_dropped_budget": zero, "events_truncated": zero, "estimated_tokens": zero})
    else:
        spent = decisions.groupBy("log_id").agg(
            F.count(F.when(F.col("decision") == "drop", 1)).alias("events_dropped_budget"), F.count(F.when(F.col("decision") == "cut", 1)).alias("events_truncated"), F.sum("tokens").alias("estimated_tokens")
        )
        out = out.join(spent, "log_id", "left")
    names = ("events_emitted", "events_deduped", "frames_collapsed", "events_dropped_budget", "events_truncated", "estimated_tokens")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    code = exit_code(F.col("events_emitted"), F.col("events_dropped_budget"), F.col("events_truncated"))
    if passthrough:
        code = F.when((code == 1) & (F.col("input_lines") > 0), 0).otherwise(code)
    return out.withColumns({"events_found": F.col("events_emitted") + F.col("events_dropped_budget"), "output_lines": F.lit(0).cast("long"), "estimator": F.lit(estimator), "exit_code": code}).select(
        "log_id", "format", "envelope", "input_lines", "output_lines", "events_found", "events_emitted", "events_deduped", "events_dropped_budget", "events_truncated", "frames_collapsed", "estimated_tokens", "estimator", "exit_code"
    )
