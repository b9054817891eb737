"""Window helpers of the parsers. All windows are by log and line, so one exchange and one sort serve a whole parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_line(*keys: str) -> WindowSpec:
    return Window.partitionBy("log_id", *keys).orderBy("line_no")


def so_far(*keys: str) -> WindowSpec:
    return by_line(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(*keys: str) -> WindowSpec:
    return by_line(*keys).rowsBetween(Window.unboundedPreceding, -1)


def running(condition: Column, window: WindowSpec | None = None) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(window or so_far())


def ever(condition: Column, window: WindowSpec | None = None) -> Column:
    return F.coalesce(F.max(F.when(condition, 1).otherwise(0)).over(window or so_far()), F.lit(0)) == 1


def bodies(lines: DataFrame, *keys: str, **firsts: str) -> DataFrame:
    """Lines of each island in order: keys, ``emit`` (the first line's number), ``body``, and the first line's values of the named columns."""
    got = [F.min_by(c, "line_no").alias(n) for n, c in firsts.items()]
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("log_id", *keys).agg(F.min("line_no").alias("emit"), body.alias("body"), *got)


def blocks(df: DataFrame, fmt: str, kind: Column, severity: Column, header: Column, attrs: dict[str, Column] | None = None, context: Column | None = None) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (attrs or {}).items())) if attrs else None
    none = F.lit(None).cast("map<string,string>")
    meta = none if entries is None else F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"] != "", F.lit(False))))
    return df.select(
        "log_id", "emit", F.lit(1).alias("rank"), F.lit(fmt).alias("format"), kind.alias("kind"), severity.alias("severity"), header.alias("header"), "body",
        (F.array().cast("array<string>") if context is None else context).alias("context"), meta.alias("attrs"),
    )
