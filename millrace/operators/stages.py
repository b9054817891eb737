"""Operators on events: collapsing frames, deduplication, the token budget, the event cap."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import estimate, severity_rank
from ..schema import EVENT_COLUMNS, FRAME


def _any(text: Column, found: list[str]) -> Column:
    return (text != "") & text.rlike(P.java("|".join(f"(?:{p})" for p in found)))


def is_vendor(frame: Column) -> Column:
    return _any(F.coalesce(frame["file"], F.lit("")), P.VENDOR_FILES) | _any(F.coalesce(frame["function"], F.lit("")), P.VENDOR_FUNCTIONS)


def collapse_frames(events: DataFrame, keep_vendor: bool = False) -> DataFrame:
    """Classifies frames; drops those of vendor code and counts them, or keeps them all."""
    classed = F.transform("frames", lambda f: f.withField("vendor", is_vendor(f))).cast(f"array<{FRAME}>")
    out = events.withColumn("frames", classed)
    if keep_vendor:
        return out
    own = F.filter("frames", lambda f: ~f["vendor"])
    return out.withColumns({"frames_collapsed": (F.size("frames") - F.size(own)).cast("int"), "frames": own})


def signature() -> Column:
    """What makes two events the same: title, and file and line where there is a location."""
    return F.struct(F.col("title"), F.col("location").isNotNull().alias("placed"), F.col("location.file").alias("file"), F.col("location.line").alias("line"))


def dedupe(events: DataFrame, window: int = 0) -> DataFrame:
    """The first of equal events stays with their number, in order of arrival.

    Without a window every event counts 1. An event leaves the window, and is no longer compared, when ``window`` newer
    ones have entered; being met again doesn't keep it longer. Logs with no more distinct events than the window are
    deduplicated by aggregation, only others by a fold over their signatures.
    """
    if window <= 0:
        return events.withColumn("count", F.lit(1))
    keyed = events.select("log_id", "seq", signature().alias("sig"))
    groups = keyed.groupBy("log_id", "sig").agg(F.min("seq").alias("seq"), F.count("*").cast("int").alias("count"))
    sizes = groups.groupBy("log_id").agg(F.count("*").alias("kinds"))
    large = sizes.where(F.col("kinds") > window).select("log_id")
    small = groups.join(large, "log_id", "left_anti").select("log_id", "seq", "count")

    def run(key, batch):
        held, rows = OrderedDict(), []
        for seq, sig in zip(*(batch.sort_by("seq").column(c).to_pylist() for c in ("seq", "sig"))):
            sig = tuple(sig.values())
            if sig in held:
                held[sig][1] += 1
                continue
            held[sig] = [seq, 1]
            rows.append(held[sig])
            if len(held) > window:
                held.popitem(last=False)
        return pa.table({"log_id": [key[0].as_py()] * len(rows), "seq": pa.array([r[0] for r in rows], pa.int64()), "count": pa.array([r[1] for r in rows], pa.int32())})

    folded = keyed.join(large, "log_id", "left_semi").groupBy("log_id").applyInArrow(run, "log_id string, seq long, count int")
    kept = small.unionByName(folded)
    return events.drop("count").join(kept, ["log_id", "seq"]).select(*EVENT_COLUMNS)


def _total(lines: Column) -> Column:
    return F.aggregate(F.coalesce(lines, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda t, x: t + estimate(x))


#: Tokens of an array of texts, each rounded by itself.
Estimator = Callable[[Column], Column]


def _texts(*arrays: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.array(F.coalesce("title", F.lit("")), F.coalesce("location.file", F.lit(""))), *(F.coalesce(a, none) for a in arrays))


def cost(total: Estimator = _total) -> Column:
    """Tokens of an event: title, file, body, context and frames, each text rounded by itself; metadata is free."""
    frames = F.flatten(F.transform("frames", lambda f: F.array(F.coalesce(f["file"], F.lit("")), F.coalesce(f["function"], F.lit("")))))
    return total(_texts(F.col("body"), F.col("context"), frames))


def shortened() -> Column:
    """Body of an event cut to fit: its first line and a note."""
    note = F.array(F.lit(P.BUDGET_CUT))
    return F.when(F.size("body") > 0, F.concat(F.slice("body", 1, 1), note)).otherwise(note)


def decide(events: DataFrame, budget: int, reserve: int = P.BUDGET_RESERVE, total: Estimator = _total) -> DataFrame:
    """``log_id, seq, place, decision, tokens`` per event: ``keep``, ``cut`` or ``drop``.

    Events are taken in order of severity, then arrival, while tokens are left; one that doesn't fit is cut if that fits,
    else dropped, and smaller ones after it may still fit. The fold sees three numbers per event.
    """
    priced = events.select("log_id", "seq", severity_rank(F.col("severity")).alias("rank"), cost(total).alias("cost"), total(_texts(shortened())).alias("cut"))
    start = budget - (reserve if reserve > 0 else P.BUDGET_RESERVE)

    def run(key, batch):
        left, out = start, []
        for seq, whole, cut in zip(*(batch.sort_by([("rank", "descending"), ("seq", "ascending")]).column(c).to_pylist() for c in ("seq", "cost", "cut"))):
            took, word = (0, "drop") if left <= 0 else (whole, "keep") if whole <= left else (cut, "cut") if cut <= left else (0, "drop")
            left -= took
            out.append((seq, word, took))
        kinds = (pa.int64(), pa.string(), pa.int64())
        seq, word, took = (pa.array(x, k) for x, k in zip(zip(*out), kinds))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), seq, pa.array(range(1, len(out) + 1), pa.int64()), word, took], names=["log_id", "seq", "place", "decision", "tokens"])

    return priced.groupBy("log_id").applyInArrow(run, "log_id string, seq long, place long, decision string, tokens long")


def apply_budget(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """What the budget leaves, renumbered in its order."""
    cut = F.col("decision") == "cut"
    out = events.join(decisions, ["log_id", "seq"]).where("decision <> 'drop'")
    out = out.withColumns({
        "body": F.when(cut, shortened()).otherwise(F.col("body")), "context": F.when(cut, F.array().cast("array<string>")).otherwise(F.col("context")),
        "frames": F.when(cut, F.array().cast(f"array<{FRAME}>")).otherwise(F.col("frames")), "frames_collapsed": F.when(cut, 0).otherwise(F.col("frames_collapsed")),
        "truncated": F.col("truncated") | cut, "seq": F.row_number().over(Window.partitionBy("log_id").orderBy("place")).cast("long"),
    })
    return out.select(*EVENT_COLUMNS)


def budget(events: DataFrame, tokens: int, reserve: int = P.BUDGET_RESERVE, total: Estimator = _total) -> DataFrame:
    return events if tokens <= 0 else apply_budget(events, decide(events, tokens, reserve, total))


def max_events(events: DataFrame, limit: int) -> DataFrame:
    """The first events of each log; none are cut if the limit is 0."""
    if limit <= 0:
        return events
    return events.withColumn("r", F.row_number().over(Window.partitionBy("log_id").orderBy("seq"))).where(F.col("r") <= limit).drop("r")


def renumbered(events: DataFrame) -> DataFrame:
    """``seq`` without gaps, in the same order."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("log_id").orderBy("seq")).cast("long"))


def passthrough(events: DataFrame) -> DataFrame:
    return events
