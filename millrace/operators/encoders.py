"""Rendering events: text, Markdown, JSON, newline-delimited JSON, and the explanation of what was kept and dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_label

SCHEMA_VERSION = 1


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def _place() -> Column:
    return F.concat(F.col("location.file"), F.lit(":"), F.col("location.line").cast("string"))


def _lines(array: Column, indent: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat(F.lit(indent), x, F.lit("\n"))), "")


def _if(condition: Column, text: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), text).otherwise("")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def event_text() -> Column:
    has_context = F.size("context") > 0
    return _cat(
        "[", F.col("seq").cast("string"), "] ", severity_label(F.col("severity")), " ", F.col("title"), "\n",
        _if(F.col("location").isNotNull(), _cat("  at ", _place(), "\n")), _lines(F.col("body"), "  "), _if(has_context, _cat("  context:\n", _lines(F.col("context"), "    "))),
        _if(F.col("frames_collapsed") > 0, _cat("  ... ", F.col("frames_collapsed").cast("string"), " vendor frames collapsed\n")),
        _if(F.col("count") > 1, _cat("  (×", F.col("count").cast("string"), ")\n")), _if(F.col("truncated"), F.lit("  [truncated by --budget]\n")), "\n",
    )


def event_markdown(fence: str = "") -> Column:
    def fenced(lines: Column) -> Column:
        return _cat(f"```{fence}\n", _lines(lines, ""), "```\n\n")

    place, several, frames, cut = F.col("location").isNotNull(), F.col("count") > 1, F.col("frames_collapsed") > 0, F.col("truncated")
    return _cat(
        "### [", F.col("seq").cast("string"), "] ", severity_label(F.col("severity")), " ", F.col("title"), "\n\n",
        _if(place, _cat("- **Location:** `", _place(), "`\n")), _if(several, _cat("- **Count:** ×", F.col("count").cast("string"), "\n")),
        _if(frames, _cat("- **Vendor frames collapsed:** ", F.col("frames_collapsed").cast("string"), "\n")), _if(cut, F.lit("- **Truncated by --budget**\n")), _if(place | several | frames | cut, F.lit("\n")),
        _if(F.size("body") > 0, fenced(F.col("body"))), _if(F.size("context") > 0, _cat("**Context:**\n\n", fenced(F.col("context")))),
    )


def _joined(events: DataFrame, part: Column) -> DataFrame:
    """Each log's parts in order, and how many."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("part").alias("part")))), lambda x: x["part"]), "")
    return events.select("log_id", "seq", part.alias("part")).groupBy("log_id").agg(ordered.alias("parts"))


def _ends(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _shown() -> Column:
    """Lines of output before the footer; what stands in for missing events isn't counted."""
    return F.when(F.col("parts").isNull(), F.lit(0)).otherwise(_ends(F.col("body")))


def text(events: DataFrame, summary: DataFrame, footer: bool = True) -> DataFrame:
    """``log_id, text``, one row per log in ``summary``."""
    body = F.when(F.col("parts").isNull(), F.lit("no events found\n")).otherwise(_cat("events from ", F.col("format"), "\n\n", F.col("parts")))
    out = summary.join(_joined(events, event_text()), "log_id", "left").withColumn("body", body)
    shown = F.when(F.col("input_lines") > 0, count_text(F.col("input_lines"))).otherwise("?")
    end = _cat(
        "---\ndistilled ", shown, " lines → ", count_text(_shown()), " lines (", count_text(F.col("estimated_tokens")), " tokens, ", F.col("estimator"), ")\ndropped: ",
        count_text(F.col("events_dropped_budget")), " events, ", count_text(F.col("events_truncated")), " truncated, ", count_text(F.col("events_deduped")), " deduped, ", count_text(F.col("frames_collapsed")), " vendor frames\n",
    )
    return out.select("log_id", (F.concat("body", end) if footer else F.col("body")).alias("text"))


def markdown(events: DataFrame, summary: DataFrame, footer: bool = True, fence: str = "") -> DataFrame:
    body = F.when(F.col("parts").isNull(), F.lit("_no events found_\n")).otherwise(_cat("# events from ", F.col("format"), "\n\n", F.col("parts")))
    out = summary.join(_joined(events, event_markdown(fence)), "log_id", "left").withColumn("body", body)
    shown = F.when(F.col("input_lines") > 0, count_text(F.col("input_lines"))).otherwise("?")
    end = _cat(
        "---\n\n- **Lines distilled:** ", shown, " → ", count_text(_shown()), "\n- **Events emitted:** ", count_text(F.col("events_emitted")), "\n- **Events dropped:** ", count_text(F.col("events_dropped_budget")),
        "\n- **Events truncated:** ", count_text(F.col("events_truncated")), "\n- **Events deduped:** ", count_text(F.col("events_deduped")), "\n- **Vendor frames removed:** ", count_text(F.col("frames_collapsed")),
        "\n- **Estimated tokens:** ", count_text(F.col("estimated_tokens")), " (", F.col("estimator"), ")\n",
    )
    return out.select("log_id", (F.concat("body", end) if footer else F.col("body")).alias("text"))


def _quoted(value: Column) -> Column:
    """A JSON string; markup characters aren't escaped."""
    inside = F.to_json(F.array(value))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _array(parts: Column, pad: str | None = None) -> Column:
    """A JSON array; with ``pad`` one element a line, two blanks beyond ``pad``."""
    if pad is None:
        return _cat("[", F.array_join(parts, ","), "]")
    inner = f"\n{pad}  "
    return F.when(F.size(parts) == 0, F.lit("[]")).otherwise(_cat("[", inner, F.array_join(parts, f",{inner}"), f"\n{pad}]"))


def _object(fields: list[tuple[str, Column] | tuple[str, Column, Column]], pad: str | None = None) -> Column:
    """A JSON object of ``(name, value)`` or ``(name, value, whether it is there)``."""
    colon = ":" if pad is None else ": "
    each = [F.when(f[2] if len(f) > 2 else F.lit(True), _cat(f'"{f[0]}"{colon}', f[1])) for f in fields]
    return _braces(F.filter(F.array(*each), lambda x: x.isNotNull()), pad)


def _braces(parts: Column, pad: str | None) -> Column:
    if pad is None:
        return _cat("{", F.array_join(parts, ","), "}")
    inner = f"\n{pad}  "
    return _cat("{", inner, F.array_join(parts, f",{inner}"), f"\n{pad}}}")


def event_json(pad: str | None = None) -> Column:
    """An event as a JSON object, compact or indented; location is null where there is none, empty context, frames and metadata are left out."""
    deep = None if pad is None else pad + "  "
    deeper = None if pad is None else pad + "    "
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    at = F.col("location")
    place = F.when(at.isNull(), F.lit("null")).otherwise(_object([("file", _quoted(at["file"])), ("line", number(at["line"])), ("column", number(at["column"]))], deep))
    frames = F.transform("frames", lambda f: _object([
        ("file", _quoted(f["file"])), ("line", number(f["line"])), ("function", _quoted(f["function"]), F.coalesce(f["function"], F.lit("")) != ""), ("vendor", f["vendor"].cast("string"))
    ], deeper))
    colon = ":" if pad is None else ": "
    meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: _cat(_quoted(e["key"]), colon, _quoted(e["value"])))
    return _object([
        ("severity", _quoted(F.col("severity"))), ("kind", _quoted(F.col("kind"))), ("title", _quoted(F.col("title"))), ("location", place), ("body", _array(F.transform("body", _quoted), deep)),
        ("context", _array(F.transform("context", _quoted), deep), F.size("context") > 0), ("frames", _array(frames, deep), F.size("frames") > 0),
        ("frames_collapsed", number(F.col("frames_collapsed"))), ("count", number(F.col("count"))), ("truncated", F.col("truncated").cast("string")),
        ("metadata", _braces(meta, deep), F.size(F.coalesce(F.map_keys("metadata"), F.array())) > 0),
    ], pad)


SUMMARY_FIELDS = ("input_lines", "output_lines", "events_found", "events_emitted", "events_deduped", "events_dropped_budget", "events_truncated", "frames_collapsed", "estimated_tokens", "estimator", "exit_code")


def summary_json(output_lines: Column, pad: str | None = None) -> Column:
    return _object([(n, output_lines if n == "output_lines" else _quoted(F.col(n)) if n == "estimator" else F.col(n).cast("string")) for n in SUMMARY_FIELDS], pad)


def _head(fmt: Column) -> Column:
    return _cat(f'{{"schema_version":{SCHEMA_VERSION},"format":', _quoted(fmt))


def json_batch(events: DataFrame, summary: DataFrame) -> DataFrame:
    """One indented object per log with all its events and its summary, whose ``output_lines`` is 0."""
    each = events.select("log_id", "seq", event_json("    ").alias("e"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"])
    out = summary.join(each.groupBy("log_id").agg(ordered.alias("es")), "log_id", "left")
    listed = _array(F.coalesce("es", F.array().cast("array<string>")), "  ")
    whole = _object([("schema_version", F.lit(str(SCHEMA_VERSION))), ("format", _quoted(F.col("format"))), ("events", listed), ("summary", summary_json(F.lit("0"), "  "))], "")
    return out.select("log_id", F.concat(whole, F.lit("\n")).alias("text"))


def ndjson(events: DataFrame, summary: DataFrame) -> DataFrame:
    """``log_id, seq, line``: a line per event, then one with the summary, which counts the lines before it."""
    lines = events.join(summary.select("log_id", "format"), "log_id").select("log_id", "seq", _cat(_head(F.col("format")), ',"event":', event_json(), "}").alias("line"))
    last = summary.select("log_id", (F.col("events_emitted") + 1).alias("seq"), _cat(_head(F.col("format")), ',"summary":', summary_json(F.col("events_emitted")), "}").alias("line"))
    return lines.unionByName(last)


def _where() -> Column:
    return _if(F.col("location").isNotNull(), _cat(" at ", _place()))


def explain(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """``log_id, seq, line``: kept events in order, then the dropped and cut ones of ``dropped(log_id, place, reason, severity, title, location)``."""
    line = _cat(
        "kept   ", severity_label(F.col("severity")), " ", F.col("title"), _where(), _if(F.col("count") > 1, _cat(" <dedupe-evicted=", (F.col("count") - 1).cast("string"), ">")),
        _if(F.col("frames_collapsed") > 0, _cat(" <vendor-collapsed=", F.col("frames_collapsed").cast("string"), ">")), _if(F.col("truncated"), F.lit(" <truncated>")),
    )
    gone = _cat("dropped:", F.col("reason"), " ", severity_label(F.col("severity")), " ", F.col("title"), _where())
    first = kept.select("log_id", F.lit(0).alias("part"), "seq", line.alias("line"))
    return first.unionByName(dropped.select("log_id", F.lit(1).alias("part"), F.col("place").alias("seq"), gone.alias("line")))
