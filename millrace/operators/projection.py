"""From blocks to events: titles, locations, frames and metadata, by column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import as_int, group, left_trimmed, matches, right_trimmed, strip_ansi, trimmed
from ..schema import EVENT_COLUMNS, FRAME, LOCATION


def _body() -> Column:
    return F.col("body")


def _no_frames() -> Column:
    return F.lit(None).cast(f"array<{FRAME}>")


def _no_place() -> Column:
    return F.lit(None).cast(LOCATION)


def _place(file: Column, line: Column, column: Column | None = None) -> Column:
    return F.struct(file.alias("file"), as_int(line).alias("line"), (F.lit(None).cast("int") if column is None else as_int(column)).alias("column")).cast(LOCATION)


def _frame(file: Column, line: Column, function: Column) -> Column:
    return F.struct(file.alias("file"), as_int(line).alias("line"), function.alias("function"), F.lit(False).alias("vendor")).cast(FRAME)


def _first(body: Column, pattern: str, prepare=lambda x: x) -> Column:
    """The first line, prepared, that matches; null if none."""
    return F.try_element_at(F.filter(F.transform(body, prepare), lambda x: matches(x, pattern)), F.lit(1))


def _some(frames: Column) -> Column:
    return F.filter(frames, lambda f: f.isNotNull())


def _meta(**parts: Column) -> Column:
    """A map of the parts that are there and not empty, by key."""
    if not parts:
        return F.lit(None).cast("map<string,string>")
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(parts.items())))
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"] != "", F.lit(False))))


def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def _go_frames(tail: str, name_of) -> Column:
    """Frames of goroutine dumps: a place, and the call on the line before it."""

    def at(line: Column, i: Column) -> Column:
        call = F.when(i > 0, name_of(trimmed(F.get(_body(), i - 1)))).otherwise("")
        return F.when(matches(line, tail) & (as_int(group(line, tail, 2)) > 0), _frame(group(line, tail, 1), group(line, tail, 2), call))

    return _some(F.transform(_body(), at))


def generic(blocks: DataFrame) -> DataFrame:
    plain = strip_ansi(F.col("header"))
    last = F.element_at(F.filter(_body(), lambda x: (trimmed(x) != "") & (x != P.GENERIC_BLOCK_CUT)), -1)
    last = F.when(F.exists(_body(), lambda x: (trimmed(x) != "") & (x != P.GENERIC_BLOCK_CUT)), last)
    title = F.when(F.col("kind") == "traceback", F.coalesce(right_trimmed(strip_ansi(last)), right_trimmed(plain))).otherwise(right_trimmed(plain))
    at = P.GENERIC_LOCATION
    place = F.when(as_int(group(plain, at, 2)).isNotNull(), _place(group(plain, at, 1), group(plain, at, 2), group(plain, at, 3)))

    def frame(x: Column) -> Column:
        py, jvm = P.PYTHON_FRAME, P.JVM_FRAME
        return F.when(matches(x, py), F.when(as_int(group(x, py, 2)) > 0, _frame(group(x, py, 1), group(x, py, 2), group(x, py, 3)))).when(
            matches(x, jvm) & (as_int(group(x, jvm, 3)) > 0), _frame(group(x, jvm, 2), group(x, jvm, 3), group(x, jvm, 1))
        )

    before_call = lambda s: F.when(F.instr(s, "(") > 1, F.substring_index(s, "(", 1)).otherwise(s)
    frames = F.when(F.col("kind") == "traceback", _some(F.transform(_body(), frame))).when(F.col("kind") == "panic", _go_frames(P.GO_TAIL, before_call)).otherwise(_no_frames())
    return blocks.withColumns({"title": title, "location": place, "frames": frames, "metadata": _meta()})


def gotest(blocks: DataFrame) -> DataFrame:
    kind, err, claim = F.col("kind"), P.GO_BUILD_ERROR, P.GO_ASSERTION
    head = F.col("header")

    def called(s: Column) -> Column:
        s = F.regexp_replace(s, "^created by ", "")
        return F.when(matches(s, P.GO_CALL), group(s, P.GO_CALL, 1)).otherwise(s)

    frames = F.when(kind.isin("panic", "race_condition"), _go_frames(P.GO_TEST_TAIL, called)).otherwise(_no_frames())
    said = F.try_element_at(F.filter(F.transform(_body(), left_trimmed), lambda x: matches(x, claim) & as_int(group(x, claim, 2)).isNotNull()), F.lit(1))
    message = trimmed(group(said, claim, 3))
    title = (
        F.when(kind == "build_failure", trimmed(group(head, err, 4)))
        .when(kind == "test_failure", F.when(said.isNotNull(), F.when(message != "", message).otherwise(said)).otherwise(trimmed(head)))
        .otherwise(trimmed(head))
    )
    out = blocks.withColumns({"frames": frames, "title": title})

    def own(f: Column) -> Column:
        vendor = F.lit(False)
        for part in P.GO_OWN_VENDOR_FILES:
            vendor = vendor | f["file"].contains(part)
        for part in P.GO_OWN_VENDOR_FUNCTIONS:
            vendor = vendor | f["function"].startswith(part)
        return ~vendor

    user = F.try_element_at(F.filter("frames", own), F.lit(1))
    column = F.when(as_int(group(head, err, 3)) > 0, group(head, err, 3))
    place = (
        F.when(kind == "build_failure", _place(group(head, err, 1), group(head, err, 2), column))
        .when((kind == "test_failure") & said.isNotNull(), _place(group(said, claim, 1), group(said, claim, 2)))
        .when((kind == "panic") & user.isNotNull(), _place(user["file"], user["line"].cast("string")))
    )
    body = F.when(kind == "build_failure", F.array(F.concat(F.array_join(F.array(*(F.when(F.lit(k) == 1, group(head, err, 1)).otherwise(as_int(group(head, err, k)).cast("string")) for k in (1, 2, 3))), ":"), F.lit(": "), F.col("title")))).otherwise(_body())
    names = ("test_id", "package", "duration", "panic_truncated", "race_goroutines", "race_truncated")
    return out.withColumns({"location": place, "metadata": _meta(**{n: _attr(n) for n in names})}).withColumn("body", body)


def gotestsum(blocks: DataFrame) -> DataFrame:
    at, subject = P.SUM_LOCATION, F.col("header")
    only = F.coalesce(_attr("summary_only") == "true", F.lit(False))
    line = F.try_element_at(F.filter(F.slice(_body(), 2, F.greatest(F.size(_body()), F.lit(1))), lambda x: trimmed(x) != ""), F.lit(1))
    found = matches(line, at)
    title = F.when(only | line.isNull(), subject).when(found, group(line, at, 4)).otherwise(trimmed(line))
    place = F.when(~only & found, _place(group(line, at, 1), group(line, at, 2), group(line, at, 3)))
    fields = F.filter(F.split(subject, r"[\t\n\x0B\f\r \x{0085}\p{Z}]+"), lambda x: x != "")
    dotted = matches(subject, r"^.+\.[^./]+$")
    package = F.when(F.size(fields) >= 2, F.get(fields, F.lit(0))).when(dotted, group(subject, r"^(.+)\.[^./]+$", 1)).otherwise(subject)
    test = F.when(F.size(fields) >= 2, F.get(fields, F.lit(1))).when(dotted, group(subject, r"\.([^./]+)$", 1)).otherwise("")
    out = blocks.withColumns({"title": title, "location": place, "frames": _no_frames(), "package": package, "test": test})
    build = ~only & (F.col("test") == "") & (F.col("title").startswith(P.SUM_FLAG) | F.col("title").contains(P.SUM_BUILD))
    meta = F.when(only, _meta(summary_only=F.lit("true"))).otherwise(_meta(subject=subject, package=F.col("package"), test_id=F.col("test"), duration=_attr("duration")))
    return out.withColumns({"kind": F.when(build, "build_failure").otherwise(F.col("kind")), "metadata": meta})


def pytest(blocks: DataFrame) -> DataFrame:
    kind, name = F.col("kind"), F.col("header")
    warn = kind == "warning"
    claim = _first(_body(), P.PY_ASSERTION)
    classed = _first(_body(), P.PY_WARNING_CLASS)
    second = F.when(F.size(_body()) > 1, trimmed(F.get(_body(), F.lit(1))))
    warned = F.coalesce(
        F.concat(group(classed, P.PY_WARNING_CLASS, 1), F.lit(": "), group(classed, P.PY_WARNING_CLASS, 2)), F.when(second != "", second), trimmed(F.get(_body(), F.lit(0)))
    )
    title = F.when(warn, warned).otherwise(F.coalesce(trimmed(group(claim, P.PY_ASSERTION, 1)), F.when(name != "", name), trimmed(F.get(_body(), F.lit(0)))))
    places = F.filter(_body(), lambda x: matches(x, P.PY_LOCATION) & as_int(group(x, P.PY_LOCATION, 2)).isNotNull())
    last = F.try_element_at(places, F.lit(-1))
    collecting = group(name, P.PY_COLLECTING, 1)
    entry = F.get(_body(), F.lit(0))
    place = (
        F.when(warn, F.when(as_int(group(entry, P.PY_ENTRY, 2)) > 0, _place(group(entry, P.PY_ENTRY, 1), group(entry, P.PY_ENTRY, 2))))
        .when(last.isNotNull(), _place(group(last, P.PY_LOCATION, 1), group(last, P.PY_LOCATION, 2)))
        .when((kind == "collection_error") & (collecting != ""), _place(collecting, F.lit("0")))
    )

    def frame(x: Column) -> Column:
        short, long, s = P.PY_SHORT_FRAME, P.PY_LONG_FRAME, left_trimmed(x)
        return F.when(matches(s, short), _frame(group(s, short, 1), group(s, short, 2), group(s, short, 3))).when(matches(x, long), _frame(group(x, long, 1), group(x, long, 2), group(x, long, 3)))

    frames = F.when(~warn, F.filter(F.transform(_body(), frame), lambda f: f.isNotNull() & f["line"].isNotNull()))
    meta = _meta(test_id=F.when(kind.isin("test_failure", "test_error"), name))
    return blocks.withColumns({"title": title, "location": place, "frames": frames, "metadata": meta})


def jest(blocks: DataFrame) -> DataFrame:
    name, suite = F.col("header"), F.coalesce(_attr("suite_file"), F.lit(""))
    plain = F.transform(_body(), strip_ansi)
    shot = F.try_element_at(F.filter(plain, lambda x: matches(x, P.JEST_SNAPSHOT) | matches(x, P.JEST_INLINE)), F.lit(1))
    filed = F.coalesce(matches(shot, P.JEST_SNAPSHOT), F.lit(False))
    of_suite = (name == P.JEST_SUITE) | ((suite != "") & (name == suite))
    kind = F.when(of_suite, "suite_error").when(shot.isNotNull(), "snapshot_mismatch").otherwise("test_failure")
    named = F.when(filed, trimmed(group(_first(plain, P.JEST_SNAPSHOT_NAME), P.JEST_SNAPSHOT_NAME, 1)))
    said = F.coalesce(
        trimmed(group(_first(plain, P.JEST_EXPECT), P.JEST_EXPECT, 1)),
        F.concat(F.lit("Expected: "), trimmed(group(_first(plain, P.JEST_EXPECTED), P.JEST_EXPECTED, 1))),
        trimmed(group(_first(plain, P.JEST_ERROR), P.JEST_ERROR, 1)),
        strip_ansi(trimmed(name)),
    )
    snapshot = F.when(F.coalesce(named, F.lit("")) != "", F.concat(F.lit("Snapshot mismatch: "), named)).otherwise("Snapshot mismatch")
    title = F.when(kind == "snapshot_mismatch", snapshot).otherwise(said)
    full, bare = P.JEST_FRAME, P.JEST_BARE_FRAME

    def frame(x: Column) -> Column:
        return F.when(matches(x, full), _frame(group(x, full, 2), group(x, full, 3), group(x, full, 1))).when(matches(x, bare), _frame(group(x, bare, 1), group(x, bare, 2), F.lit("")))

    at = F.try_element_at(F.filter(_body(), lambda x: matches(x, full) | matches(x, bare)), F.lit(1))
    place = F.when(matches(at, full), _place(group(at, full, 2), group(at, full, 3), group(at, full, 4))).when(at.isNotNull(), _place(group(at, bare, 1), group(at, bare, 2), group(at, bare, 3)))
    long = (F.when(shot.isNotNull(), F.size(_body())).otherwise(0) > P.JEST_SNAPSHOT_LINES)
    body = F.when(long, F.concat(F.slice(_body(), 1, P.JEST_SNAPSHOT_LINES - 1), F.array(F.lit(P.JEST_SNAPSHOT_CUT)))).otherwise(_body())
    meta = _meta(
        test_id=F.when(~of_suite, F.replace(name, F.lit("›"), F.lit(">"))), suite_file=suite,
        snapshot_kind=F.when(filed, "file").when(shot.isNotNull(), "inline"), snapshot_truncated=F.when(long, "true"),
    )
    return blocks.withColumns({"title": title, "location": place, "frames": _some(F.transform(_body(), frame)), "metadata": meta, "new_kind": kind, "new_body": body}).drop("kind", "body").withColumnsRenamed({"new_kind": "kind", "new_body": "body"})


def custom(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"title": strip_ansi(F.col("header")), "location": _no_place(), "frames": _no_frames(), "metadata": F.col("attrs")})


def envelope(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"title": F.col("header"), "location": _no_place(), "frames": _no_frames(), "metadata": F.col("attrs")})


PROJECTIONS = {"generic": generic, "gotest": gotest, "gotestsum": gotestsum, "pytest": pytest, "jest": jest, "envelope": envelope}


def events_of(blocks: DataFrame, fmt: str, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Blocks of one format -> events, still with ``emit`` and ``rank`` instead of ``seq``."""
    out = (project or PROJECTIONS.get(fmt, custom))(blocks)
    return out.select(
        "log_id", "emit", "rank", "severity", "kind", F.coalesce("title", F.lit("")).alias("title"), F.col("location").cast(LOCATION).alias("location"), "body", "context",
        F.coalesce(F.col("frames").cast(f"array<{FRAME}>"), F.array().cast(f"array<{FRAME}>")).alias("frames"), F.lit(0).alias("frames_collapsed"), F.lit(0).alias("count"), F.lit(False).alias("truncated"), "metadata",
    )


def numbered(events: DataFrame) -> DataFrame:
    """``emit`` and ``rank`` become ``seq``, from 1 within each log."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("log_id").orderBy("emit", "rank")).cast("long")).select(*EVENT_COLUMNS)
