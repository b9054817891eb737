"""CI and orchestrator wrappers around logs: detection, cleaning and the signals they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import group, matches, trimmed
from ..schema import BLOCKS
from ..sources.logs import prefix, samples
from ..sources.scratch import written
from .detection import ranked
from .folding import block_rows, table
from .formats.segments import ever

NAMES = ["docker-compose", "github-actions", "gitlab-ci"]


class EnvelopeError(ValueError):
    """An unknown envelope was named."""


def _without(line: Column, pattern: str) -> Column:
    return F.regexp_replace(line, P.java(pattern), "")


def scores(sample: Column) -> dict[str, Column]:
    lines = F.split(sample, "\n", -1)
    written = F.filter(lines, lambda x: trimmed(x) != "")
    marked = F.exists(lines, lambda x: _starts(_without(x, P.GHA_TIME), P.GHA_MARKERS))
    stamped = F.size(F.filter(F.slice(written, 1, 10), lambda x: matches(x, P.GHA_TIME)))
    section = F.exists(lines, lambda x: matches(_without(x, P.GITLAB_PREFIX), P.GITLAB_SECTION))
    head = prefix(sample, P.GITLAB_HEAD)
    colours = F.size(F.regexp_extract_all(head, F.lit(P.java(P.ANSI)), F.lit(0)))
    first = F.coalesce(matches(F.try_element_at(written, F.lit(1)), P.COMPOSE_LINE), F.lit(False))
    prefixed = F.size(F.filter(lines, lambda x: matches(x, P.COMPOSE_LINE)))
    return {
        "docker-compose": F.when(first, P.CLEAR).when(prefixed >= P.COMPOSE_LINES, P.FUZZY).otherwise(0.0),
        "github-actions": F.when(marked, P.CLEAR).when(stamped >= 3, P.FUZZY).otherwise(0.0),
        "gitlab-ci": F.when(section, P.CLEAR).when(matches(head, P.GITLAB_BANNER) & (colours >= P.GITLAB_CSI), P.FUZZY).otherwise(0.0),
    }


def _starts(text: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for start in starts:
        out = out | text.startswith(start)
    return out


def best(sample: Column, used: Column) -> Column:
    """Score (less than zero) and name of the best stripper that wasn't used yet."""
    left = {k: F.when(F.array_contains(used, k), 0.0).otherwise(v) for k, v in scores(sample).items()}
    return F.element_at(ranked(left), 1)


def peeled(line: Column, stage: Column) -> Column:
    """A struct of what one stripper makes of a line: ``line``, ``command`` (null for data), ``args``, ``code``, ``hit`` (prefixed by compose)."""
    gha = F.regexp_replace(line, P.java(P.GHA_TIME), "")
    sharp = group(gha, P.GHA_COMMAND, 1)
    word = F.when(matches(gha, P.GHA_COMMAND), F.when(sharp != "", sharp).otherwise(group(gha, P.GHA_COMMAND, 3)))
    said = F.when(sharp != "", group(gha, P.GHA_COMMAND, 2)).otherwise(group(gha, P.GHA_COMMAND, 4))
    lab = _without(F.regexp_replace(line, "\r+$", ""), P.GITLAB_PREFIX)
    section = matches(lab, P.GITLAB_SECTION)
    no = F.lit(None).cast("string")

    def row(text: Column, command: Column = no, args: Column = no, code: Column = no, hit: Column | None = None) -> Column:
        return F.struct(text.alias("line"), command.alias("command"), args.alias("args"), code.alias("code"), (F.lit(True) if hit is None else hit).alias("hit"))

    return (
        F.when(stage == "github-actions", row(gha, F.when(word.isin(P.GHA_DROPPED), word), said, group(trimmed(said), P.GHA_EXIT, 1)))
        .when(stage == "gitlab-ci", row(lab, F.when(section, group(lab, P.GITLAB_SECTION, 1)).when(matches(lab, P.GITLAB_FAILED), "failed"), group(lab, P.GITLAB_SECTION, 3), group(lab, P.GITLAB_FAILED, 1)))
        .when(stage == "docker-compose", row(_without(line, P.COMPOSE_LINE), hit=matches(line, P.COMPOSE_LINE)))
        .otherwise(row(line))
    )


def _cleaned(lines: Column, stage: Column) -> Column:
    """What one stripper leaves of an array of lines."""
    rows = F.transform(lines, lambda x: peeled(x, stage))
    first = F.array_position(F.transform(rows, lambda r: r["hit"]), True)
    on = F.when(stage == "docker-compose", F.when(first > 0, F.slice(rows, first.cast("int"), F.size(rows))).otherwise(F.slice(rows, 1, 0))).otherwise(rows)
    return F.transform(F.filter(on, lambda r: r["command"].isNull()), lambda r: r["line"])


def inner_sizes(sample_bytes: int = P.SAMPLE_BYTES) -> list[int]:
    """Sizes of the samples that an inner round tries one after the other: the first, then steps more, the most at last."""
    return [*range(sample_bytes, P.SAMPLE_MOST, P.SAMPLE_STEP), P.SAMPLE_MOST]


#: Bytes of a log that are read to tell its wrappers, at first.
FIRST_READ = 4 * P.SAMPLE_MOST


def _claimed(text: Column, used: Column, sizes: list[int]) -> Column:
    """The stripper that claims a text by its first bytes: of the sizes, one after the other up to the whole text, the first by which anyone does."""
    own = F.filter(F.array(*(F.struct(F.lit(before).alias("before"), F.lit(size).alias("size")) for before, size in zip([-1, *sizes], sizes))), lambda x: F.octet_length(text) > x["before"])
    sure = F.filter(F.transform(own, lambda x: best(prefix(text, x["size"]), used)), lambda x: -x["s"] >= P.LEAST_CONFIDENCE)
    return F.try_element_at(sure, F.lit(1))["name"]


def chains(lines: DataFrame, sample_bytes: int = P.SAMPLE_BYTES) -> DataFrame:
    """``log_id, chain``: the strippers that claim a log, the outermost first, each at most once.

    The outermost is told from the first ``sample_bytes``; inner ones from up to 256 KiB of what the outer ones leave,
    in growing samples. The first MiB of wrapped logs is read for that, one row per log; logs whose wrappers drop so much
    of it that less than 256 KiB are left are read again, sixteen times as far each time, until there is enough or all is read.
    """
    none = F.array().cast("array<string>")
    first = written(samples(lines, sample_bytes).select("log_id", _claimed(F.col("sample"), none, [sample_bytes]).alias("now")))
    out = first.select("log_id", none.alias("chain")).where("now is null")
    wrapped, read = first.where("now is not null"), FIRST_READ
    while not wrapped.isEmpty():
        head = samples(lines.join(wrapped, "log_id", "left_semi"), read)
        rows = head.join(wrapped, "log_id").select("log_id", F.col("sample").alias("text"), none.alias("chain"), (F.octet_length("sample") >= read).alias("more"), "now")
        short = None
        for _ in NAMES[1:]:
            rows = rows.select("log_id", "more", F.array_join(_cleaned(F.split("text", "\n", -1), F.col("now")), "\n").alias("text"), F.array_append("chain", F.col("now")).alias("chain"))
            sizes = inner_sizes(sample_bytes)
            rows = written(rows.withColumn("now", _claimed(F.col("text"), F.col("chain"), sizes)))
            lacking = F.col("now").isNull() & F.col("more") & (F.octet_length("text") < sizes[-1])
            out = out.unionByName(rows.where(F.col("now").isNull() & ~lacking).select("log_id", "chain"))
            again = rows.where(lacking).select("log_id", F.element_at("chain", 1).alias("now"))
            short = again if short is None else short.unionByName(again)
            rows = rows.where("now is not null")
        out = out.unionByName(rows.select("log_id", F.array_append("chain", F.col("now")).alias("chain")))
        wrapped, read = short, 16 * read
    return out


def strip(lines: DataFrame, envelope: str = "auto", sample_bytes: int = P.SAMPLE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lines`` -> cleaned lines, signal blocks, and ``log_id, envelope`` (names joined by ``+``, or ``none``).

    ``auto`` peels wrappers one after the other; ``none`` peels none; a name peels that one from all logs. Line numbers
    stay those of the input, so that signals and events keep their order.
    """
    lines = lines.select("log_id", "line_no", "line")
    if envelope not in (*NAMES, "auto", "none"):
        raise EnvelopeError(f"unknown envelope {envelope!r}; known: {', '.join(NAMES)}, auto, none")
    if envelope == "auto":
        chain = chains(lines, sample_bytes)
    else:
        chain = lines.select("log_id").distinct().withColumn("chain", F.array(*([] if envelope == "none" else [F.lit(envelope)])).cast("array<string>"))
    longest = {"none": 0, "auto": None}.get(envelope, 1)
    named = chain.select("log_id", F.when(F.size("chain") == 0, "none").otherwise(F.array_join("chain", "+")).alias("envelope"))
    if envelope == "none":
        return lines, lines.sparkSession.createDataFrame([], BLOCKS), named
    deepest = (chain.agg(F.max(F.size("chain"))).first()[0] or 0) if longest is None else longest
    if deepest == 0:
        return lines, lines.sparkSession.createDataFrame([], BLOCKS), named
    rows = lines.join(chain, "log_id").withColumns({"depth": F.lit(0), "command": F.lit(None).cast("string"), "args": F.lit(None).cast("string"), "code": F.lit(None).cast("string"), "off": F.lit(False)})
    for depth in range(deepest):
        stage = F.get("chain", F.lit(depth))
        live = ~F.col("off") & F.col("command").isNull() & stage.isNotNull()
        rows = rows.withColumn("p", F.when(live, peeled(F.col("line"), stage)))
        rows = rows.withColumn("on", ever(F.coalesce(F.col("p.hit"), F.lit(False))))
        rows = rows.select(
            "log_id", "line_no", "chain", F.coalesce("p.line", "line").alias("line"), F.when(live, F.lit(depth)).otherwise(F.col("depth")).alias("depth"), F.coalesce("command", "p.command").alias("command"),
            F.coalesce("args", "p.args").alias("args"), F.coalesce("code", "p.code").alias("code"), (F.col("off") | live & (stage == "docker-compose") & ~F.col("on")).alias("off"),
        )
    clean = rows.where("not off and command is null").select("log_id", "line_no", "line")
    of = F.get("chain", F.col("depth"))
    said = rows.where("not off and command is not null").select("log_id", "line_no", "depth", of.alias("envelope"), "command", "args", trimmed(F.col("args")).alias("text"), "code")
    said = said.where("command in ('group', 'endgroup', 'error', 'warning', 'notice', 'start', 'end', 'failed')")
    return clean, said.groupBy("log_id", "depth").applyInArrow(_signals, BLOCKS), named


def _signals(key, batch):
    """Signal blocks of one wrapper of a log. Only its command lines come here; a step is named by the innermost open group."""
    stack: list[str] = []
    out = []
    for r in batch.sort_by("line_no").to_pylist():
        at, command, text = r["line_no"], r["command"], r["text"]
        step = stack[-1] if stack else ""
        if command in ("group", "start"):
            if len(stack) < P.GROUP_DEPTH:
                stack.append(r["args"])
        elif command == "endgroup":
            del stack[-1:]
        elif command == "end":
            if r["args"] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(r["args"]) :]
        elif command == "failed" or command == "error" and r["code"]:
            body = f"Job failed: exit code {r['code']}" if command == "failed" else text
            out.append((at, 0, "envelope_step_failure", "error", step, [body], [], {"exit_code": r["code"]} | ({"step": step} if step else {})))
        else:
            severity, kind = ("error", "envelope_error") if command == "error" else ("warn", "envelope_warning")
            out.append((at, 0, kind, severity, text, [text], [], {}))
    return table(block_rows(key[0].as_py(), "envelope", out))
