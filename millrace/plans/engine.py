"""The composed plan: lines, envelopes, format, blocks, events, stages, summary, rendering."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encoders, stages
from ..functions.bpe import counter
from ..operators.detection import BUILTIN, REGISTERED, detect
from ..operators.envelopes import strip
from ..operators.projection import events_of, numbered
from ..operators.summaries import summarise
from ..sources.logs import input_lines, lines_of, samples
from ..sources.scratch import written
from .options import OptionError, SiftOptions


def parse(lines: DataFrame, fmt: str, options: SiftOptions) -> DataFrame:
    """Lines of logs of one format -> events with ``emit`` and ``rank``."""
    if fmt == "generic":
        return events_of(BUILTIN[fmt].parse(lines, options.least, options.context), fmt)
    if fmt == "pytest":
        return events_of(BUILTIN[fmt].parse(lines, options.least), fmt)
    if fmt in BUILTIN:
        return events_of(BUILTIN[fmt].parse(lines), fmt)
    if fmt in REGISTERED:
        return events_of(REGISTERED[fmt].parse(lines), fmt, REGISTERED[fmt].project)
    own = {f.id: f for f in options.formats}
    if fmt not in own:
        raise OptionError(f"unknown format {fmt!r}; known: {', '.join(sorted([*BUILTIN, *REGISTERED, *own]))}")
    return events_of(own[fmt].parse(lines), fmt)


@dataclass(frozen=True)
class Result:
    """Lazy results of a run; only what is used is computed. ``raw(log_id, text)`` is what passthrough gives back."""

    raw: DataFrame
    logs: DataFrame
    found: DataFrame
    options: SiftOptions

    @cached_property
    def _total(self) -> stages.Estimator:
        return stages._total if self.options.tokenizer == "heuristic" else counter(self.options.vocabulary, self.options.token_pattern)

    @cached_property
    def deduped(self) -> DataFrame:
        return stages.dedupe(stages.collapse_frames(self.found, self.options.keep_vendor), self.options.dedupe_window)

    @cached_property
    def decisions(self) -> DataFrame | None:
        return stages.decide(self.deduped, self.options.budget, self.options.budget_reserve, self._total) if self.options.budget > 0 else None

    @cached_property
    def budgeted(self) -> DataFrame:
        return self.deduped if self.decisions is None else stages.apply_budget(self.deduped, self.decisions)

    @cached_property
    def events(self) -> DataFrame:
        out = stages.max_events(self.budgeted, self.options.max_events)
        # What a log gives is numbered without gaps; the budget has done so already.
        return stages.renumbered(out) if self.options.dedupe_window > 0 and self.decisions is None else out

    @cached_property
    def summary(self) -> DataFrame:
        return summarise(self.logs, self.events, self.decisions, self.options.tokenizer, self.options.passthrough)

    def render(self) -> DataFrame:
        """``log_id, text`` in the chosen output; with passthrough, logs without events give their own text instead, unless the budget dropped events."""
        o = self.options
        if o.output == "ndjson":
            each = encoders.ndjson(self.events, self.summary)
            joined = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
            out = each.groupBy("log_id").agg(F.array_join(joined, "").alias("text"))
        elif o.output == "json":
            out = encoders.json_batch(self.events, self.summary)
        else:
            out = encoders.markdown(self.events, self.summary, o.footer, o.fence) if o.output == "markdown" else encoders.text(self.events, self.summary, o.footer)
        if not o.passthrough:
            return out
        empty = self.summary.where("events_emitted = 0 and exit_code = 0").select("log_id")
        return out.join(empty, "log_id", "left_anti").unionByName(self.raw.join(empty, "log_id", "left_semi").select("log_id", "text"))

    def explain(self) -> DataFrame:
        """``log_id, part, seq, line``: what was kept and what the budget dropped or cut. The cap on events plays no part."""
        if self.decisions is None:
            gone = self.deduped.where(F.lit(False)).select("log_id", F.col("seq").alias("place"), F.lit("").alias("reason"), "severity", "title", "location")
        else:
            title = F.when(F.col("decision") == "cut", F.concat("title", F.lit(" [truncated]"))).otherwise(F.col("title"))
            gone = self.deduped.join(self.decisions, ["log_id", "seq"]).where("decision <> 'keep'").select("log_id", "place", F.lit("budget").alias("reason"), "severity", title.alias("title"), "location")
        return encoders.explain(self.budgeted, gone)


@dataclass(frozen=True)
class Results:
    """Results of logs whose formats have options of their own, as one."""

    parts: tuple[Result, ...]

    def _all(self, of) -> DataFrame:
        out = of(self.parts[0])
        for part in self.parts[1:]:
            out = out.unionByName(of(part))
        return out

    @cached_property
    def events(self) -> DataFrame:
        return self._all(lambda r: r.events)

    @cached_property
    def summary(self) -> DataFrame:
        return self._all(lambda r: r.summary)

    @cached_property
    def logs(self) -> DataFrame:
        return self._all(lambda r: r.logs)

    def render(self) -> DataFrame:
        return self._all(lambda r: r.render())

    def explain(self) -> DataFrame:
        return self._all(lambda r: r.explain())


def sift_logs(logs: DataFrame, options: SiftOptions = SiftOptions()) -> Result | Results:
    """Distills whole logs ``(log_id, text)``; null texts are empty. Logs without lines give a summary too, and passthrough gives back their text as it is."""
    raw = logs.select(F.col("log_id").cast("string").alias("log_id"), F.coalesce("text", F.lit("")).alias("text"))
    return sift(lines_of(raw), options, raw)


def sift(lines: DataFrame, options: SiftOptions = SiftOptions(), raw: DataFrame | None = None) -> Result | Results:
    """Distills ``lines(log_id, line_no, line)``; ``raw(log_id, text)`` is the logs they come from, or else the lines joined.

    Logs are independent; all windows and folds are by log, so one exchange on ``log_id`` serves them. Signals of
    envelopes come before events completed by the same line.
    """
    lines = lines.select("log_id", "line_no", "line")
    clean, signals, wrapped = strip(lines, options.envelope, options.sample_bytes)
    if raw is None:
        counts = lines.groupBy("log_id").agg(F.count("*").alias("input_lines"))
        ordered = lines.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        raw = ordered.select("log_id", F.array_join(F.transform("ls", lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))
    else:
        counts = raw.select("log_id", input_lines(F.col("text")).alias("input_lines"))
    logs = counts.join(wrapped, "log_id", "left").withColumn("envelope", F.coalesce("envelope", F.lit("none")))
    if options.format == "auto":
        kinds = detect(samples(clean, options.sample_bytes), options.formats, options.strict).select("log_id", "format")
        logs = logs.join(kinds, "log_id", "left").withColumn("format", F.coalesce("format", F.lit("generic")))
        # Every format reads its own lines, some more than once: they are cleaned and written once, by format.
        routed = written(clean.join(kinds, "log_id"), "format")
        # At most one row per known format: only the parsers that some log needs are planned.
        there = {r.format for r in routed.select("format").distinct().collect()} | {"generic"}
        alike: dict[SiftOptions, list[str]] = {}
        for fmt in [f for f in [*BUILTIN, *REGISTERED, *(f.id for f in options.formats)] if f in there]:
            alike.setdefault(options.of(fmt), []).append(fmt)
        parts = []
        for own, fmts in alike.items():
            found = None
            for fmt in fmts:
                one = parse(routed.where(F.col("format") == fmt).drop("format"), fmt, own)
                found = one if found is None else found.unionByName(one)
            here = logs if len(alike) == 1 else logs.where(F.col("format").isin(fmts))
            told = signals if len(alike) == 1 else signals.join(here.select("log_id"), "log_id", "left_semi")
            parts.append(_result(raw if len(alike) == 1 else raw.join(here.select("log_id"), "log_id", "left_semi"), here, found, told, own))
        return parts[0] if len(parts) == 1 else Results(tuple(parts))
    return _result(raw, logs.withColumn("format", F.lit(options.format)), parse(clean, options.format, options.of(options.format)), signals, options.of(options.format))


def _result(raw: DataFrame, logs: DataFrame, found: DataFrame, signals: DataFrame, options: SiftOptions) -> Result:
    if options.envelope != "none":
        found = found.unionByName(events_of(signals, "envelope"))
    events = numbered(found)
    if options.format == "auto" or options.dedupe_window > 0 or options.budget > 0:
        # The stages and the summary read the events several times.
        events = written(events)
    return Result(raw, logs, events, options)


def detect_report(lines: DataFrame, options: SiftOptions = SiftOptions()) -> DataFrame:
    """One row per log: envelope, format, confidence, bytes looked at, whether no format is sure (exit code 1), and the runner-up with its confidence, null if there is none."""
    clean, _, wrapped = strip(lines, options.envelope, options.sample_bytes)
    found = detect(samples(clean, options.sample_bytes), options.formats, options.strict)
    return wrapped.join(found, "log_id", "left").select(
        "log_id", "envelope", F.coalesce("format", F.lit("generic")).alias("format"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("sample_bytes", F.lit(0)).cast("long").alias("sample_bytes"),
        F.coalesce("fellback_to_generic", F.lit(True)).alias("fellback_to_generic"), F.col("runner_up").alias("runner"), F.when(F.col("runner_up").isNotNull(), F.col("runner_up_confidence")).alias("runner_confidence"),
        F.when(F.coalesce("fellback_to_generic", F.lit(True)), 1).otherwise(0).alias("exit_code"),
    )


def report_lines(row) -> list[str]:
    """A row of ``detect_report`` as ``key: value`` lines."""
    out = [f"source: {row.log_id}", f"envelope: {row.envelope}", f"format: {row.format}", f"confidence: {row.confidence:.2f}", f"sample_bytes: {row.sample_bytes}", f"fellback_to_generic: {str(row.fellback_to_generic).lower()}"]
    return [*out, f"runner: {row.runner}", f"runner_confidence: {row.runner_confidence:.2f}"] if row.runner else [*out, "runner: (none)"]
