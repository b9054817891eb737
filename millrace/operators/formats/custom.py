"""Formats that users define by patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import patterns as P
from ...functions.text import matches
from .segments import before, blocks, bodies, ever, running


@dataclass(frozen=True)
class CustomFormat:
    """A named format. ``event_start`` opens an event; ``event_end`` closes it, or each start line is an event of its own."""

    name: str
    detect_regex: str
    event_start: str
    event_end: str | None = None
    severity: str = "error"
    kind: str = "match"

    def __post_init__(self):
        # What is empty in a configuration file is as if it weren't there.
        for key, default in (("event_end", None), ("severity", "error"), ("kind", "match")):
            if not (getattr(self, key) or "").strip():
                object.__setattr__(self, key, default)
        for key in ("name", "detect_regex", "event_start"):
            if not (getattr(self, key) or "").strip():
                raise ValueError(f"custom format: {key} is required")
        for key in ("detect_regex", "event_start", "event_end"):
            text = getattr(self, key)
            if text and re.search(r"\(\?[=!]|\(\?<[=!]|\\[1-9]", text):
                raise ValueError(f"custom format {self.name}: {key}: look-around and back-references aren't supported")
            try:
                P.python(text or "")
            except re.error as e:
                raise ValueError(f"custom format {self.name}: {key}: {e}") from e
        if self.severity not in ("error", "warn", "info"):
            raise ValueError(f"custom format {self.name}: unknown severity {self.severity!r}")

    @property
    def id(self) -> str:
        return f"custom:{self.name.strip()}"

    def detect(self, sample: Column) -> Column:
        return F.when(matches(sample, self.detect_regex), P.CLEAR).otherwise(0.0)

    def parse(self, lines: DataFrame) -> DataFrame:
        marked = lines.withColumn("start", matches(F.col("line"), self.event_start))
        attrs = {"custom_format": F.lit(self.name.strip())}
        if not self.event_end:
            found = marked.where("start").select("log_id", F.col("line_no").alias("emit"), F.array("line").alias("body"), "line")
        else:
            islands = marked.withColumn("island", running(F.col("start"))).where("island > 0")
            ends = islands.withColumn("over", ever(~F.col("start") & matches(F.col("line"), self.event_end), before("island"))).where("not over")
            found = bodies(ends, "island", line="line")
        return blocks(found, self.id, F.lit(self.kind), F.lit(self.severity), F.col("line"), attrs)
