"""Format detection: every format scores a log's first bytes, and the best score of at least 0.6 wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import group, matches
from .formats import generic, gotest, gotestsum, jest, pytest
from .formats.custom import CustomFormat

BUILTIN = {"generic": generic, "gotest": gotest, "gotestsum": gotestsum, "jest": jest, "pytest": pytest}


@dataclass(frozen=True)
class Format:
    """A format that a program adds: how sure it is of a sample, its blocks of lines, and their events (by default as those of custom formats)."""

    name: str
    score: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame]
    project: Callable[[DataFrame], DataFrame] | None = None


REGISTERED: dict[str, Format] = {}


def register_format(fmt: Format) -> None:
    """Makes a format known to detection, parsing and listing. Names are unique."""
    if not fmt.name.strip() or fmt.name in BUILTIN or fmt.name in REGISTERED or fmt.name == "auto":
        raise ValueError(f"format name {fmt.name!r} is empty or taken")
    REGISTERED[fmt.name] = fmt


def unregister_format(name: str) -> None:
    REGISTERED.pop(name, None)


class DetectError(ValueError):
    """No format is sure enough, and strict detection was asked for."""


def _any(sample: Column, found: list[str]) -> Column:
    out = F.lit(False)
    for pattern in found:
        out = out | matches(sample, pattern)
    return out


def _both(sample: Column, found: list[str]) -> Column:
    return matches(sample, found[0]) & matches(sample, found[1])


def scores(sample: Column) -> dict[str, Column]:
    """Score of each built-in format; the fallback's own never wins."""
    path = matches(group(sample, P.DETECT_JEST_FILE, 2), P.DETECT_JEST_PATH)
    return {
        "gotest": F.when(_any(sample, P.DETECT_GOTEST), P.CLEAR).when(_both(sample, P.DETECT_GOTEST_FUZZY), P.FUZZY).otherwise(0.0),
        "gotestsum": F.when(_any(sample, P.DETECT_GOTESTSUM), P.CLEAR).otherwise(0.0),
        "jest": F.when(matches(sample, P.DETECT_JEST) | path, P.CLEAR).when(_both(sample, P.DETECT_JEST_FUZZY), P.FUZZY).otherwise(0.0),
        "pytest": F.when(_any(sample, P.DETECT_PYTEST), P.CLEAR).when(_both(sample, P.DETECT_PYTEST_FUZZY), P.FUZZY).otherwise(0.0),
    }


def generic_score(sample: Column) -> Column:
    return F.when(matches(sample, P.DETECT_GENERIC), P.GENERIC_CONFIDENCE).otherwise(0.0)


def ranked(found: dict[str, Column]) -> Column:
    """Array of (score less than zero, name), the best first, ties by name."""
    return F.array_sort(F.array(*(F.struct((-v).alias("s"), F.lit(k).alias("name")) for k, v in found.items())))


def detect(samples: DataFrame, formats: list[CustomFormat] = (), strict: bool = False) -> DataFrame:
    """``log_id, sample`` -> ``log_id, format, confidence, fellback_to_generic, runner_up, runner_up_confidence, sample_bytes``."""
    found = scores(F.col("sample")) | {f.name: f.score(F.col("sample")).cast("double") for f in REGISTERED.values()} | {f.id: f.detect(F.col("sample")) for f in formats}
    out = samples.withColumn("r", ranked(found))
    best, second = F.element_at("r", 1), F.element_at("r", 2)
    sure = -best["s"] >= P.LEAST_CONFIDENCE
    out = out.select(
        "log_id", F.when(sure, best["name"]).otherwise("generic").alias("format"), F.when(sure, -best["s"]).otherwise(0.0).alias("confidence"), (~sure).alias("fellback_to_generic"),
        F.when(sure & (second["s"] < 0), second["name"]).when(~sure & (best["s"] < 0), best["name"]).alias("runner_up"),
        F.when(sure & (second["s"] < 0), -second["s"]).when(~sure & (best["s"] < 0), -best["s"]).otherwise(0.0).alias("runner_up_confidence"), F.octet_length("sample").cast("long").alias("sample_bytes"),
    )
    if strict:
        message = F.concat(F.lit("no format detected with confidence for log "), F.col("log_id"))
        out = out.withColumn("format", F.when(F.col("fellback_to_generic"), F.raise_error(message).cast("string")).otherwise(F.col("format")))
    return out


def list_formats(formats: list[CustomFormat] = ()) -> list[str]:
    """Lines ``name, version, origin`` in order of name."""
    return [f"{n}\t1\tbuiltin" for n in sorted([*BUILTIN, *REGISTERED, *(f.id for f in formats)])]
