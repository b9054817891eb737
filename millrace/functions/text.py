"""Text expressions shared by the operators."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ANSI, java

#: White space as Unicode has it: each character, and a class.
SPACES = "\t\n\x0b\f\r\x85" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "Z")
_SPACE = r"\t\n\x0B\f\r \x{0085}\p{Z}"


def strip_ansi(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("\x1b")), F.regexp_replace(line, java(ANSI), "")).otherwise(line)


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def right_trimmed(text: Column) -> Column:
    """Without blanks, tabs and carriage returns at the end."""
    return F.rtrim(text, F.lit(" \t\r"))


def left_trimmed(text: Column) -> Column:
    """Without blanks and tabs at the start."""
    return F.ltrim(text, F.lit(" \t"))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def group(text: Column, pattern: str, k: int) -> Column:
    """Group k of the first match, empty if there is none."""
    return F.regexp_extract(text, java(pattern), k)


def as_int(digits: Column) -> Column:
    """An int, null for what isn't one or too large."""
    return digits.try_cast("int")


def _marks(text: Column, word: str, space: str) -> Column:
    """Each run of word characters as an ``a``, each run of symbols as a ``b``, white space as it is."""
    return F.regexp_replace(F.regexp_replace(text, f"[{word}]+", "a"), f"[^a{space}]+", "b")


def estimate(text: Column) -> Column:
    """Estimated tokens: runs of letters and digits weigh 1.3, runs of symbols 1, a tenth more for safety, to the nearest whole."""
    # Classes of ASCII characters are looked up in a table, those of Unicode are asked for each character.
    ascii_only = F.octet_length(text) == F.char_length(text)
    marks = F.when(ascii_only, _marks(text, "0-9A-Za-z", r"\t\n\x0B\f\r ")).otherwise(_marks(text, r"\p{L}\p{Nd}", _SPACE))

    def weigh(m: Column) -> Column:
        words, symbols = (F.char_length(m) - F.char_length(F.replace(m, F.lit(c))) for c in "ab")
        return F.floor((words * F.lit(1.3).cast("double") + symbols) * F.lit(1.1).cast("double") + 0.5).cast("long")

    # A lambda's argument is evaluated once, however often it is used.
    return F.get(F.transform(F.array(marks), weigh), F.lit(0))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warn", 2).when(severity == "info", 1).otherwise(0)


def severity_label(severity: Column) -> Column:
    return F.when(severity.isin("error", "warn", "info"), F.upper(severity)).otherwise(severity)
