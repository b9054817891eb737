"""Unstructured logs: severity anchors with context, tracebacks and panics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import patterns as P
from ...functions.text import matches, severity_rank, strip_ansi
from ...streaming.folds import RANK, GenericFold
from ..folding import fold_logs
from .segments import blocks, by_line


def _follows(plain: Column, pattern: str) -> Column:
    """Whether a rule matches. Most lines lack the text that the rule needs, and the search for a text costs far less than a pattern."""
    text = F.lower(plain) if pattern.startswith("(?i)") else plain
    return F.contains(text, F.lit(P.needed(pattern))) & matches(plain, pattern)


def _ruled(lines: DataFrame) -> DataFrame:
    """With ``rule``, the number of the first rule that matches a line, from 1; null if none does."""
    rule = None
    for k, (pattern, _, _) in enumerate(P.CATALOGUE, 1):
        found = _follows(F.col("plain"), pattern)
        rule = F.when(found, k) if rule is None else rule.when(found, k)
    return lines.withColumn("plain", strip_ansi(F.col("line"))).withColumn("rule", rule).drop("plain")


def _value(k: int) -> Column:
    """Severity (1) or kind (2) of the rule."""
    return F.get(F.array(*(F.lit(r[k]) for r in P.CATALOGUE)), F.col("rule") - 1)


def classified(lines: DataFrame) -> DataFrame:
    """With ``severity`` and ``kind`` of the first rule that matches a line, null if none does."""
    # The rule's number is a column of its own, so that the rules are tried once a line.
    return _ruled(lines).withColumns({"severity": _value(1), "kind": _value(2)}).drop("rule")


def anchors(lines: DataFrame, least: str = "error") -> DataFrame:
    """Lines that open an event: ``log_id, line_no, line, severity, kind``. No shuffle."""
    # Optimised, the filter holds the rules themselves, so it names them once.
    enough = [k for k, (_, severity, _) in enumerate(P.CATALOGUE, 1) if RANK[severity] >= RANK.get(least, 0)]
    return _ruled(lines).where(F.col("rule").isin(enough)).select("log_id", "line_no", "line", _value(1).alias("severity"), _value(2).alias("kind"))


def with_context(lines: DataFrame, least: str = "error", context: int = P.CONTEXT_LINES) -> DataFrame:
    """Blocks of logs without tracebacks and panics: each anchor with the lines before it, and after it up to the next anchor."""
    n = context if context > 0 else P.CONTEXT_LINES
    marked = classified(lines).withColumn("open", F.coalesce(severity_rank(F.col("severity")) >= RANK.get(least, 0), F.lit(False)))
    before, after = by_line().rowsBetween(-n, -1), by_line().rowsBetween(1, n)
    near = marked.withColumns({
        "pre": F.collect_list("line").over(before), "post": F.collect_list("line").over(after),
        "gap": F.min(F.when(F.col("open"), F.col("line_no"))).over(after) - F.col("line_no"),
    }).where("open")
    post = F.slice("post", F.lit(1), F.coalesce(F.col("gap"), F.lit(n)).cast("int"))
    found = near.select("log_id", F.col("line_no").alias("emit"), F.array("line").alias("body"), "line", "kind", "severity", F.concat("pre", post).alias("context"))
    return blocks(found, "generic", F.col("kind"), F.col("severity"), F.col("line"), None, F.col("context"))


def parse(lines: DataFrame, least: str = "error", context: int = P.CONTEXT_LINES) -> DataFrame:
    """Blocks. Logs with a traceback or panic go through the fold, since blocks of one kind may hide anchors of the other."""
    plain, first = strip_ansi(F.col("line")), F.lit(False)
    for pattern, _, kind in P.CATALOGUE:
        # The rules of tracebacks and panics come before all others, so the others needn't be tried.
        if kind not in ("traceback", "panic"):
            break
        first = first | _follows(plain, pattern)
    opens = lines.where(first).select("log_id").distinct()
    plain = lines.join(opens, "log_id", "left_anti")
    n = context if context > 0 else P.CONTEXT_LINES
    return with_context(plain, least, n).unionByName(fold_logs(lines.join(opens, "log_id", "left_semi"), "generic", lambda: GenericFold(least=least, context=n)))
