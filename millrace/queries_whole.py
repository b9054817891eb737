"""More queries with their SQL: folds, signals, rendering, whole runs and options. SQL follows a fold line by line with a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import patterns as P
from .functions.text import strip_ansi
from .operators import detection, encoders, envelopes, stages, summaries
from .operators.formats import generic, gotest
from .operators.formats.custom import CustomFormat
from .operators.projection import PROJECTIONS, events_of
from .plans.engine import detect_report, sift, sift_logs
from .plans.options import SiftOptions, apply_config, dedupe_window, parse_config
from .queries import (
    _ANCHORS, _BUDGET, _EVENTS, _SIG, _cost, _add, _app_events, _documents, _flat, _get, _has, _rules, _sql, APP_LOG, GHA_LOG, GITLAB_LOG, GO_JSON_LOG, GO_LOG, MIXED_LOG, PANIC_LOG, PYTEST_LOG, QUERIES, SQL,
)
from .sources.logs import concatenated, input_lines, lines_of, samples

_EMPTY = "CAST([] AS VARCHAR[])"


# Folds. ---------------------------------------------------------------------------------------------------------------

_HELD = "STRUCT(t VARCHAR, d VARCHAR, h VARCHAR, b VARCHAR[])"
_OUT = "STRUCT(kind VARCHAR, head VARCHAR, body VARCHAR[], t VARCHAR, d VARCHAR, p VARCHAR)"


def _out(kind: str, head: str, body: str, test: str = "''", duration: str = "''", package: str = "''") -> str:
    return f"CAST({{'kind': {kind}, 'head': {head}, 'body': {body}, 't': {test}, 'd': {duration}, 'p': {package}}} AS {_OUT})"


_DUMPED = _out("CASE mode WHEN 'race' THEN 'race_condition' ELSE 'panic' END", "dhead", "grown", "dtest")
_NO_OUT = f"CAST([] AS {_OUT}[])"


def _go_text(log: str) -> str:
    """Blocks of go test's text, by a recursive query over each log's lines."""
    grow = lambda most, note: f"CASE WHEN len(dump) < {most} - 1 THEN list_append(dump, line) WHEN len(dump) = {most} - 1 THEN list_append(dump, '{note}') ELSE dump END"
    held = f"list_transform(held2, lambda x: {_out(chr(39) + 'test_failure' + chr(39), 'x.h', 'x.b', 'x.t', 'x.d', 'name')})"
    return f"""
WITH RECURSIVE l AS (SELECT log_id, line_no, line, {_has('line', P.GO_RACE)} AS divider, {_has('line', P.GO_PANIC_GOES_ON)} AS goes,
 CASE WHEN {_has('line', P.GO_RACE)} THEN 'race' WHEN {_has('line', P.GO_BUILD_FAILED)} THEN 'unbuilt' WHEN {_has('line', P.GO_PACKAGE)} THEN 'package' WHEN {_has('line', P.GO_OK)} OR {_has('line', P.GO_EXIT)} THEN 'ok' WHEN {_has('line', P.GO_PANIC)} THEN 'panic'
  WHEN {_has('line', P.GO_BUILD_ERROR)} THEN 'build' WHEN {_has('line', P.GO_RUN)} THEN 'run' WHEN {_has('line', P.GO_PAUSE_OR_CONT)} THEN 'pause' WHEN {_has('line', P.GO_FAIL)} THEN 'fail' WHEN {_has('line', P.GO_PASS_OR_SKIP)} THEN 'pass' ELSE 'other' END AS c,
 coalesce(nullif({_get('line', P.GO_PACKAGE, 1)}, ''), nullif({_get('line', P.GO_RUN, 1)}, ''), {_get('line', P.GO_FAIL, 1)}) AS name, {_get('line', P.GO_FAIL, 2)} AS took FROM ({log})),
f AS (SELECT log_id, CAST(0 AS BIGINT) AS line_no, '' AS mode, {_EMPTY} AS dump, '' AS dhead, '' AS dtest, CAST(NULL AS {_HELD}) AS cur, {_EMPTY} AS early, '' AS test, {_EMPTY} AS accounted, true AS idle, false AS failing, CAST([] AS {_HELD}[]) AS held, {_NO_OUT} AS emitted FROM (SELECT DISTINCT log_id FROM l)
 UNION ALL SELECT log_id, line_no,
  CASE WHEN go AND c IN ('race', 'panic') THEN c WHEN ends THEN '' ELSE mode END, CASE WHEN go AND c IN ('race', 'panic') THEN [line] WHEN ends THEN {_EMPTY} ELSE grown END, CASE WHEN go AND c = 'race' THEN '{P.GO_RACE_TITLE}' WHEN go AND c = 'panic' THEN line ELSE dhead END,
  CASE WHEN go AND c = 'race' THEN test WHEN go AND c = 'panic' THEN coalesce(cur.t, test) ELSE dtest END,
  CASE WHEN NOT go THEN cur WHEN c IN ('race', 'package', 'ok', 'pass', 'panic') THEN NULL WHEN c = 'fail' AND NOT known THEN CAST({{'t': name, 'd': took, 'h': line, 'b': list_append(early, line)}} AS {_HELD}) WHEN c = 'other' AND cur IS NOT NULL AND failing1 THEN CAST({{'t': cur.t, 'd': cur.d, 'h': cur.h, 'b': list_append(cur.b, line)}} AS {_HELD}) ELSE cur END,
  CASE WHEN NOT go THEN early WHEN c IN ('package', 'unbuilt', 'ok', 'panic', 'run', 'fail', 'pass') THEN {_EMPTY} WHEN c = 'other' AND NOT (cur IS NOT NULL AND failing1) AND idle1 AND left(line, 1) IN (' ', chr(9)) THEN list_append(early, line) ELSE early END,
  CASE WHEN go AND (c = 'run' OR c = 'fail' AND NOT known) THEN name ELSE test END,
  CASE WHEN go AND c = 'race' AND test <> '' THEN list_append(accounted, test) WHEN go AND c = 'panic' AND coalesce(cur.t, test) <> '' THEN list_append(accounted, coalesce(cur.t, test)) ELSE accounted END,
  CASE WHEN NOT go THEN idle1 WHEN c IN ('race', 'package', 'unbuilt', 'ok', 'panic') THEN false WHEN c = 'fail' THEN known WHEN c = 'pass' THEN true ELSE idle1 END,
  CASE WHEN NOT go THEN failing1 WHEN c IN ('race', 'package', 'unbuilt', 'ok', 'panic', 'pass') THEN false WHEN c = 'fail' THEN NOT known ELSE failing1 END,
  CASE WHEN go AND c = 'package' THEN CAST([] AS {_HELD}[]) ELSE held2 END,
  list_concat(CASE WHEN ends THEN [{_DUMPED}] ELSE {_NO_OUT} END, CASE WHEN go AND c = 'package' THEN {held} WHEN go AND c = 'build' THEN [{_out("'build_failure'", 'line', '[line]')}] ELSE {_NO_OUT} END)
 FROM (SELECT *, CASE WHEN go AND cur IS NOT NULL AND (c IN ('race', 'package', 'ok', 'pass') OR c = 'fail' AND NOT known) THEN list_append(held, cur) ELSE held END AS held2, CASE WHEN ends THEN true ELSE idle END AS idle1, CASE WHEN ends THEN false ELSE failing END AS failing1
  FROM (SELECT f.* EXCLUDE (line_no, emitted), l.* EXCLUDE (log_id), mode = 'race' AND divider OR mode = 'panic' AND NOT (goes AND NOT divider) AS ends, mode <> 'race' AND NOT (mode = 'panic' AND goes AND NOT divider) AS go, list_contains(accounted, name) AS known,
   CASE WHEN mode = 'race' AND divider THEN CASE WHEN len(dump) < {P.GO_RACE_LINES} THEN list_append(dump, line) ELSE dump END WHEN mode = 'race' THEN {grow(P.GO_RACE_LINES, P.GO_RACE_CUT)} WHEN mode = 'panic' AND goes AND NOT divider THEN {grow(P.GO_PANIC_LINES, P.GO_PANIC_CUT)} ELSE dump END AS grown
   FROM f JOIN l ON l.log_id = f.log_id AND l.line_no = f.line_no + 1))),
z AS (SELECT *, dump AS grown FROM f QUALIFY line_no = max(line_no) OVER (PARTITION BY log_id)),
o AS (SELECT log_id, line_no, unnest(emitted) AS e FROM f UNION ALL SELECT log_id, line_no, {_DUMPED} FROM z WHERE mode <> ''
 UNION ALL SELECT log_id, line_no, {_out("'test_failure'", 'x.h', 'x.b', 'x.t', 'x.d')} FROM (SELECT log_id, line_no, unnest(CASE WHEN cur IS NULL THEN held ELSE list_append(held, cur) END) AS x FROM z)),
p AS (SELECT log_id, line_no AS emit, e, list_filter(list_transform(e.body, lambda x: ltrim(x, ' ' || chr(9))), lambda x: {_has('x', P.GO_ASSERTION)})[1] AS said FROM o)
SELECT log_id, emit, e.kind AS kind, CASE WHEN e.kind = 'build_failure' THEN trim({_get('e.head', P.GO_BUILD_ERROR, 4)}) WHEN e.kind = 'test_failure' AND said IS NOT NULL THEN trim({_get('said', P.GO_ASSERTION, 3)}) ELSE trim(e.head) END AS title,
 CASE WHEN e.kind = 'build_failure' THEN {_get('e.head', P.GO_BUILD_ERROR, 1)} WHEN e.kind = 'test_failure' AND said IS NOT NULL THEN {_get('said', P.GO_ASSERTION, 1)} END AS file,
 CAST(CASE WHEN e.kind = 'build_failure' THEN {_get('e.head', P.GO_BUILD_ERROR, 2)} WHEN e.kind = 'test_failure' AND said IS NOT NULL THEN {_get('said', P.GO_ASSERTION, 2)} END AS BIGINT) AS line, CAST(len(e.body) AS BIGINT) AS n_body, md5(array_to_string(e.body, chr(10))) AS body_md5,
 concat_ws(';', CASE WHEN e.d <> '' THEN 'duration=' || e.d END, CASE WHEN e.p <> '' THEN 'package=' || e.p END, CASE WHEN e.kind = 'panic' AND e.body[-1] = '{P.GO_PANIC_CUT}' THEN 'panic_truncated=true' END, CASE WHEN e.kind = 'race_condition' THEN 'race_goroutines=2' END,
  CASE WHEN e.kind = 'race_condition' AND e.body[-1] = '{P.GO_RACE_CUT}' THEN 'race_truncated=true' END, CASE WHEN e.t <> '' THEN 'test_id=' || e.t END) AS meta FROM p"""


SQL["gotest_text"] = _go_text(GO_LOG)
_MODES = f"""SELECT 't' || log_id AS log_id, line_no, line FROM ({GO_LOG}) a UNION ALL SELECT 'j' || log_id, line_no, line FROM ({GO_JSON_LOG.replace('o % 23 = 0', 'o % 23 = 99')}) b"""


@_add("gotest_modes", f"""SELECT 't' || log_id AS log_id, count(*) AS n, count(*) FILTER (kind = 'test_failure') AS n_tests FROM ({SQL['gotest_text']}) GROUP BY ALL
UNION ALL SELECT 'j' || log_id, count(*), count(*) FILTER (kind = 'test_failure') FROM ({SQL['gotest_json'].replace('o % 23 = 0', 'o % 23 = 99')}) GROUP BY ALL""")
def gotest_modes(spark, sf_dir):
    """Logs of both reporters together: each goes to the parser that its first line asks for."""
    return gotest.parse(_sql(spark, sf_dir, _MODES)).groupBy("log_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "test_failure", 1)).alias("n_tests"))


_HEAD = "STRUCT(kind VARCHAR, header VARCHAR, pre VARCHAR[])"
_BLOCK = "STRUCT(kind VARCHAR, header VARCHAR, body VARCHAR[], context VARCHAR[])"
_CLOSED = f"CAST({{'kind': head.kind, 'header': head.header, 'body': CASE WHEN cut THEN list_append(body[1:{P.GENERIC_BLOCK_LINES - 1}], '{P.GENERIC_BLOCK_CUT}') ELSE body END, 'context': list_concat(head.pre, %s)}} AS {_BLOCK})"


@_add("generic_blocks", f"""
WITH RECURSIVE l AS (SELECT log_id, line_no, line, {_rules(2, 'line')} AS kind, {_has('line', P.TRACEBACK_GOES_ON)} AS t_on, {_has('line', P.PANIC_GOES_ON)} AS p_on FROM ({PANIC_LOG})),
f AS (SELECT log_id, CAST(0 AS BIGINT) AS line_no, CAST(NULL AS {_HEAD}) AS head, {_EMPTY} AS body, {_EMPTY} AS after, false AS inside, false AS cut, {_EMPTY} AS before, CAST(NULL AS {_BLOCK}) AS done FROM (SELECT DISTINCT log_id FROM l)
 UNION ALL SELECT log_id, line_no, CASE WHEN eats THEN head WHEN kind IS NOT NULL THEN CAST({{'kind': kind, 'header': line, 'pre': before}} AS {_HEAD}) WHEN closes THEN NULL ELSE head END,
  CASE WHEN eats THEN CASE WHEN len(body) < {P.GENERIC_BLOCK_LINES} THEN list_append(body, line) ELSE body END WHEN kind IS NOT NULL THEN [line] ELSE body END,
  CASE WHEN eats THEN after WHEN closes OR head IS NULL THEN {_EMPTY} ELSE list_append(after, line) END, eats OR coalesce(kind IN ('traceback', 'panic'), false),
  CASE WHEN eats THEN cut OR len(body) >= {P.GENERIC_BLOCK_LINES} WHEN closes THEN false ELSE cut END, list_append(before, line)[-{P.CONTEXT_LINES}:], CASE WHEN closes THEN {_CLOSED % 'list_append(after, line)'} END
 FROM (SELECT *, NOT eats AND head IS NOT NULL AND (kind IS NOT NULL OR len(after) + 1 = {P.CONTEXT_LINES}) AS closes
  FROM (SELECT f.* EXCLUDE (line_no, done), l.* EXCLUDE (log_id), inside AND CASE head.kind WHEN 'traceback' THEN t_on ELSE p_on END AS eats FROM f JOIN l ON l.log_id = f.log_id AND l.line_no = f.line_no + 1))),
z AS (SELECT * FROM f QUALIFY line_no = max(line_no) OVER (PARTITION BY log_id)),
o AS (SELECT log_id, line_no, done AS b FROM f WHERE done IS NOT NULL UNION ALL SELECT log_id, line_no, {_CLOSED % 'after'} FROM z WHERE head IS NOT NULL)
SELECT log_id, line_no AS emit, b.kind AS kind, CASE WHEN b.kind = 'traceback' THEN list_filter(b.body, lambda x: trim(x) <> '' AND x <> '{P.GENERIC_BLOCK_CUT}')[-1] ELSE b.header END AS title, CAST(len(b.body) AS BIGINT) AS n_body,
 md5(array_to_string(b.body, chr(10))) AS body_md5, array_to_string(b.context, chr(10)) AS context, CAST(len(list_filter(b.body, lambda x: b.kind = 'traceback' AND {_has('x', P.PYTHON_FRAME)})) AS BIGINT) AS n_frames FROM o""")
def generic_blocks(spark, sf_dir):
    """Tracebacks and panics gather the lines that go on with them, up to a cap; what follows is context."""
    from .operators.folding import fold_logs
    from .streaming.folds import GenericFold

    out = _flat(events_of(fold_logs(_sql(spark, sf_dir, PANIC_LOG), "generic", lambda: GenericFold(least="warn")), "generic"), "emit")
    return out.select("log_id", "emit", "kind", "title", "n_body", "body_md5", "context", "n_frames")


@_add("generic_routed", f"SELECT log_id, kind, title, n_body, body_md5, context FROM ({SQL['generic_blocks']})")
def generic_routed(spark, sf_dir):
    """The same through the parser, which gives logs without such blocks to windows and the others to the fold."""
    out = _flat(events_of(generic.parse(_sql(spark, sf_dir, PANIC_LOG), "warn"), "generic"), "emit")
    return out.select("log_id", "kind", "title", "n_body", "body_md5", "context")


_W = 4


@_add("dedupe_bounded", f"""
WITH RECURSIVE e AS (SELECT log_id, seq, title, title || '|' || file || ':' || pos AS sig FROM ({_EVENTS})),
f AS (SELECT log_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS owner, CAST([] AS STRUCT(s VARCHAR, q BIGINT)[]) AS held FROM (SELECT DISTINCT log_id FROM e)
 UNION ALL SELECT e.log_id, e.seq, coalesce(list_filter(held, lambda x: x.s = sig)[1].q, e.seq), CASE WHEN len(list_filter(held, lambda x: x.s = sig)) > 0 THEN held ELSE list_append(held, CAST({{'s': sig, 'q': e.seq}} AS STRUCT(s VARCHAR, q BIGINT)))[-{_W}:] END
 FROM f JOIN e ON e.log_id = f.log_id AND e.seq = f.seq + 1)
SELECT f.log_id, f.owner AS seq, any_value(e.title) AS title, count(*) AS n_times FROM f JOIN e ON e.log_id = f.log_id AND e.seq = f.owner GROUP BY f.log_id, f.owner""")
def dedupe_bounded(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", dedupe_window=_W).deduped.select("log_id", "seq", "title", F.col("count").cast("long").alias("n_times"))


# Envelopes. -----------------------------------------------------------------------------------------------------------

_TOP = "coalesce(stack[-1], '')"


def _stacked(commands: str, push: str, step: str) -> str:
    """Commands of each log with the names that are open, by a recursive query."""
    return f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS r FROM ({commands})),
f AS (SELECT log_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS line_no, '' AS cmd, '' AS arg, {_EMPTY} AS stack FROM (SELECT DISTINCT log_id FROM c)
 UNION ALL SELECT c.log_id, c.r, c.line_no, c.cmd, c.arg, CASE WHEN {push} THEN CASE WHEN len(stack) < {P.GROUP_DEPTH} THEN list_append(stack, c.arg) ELSE stack END {step} ELSE stack END FROM f JOIN c ON c.log_id = f.log_id AND c.r = f.r + 1)"""


_LAB = _stacked(
    f"SELECT log_id, line_no, CASE WHEN {_has('line', P.GITLAB_SECTION)} THEN {_get('line', P.GITLAB_SECTION, 1)} ELSE 'failed' END AS cmd, CASE WHEN {_has('line', P.GITLAB_SECTION)} THEN {_get('line', P.GITLAB_SECTION, 3)} ELSE {_get('line', P.GITLAB_FAILED, 1)} END AS arg FROM ({GITLAB_LOG}) WHERE {_has('line', P.GITLAB_SECTION)} OR {_has('line', P.GITLAB_FAILED)}",
    "c.cmd = 'start'", "WHEN c.cmd = 'end' AND list_contains(stack, c.arg) THEN stack[1:len(stack) - list_position(list_reverse(stack), c.arg)]",
)
_FLAT_NULLS = "CAST(NULL AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS col"
SQL["gitlab_signals"] = f"""{_LAB}
SELECT log_id, line_no AS emit, 'error' AS severity, 'envelope_step_failure' AS kind, {_TOP} AS title, {_FLAT_NULLS}, md5('Job failed: exit code ' || arg) AS body_md5, CAST(1 AS BIGINT) AS n_body, '' AS context, CAST(0 AS BIGINT) AS n_frames,
 'exit_code=' || arg || CASE WHEN {_TOP} <> '' THEN ';step=' || {_TOP} ELSE '' END AS meta FROM f WHERE cmd = 'failed'"""

_ACTIONS = _stacked(
    f"SELECT log_id, line_no, {_get('line', P.GHA_COMMAND, 1)} AS cmd, CASE WHEN {_get('line', P.GHA_COMMAND, 1)} = 'group' THEN {_get('line', P.GHA_COMMAND, 2)} ELSE trim({_get('line', P.GHA_COMMAND, 2)}) END AS arg FROM (SELECT log_id, line_no, regexp_replace(line, '{P.GHA_TIME}', '') AS line FROM ({GHA_LOG})) WHERE line LIKE '##[%'",
    "c.cmd = 'group'", "WHEN c.cmd = 'endgroup' THEN stack[1:len(stack) - 1]",
)


@_add("envelope_signals", f"""{_ACTIONS}
SELECT log_id, line_no AS emit, CASE WHEN cmd = 'error' THEN 'error' ELSE 'warn' END AS severity, CASE WHEN cmd <> 'error' THEN 'envelope_warning' WHEN {_has('arg', P.GHA_EXIT)} THEN 'envelope_step_failure' ELSE 'envelope_error' END AS kind,
 CASE WHEN cmd = 'error' AND {_has('arg', P.GHA_EXIT)} THEN {_TOP} ELSE arg END AS title, arg AS body, CASE WHEN cmd = 'error' AND {_has('arg', P.GHA_EXIT)} THEN 'exit_code=' || {_get('arg', P.GHA_EXIT, 1)} || CASE WHEN {_TOP} <> '' THEN ';step=' || {_TOP} ELSE '' END ELSE '' END AS meta
FROM f WHERE cmd IN ('error', 'warning', 'notice')""")
def envelope_signals(spark, sf_dir):
    found = events_of(envelopes.strip(_sql(spark, sf_dir, GHA_LOG), "github-actions")[1], "envelope").withColumn("text", F.array_join("body", "\n"))
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("log_id", "emit", "severity", "kind", "title", F.col("text").alias("body"), F.coalesce(meta, F.lit("")).alias("meta"))


@_add("envelope_auto", f"SELECT log_id, 'gitlab-ci' AS envelope, count(*) AS n_lines FROM ({SQL['gitlab_strip']}) GROUP BY log_id")
def envelope_auto(spark, sf_dir):
    """A wrapper that is found and taken off, not named."""
    clean, _, names = envelopes.strip(_sql(spark, sf_dir, GITLAB_LOG))
    return clean.groupBy("log_id").agg(F.count("*").alias("n_lines")).join(names, "log_id").select("log_id", "envelope", "n_lines")


_CLEAN = SQL["gitlab_strip"]


@_add("merged_signals", f"""
WITH a AS (SELECT log_id, line_no AS emit, 1 AS rank, {_rules(2, 'line')} AS kind, {_rules(1, 'line')} AS severity, line AS title FROM ({_CLEAN})),
e AS (SELECT log_id, emit, rank, kind, title FROM a WHERE severity = 'error' UNION ALL SELECT log_id, emit, 0, kind, title FROM ({SQL['gitlab_signals']}))
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY emit, rank) AS seq, kind, title FROM e""")
def merged_signals(spark, sf_dir):
    """What a wrapper says and what its log holds, as one sequence of events."""
    return sift(_sql(spark, sf_dir, GITLAB_LOG), SiftOptions(format="generic", envelope="gitlab-ci")).events.select("log_id", "seq", "kind", "title")


#: Wrapped logs whose inner wrappers show only far in: lines of 100 bytes, markers at given lines. At 80 KiB of cleaned text the section of log 1 is
#: seen and wins over the prefixes, that of log 2 isn't yet; log 3 is preceded by two MiB that its outer wrapper drops.
_FAR_LOG = """
SELECT CAST(v AS STRING) AS log_id, n AS line_no, CASE WHEN n = 1 THEN '##[group]Run' WHEN v = 3 AND n <= 20000 THEN rpad('##[debug]', 100, 'd') WHEN n BETWEEN s + 200 AND s + 210 THEN rpad('2024-01-02T03:04:05.678Z web-1  | x', 127, 'y')
 WHEN v = 1 AND n = 700 OR v = 2 AND n = 1100 OR v = 3 AND n = 20700 THEN '2024-01-02T03:04:05.678Z section_start:17:build' ELSE rpad('2024-01-02T03:04:05.678Z plain', 127, 'z') END AS line
FROM (SELECT r_regionkey AS v, CASE WHEN r_regionkey = 3 THEN 20000 ELSE 0 END AS s, (l_partkey - 1) AS n FROM region, (SELECT DISTINCT i AS l_partkey FROM %s) i WHERE r_regionkey BETWEEN 1 AND 3) x WHERE n >= 1 AND n <= s + 2000"""


@_add("envelope_far", "SELECT CAST(r_regionkey AS VARCHAR) AS log_id, CASE r_regionkey WHEN 2 THEN 'github-actions+docker-compose+gitlab-ci' ELSE 'github-actions+gitlab-ci+docker-compose' END AS envelope FROM region WHERE r_regionkey BETWEEN 1 AND 3")
def envelope_far(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("region")
    spark.range(1, 22002).withColumnRenamed("id", "i").createOrReplaceTempView("places")
    return envelopes.strip(spark.sql(_FAR_LOG % "places"))[2]


# Rendering. -----------------------------------------------------------------------------------------------------------

_LABELS = "CASE severity WHEN 'error' THEN 'ERROR' ELSE 'WARN' END"
_FIRSTS = f"SELECT e.*, n, row_number() OVER (PARTITION BY e.log_id ORDER BY e.seq) AS i FROM ({_EVENTS}) e JOIN (SELECT log_id, min(seq) AS seq, count(*) AS n FROM ({_EVENTS}) GROUP BY {_SIG}) d ON d.log_id = e.log_id AND d.seq = e.seq"
_COUNTED = f"SELECT log_id, count(*) AS n_lines FROM ({APP_LOG}) GROUP BY log_id"


def _indented(lines: str, pad: str) -> str:
    return f"array_to_string(list_transform({lines}, lambda x: '{pad}' || x || chr(10)), '')"


@_add("encode_text", f"""
WITH e AS ({_FIRSTS}), t AS (SELECT log_id, count(*) AS k, sum(n) AS n, 'events from generic' || chr(10) || chr(10) || string_agg('[' || i || '] ' || {_LABELS} || ' ' || title || chr(10) || CASE WHEN pos <> '' THEN '  at ' || file || ':' || pos || chr(10) ELSE '' END || '  ' || title || chr(10)
 || CASE WHEN len(context) > 0 THEN '  context:' || chr(10) || {_indented('context', '    ')} ELSE '' END || CASE WHEN n > 1 THEN '  (×' || n || ')' || chr(10) ELSE '' END || chr(10), '' ORDER BY i) AS body FROM e GROUP BY log_id)
SELECT c.log_id, coalesce(body, 'no events found' || chr(10)) || '---' || chr(10) || 'distilled ' || format('{{:,}}', n_lines) || ' lines → ' || format('{{:,}}', coalesce(length(body) - length(replace(body, chr(10), '')), 0)) || ' lines (0 tokens, heuristic)' || chr(10)
 || 'dropped: 0 events, 0 truncated, ' || format('{{:,}}', CAST(coalesce(n - k, 0) AS BIGINT)) || ' deduped, 0 vendor frames' || chr(10) AS text FROM ({_COUNTED}) c LEFT JOIN t ON t.log_id = c.log_id""")
def encode_text(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", dedupe_window=1024).render()


@_add("encode_markdown", f"""
WITH e AS ({_EVENTS}), t AS (SELECT log_id, count(*) AS k, '# events from generic' || chr(10) || chr(10) || string_agg('### [' || seq || '] ' || {_LABELS} || ' ' || title || chr(10) || chr(10) || CASE WHEN pos <> '' THEN '- **Location:** `' || file || ':' || pos || '`' || chr(10) || chr(10) ELSE '' END
 || '```log' || chr(10) || title || chr(10) || '```' || chr(10) || chr(10) || CASE WHEN len(context) > 0 THEN '**Context:**' || chr(10) || chr(10) || '```log' || chr(10) || {_indented('context', '')} || '```' || chr(10) || chr(10) ELSE '' END, '' ORDER BY seq) AS body FROM e GROUP BY log_id)
SELECT c.log_id, coalesce(body, '_no events found_' || chr(10)) || '---' || chr(10) || chr(10) || '- **Lines distilled:** ' || format('{{:,}}', n_lines) || ' → ' || format('{{:,}}', coalesce(length(body) - length(replace(body, chr(10), '')), 0)) || chr(10)
 || '- **Events emitted:** ' || format('{{:,}}', coalesce(k, 0)) || chr(10) || '- **Events dropped:** 0' || chr(10) || '- **Events truncated:** 0' || chr(10) || '- **Events deduped:** 0' || chr(10) || '- **Vendor frames removed:** 0' || chr(10) || '- **Estimated tokens:** 0 (heuristic)' || chr(10) AS text
FROM ({_COUNTED}) c LEFT JOIN t ON t.log_id = c.log_id""")
def encode_markdown(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", output="markdown", fence="log").render()


def _listed(lines: str, pad: str) -> str:
    return f"'[' || chr(10) || array_to_string(list_transform({lines}, lambda x: '{pad}  ' || CAST(to_json(x) AS VARCHAR)), ',' || chr(10)) || chr(10) || '{pad}]'"


_JSON_EVENT = f"""'    {{' || chr(10) || '      "severity": "' || severity || '",' || chr(10) || '      "kind": "' || kind || '",' || chr(10) || '      "title": ' || CAST(to_json(title) AS VARCHAR) || ',' || chr(10)
 || CASE WHEN pos <> '' THEN '      "location": {{' || chr(10) || '        "file": ' || CAST(to_json(file) AS VARCHAR) || ',' || chr(10) || '        "line": ' || pos || ',' || chr(10) || '        "column": ' || coalesce(nullif(col, ''), 'null') || chr(10) || '      }},' || chr(10) ELSE '      "location": null,' || chr(10) END
 || '      "body": ' || {_listed('[title]', '      ')} || ',' || chr(10) || CASE WHEN len(context) > 0 THEN '      "context": ' || {_listed('context', '      ')} || ',' || chr(10) ELSE '' END
 || '      "frames_collapsed": 0,' || chr(10) || '      "count": 1,' || chr(10) || '      "truncated": false' || chr(10) || '    }}'"""


@_add("encode_json", f"""
WITH e AS (SELECT *, {_get('title', P.GENERIC_LOCATION, 3)} AS col FROM ({_EVENTS})), t AS (SELECT log_id, count(*) AS k, string_agg({_JSON_EVENT}, ',' || chr(10) ORDER BY seq) AS body FROM e GROUP BY log_id)
SELECT c.log_id, '{{' || chr(10) || '  "schema_version": 1,' || chr(10) || '  "format": "generic",' || chr(10) || '  "events": ' || coalesce('[' || chr(10) || body || chr(10) || '  ]', '[]') || ',' || chr(10) || '  "summary": {{' || chr(10) || '    "input_lines": ' || n_lines || ',' || chr(10) || '    "output_lines": 0,' || chr(10)
 || '    "events_found": ' || coalesce(k, 0) || ',' || chr(10) || '    "events_emitted": ' || coalesce(k, 0) || ',' || chr(10) || '    "events_deduped": 0,' || chr(10) || '    "events_dropped_budget": 0,' || chr(10) || '    "events_truncated": 0,' || chr(10) || '    "frames_collapsed": 0,' || chr(10)
 || '    "estimated_tokens": 0,' || chr(10) || '    "estimator": "heuristic",' || chr(10) || '    "exit_code": ' || CASE WHEN k > 0 THEN 0 ELSE 1 END || chr(10) || '  }}' || chr(10) || '}}' || chr(10) AS text FROM ({_COUNTED}) c LEFT JOIN t ON t.log_id = c.log_id""")
def encode_json(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", output="json").render()


@_add("count_text", "SELECT l_orderkey, l_linenumber, format('{:,}', l_orderkey * 1009 + l_partkey) AS shown FROM lineitem")
def count_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", encoders.count_text(F.col("l_orderkey") * 1009 + F.col("l_partkey")).alias("shown"))


@_add("tee", f"SELECT log_id, count(*) AS n_events, count(*) AS n_shown FROM ({_EVENTS}) GROUP BY log_id")
def tee(spark, sf_dir):
    """One run gives both its events and its rendering."""
    r = _app_events(spark, sf_dir, severity="warn")
    shown = r.render().select("log_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\[\d+\] (ERROR|WARN) "))).cast("long").alias("n_shown"))
    return r.events.groupBy("log_id").agg(F.count("*").alias("n_events")).join(shown, "log_id").select("log_id", "n_events", "n_shown")


# Whole runs. ----------------------------------------------------------------------------------------------------------

_DETECTED = SQL["detect_winner"]
_RUNNER = _DETECTED[: _DETECTED.index("SELECT log_id, CASE WHEN c.s")]


@_add("detect_report", f"""{_RUNNER}, r AS (SELECT log_id, c.n AS n, c.s AS s, row_number() OVER (PARTITION BY log_id ORDER BY c.s DESC, c.n) AS k FROM c), b AS (SELECT a.log_id, a.n AS n1, a.s AS s1, b.n AS n2, b.s AS s2 FROM r a JOIN r b ON a.log_id = b.log_id AND a.k = 1 AND b.k = 2)
SELECT log_id, 'none' AS envelope, CASE WHEN s1 >= 0.6 THEN n1 ELSE 'generic' END AS format, CAST(CASE WHEN s1 >= 0.6 THEN s1 ELSE 0 END AS DOUBLE) AS confidence, s1 < 0.6 AS fellback_to_generic, CASE WHEN s1 >= 0.6 AND s2 > 0 THEN n2 WHEN s1 < 0.6 AND s1 > 0 THEN n1 END AS runner,
 CAST(CASE WHEN s1 >= 0.6 AND s2 > 0 THEN s2 WHEN s1 < 0.6 AND s1 > 0 THEN s1 END AS DOUBLE) AS runner_confidence, CAST(CASE WHEN s1 >= 0.6 THEN 0 ELSE 1 END AS BIGINT) AS exit_code FROM b""")
def detect_report_query(spark, sf_dir):
    out = detect_report(_sql(spark, sf_dir, MIXED_LOG))
    return out.select("log_id", "envelope", "format", F.col("confidence").cast("double").alias("confidence"), "fellback_to_generic", "runner", F.col("runner_confidence").cast("double").alias("runner_confidence"), F.col("exit_code").cast("long").alias("exit_code"))


_TAGGED = {"gotestsum": ("sum", "gotestsum_blocks"), "jest": ("jest", "jest_blocks"), "pytest": ("py", "pytest_blocks"), "gotest": ("go", "gotest_text")}
_FOUND = " UNION ALL ".join(f"SELECT '{fmt}' AS fmt, '{tag}-' || log_id AS log_id, title, coalesce(file, '') AS file, coalesce(CAST(line AS VARCHAR), '') AS pos FROM ({SQL[name]})" for fmt, (tag, name) in _TAGGED.items())


@_add("distill", f"""
WITH d AS ({_DETECTED}), n AS (SELECT log_id, count(*) AS input_lines FROM ({MIXED_LOG}) GROUP BY log_id),
g AS (SELECT 'generic' AS fmt, log_id, line AS title, {_get('line', P.GENERIC_LOCATION, 1)} AS file, {_get('line', P.GENERIC_LOCATION, 2)} AS pos FROM ({MIXED_LOG}) WHERE {_rules(1, 'line')} IS NOT NULL),
e AS (SELECT * FROM g UNION ALL {_FOUND}), s AS (SELECT e.log_id, count(*) AS found, count(DISTINCT title || '|' || file || ':' || pos) AS kinds FROM e JOIN d ON d.log_id = e.log_id AND d.format = e.fmt GROUP BY e.log_id)
SELECT n.log_id, d.format, 'none' AS envelope, input_lines, coalesce(kinds, 0) AS events_emitted, coalesce(found - kinds, 0) AS events_deduped, CAST(CASE WHEN kinds > 0 THEN 0 ELSE 1 END AS BIGINT) AS exit_code FROM n JOIN d ON d.log_id = n.log_id LEFT JOIN s ON s.log_id = n.log_id""")
def distill(spark, sf_dir):
    """All formats at once: detection, parsing, collapsing, deduplication and summary of mixed logs."""
    out = sift(_sql(spark, sf_dir, MIXED_LOG), SiftOptions(severity="warn", dedupe_window=100_000)).summary
    return out.select("log_id", "format", "envelope", "input_lines", "events_emitted", "events_deduped", F.col("exit_code").cast("long").alias("exit_code"))


_CHAIN_COST = f"CAST(coalesce({_cost('title')} + {_cost('file')} + {_cost('title')} + list_sum(list_transform(context, lambda x: {_cost('x')})), {_cost('title')} * 2 + {_cost('file')}) AS BIGINT)"


@_add("chain", f"""
WITH RECURSIVE e AS (SELECT log_id, seq, severity, title, n, {_CHAIN_COST} AS cost, CAST({_cost('title')} * 2 + {_cost('file')} + {_cost("'" + P.BUDGET_CUT + "'")} AS BIGINT) AS cut FROM ({_FIRSTS})),
o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, seq) AS place FROM e),
f AS (SELECT log_id, CAST(0 AS BIGINT) AS place, CAST({_BUDGET - P.BUDGET_RESERVE} AS BIGINT) AS left_over, '' AS decision FROM (SELECT DISTINCT log_id FROM o)
 UNION ALL SELECT o.log_id, o.place, CASE WHEN left_over <= 0 THEN left_over WHEN cost <= left_over THEN left_over - cost WHEN cut <= left_over THEN left_over - cut ELSE left_over END, CASE WHEN left_over <= 0 THEN 'drop' WHEN cost <= left_over THEN 'keep' WHEN cut <= left_over THEN 'cut' ELSE 'drop' END FROM f JOIN o ON o.log_id = f.log_id AND o.place = f.place + 1),
k AS (SELECT o.log_id, o.title, o.n, f.decision = 'cut' AS truncated, row_number() OVER (PARTITION BY o.log_id ORDER BY o.place) AS seq FROM f JOIN o ON o.log_id = f.log_id AND o.place = f.place WHERE f.decision <> 'drop')
SELECT log_id, seq, title, n AS n_times, truncated FROM k WHERE seq <= 3""")
def chain(spark, sf_dir):
    """Collapsing, deduplication, budget and cap, one after the other."""
    out = _app_events(spark, sf_dir, severity="warn", dedupe_window=1024, budget=_BUDGET, max_events=3).events
    return stages.passthrough(out).select("log_id", "seq", "title", F.col("count").cast("long").alias("n_times"), "truncated")


@_add("concatenated", "SELECT CAST(conv_id AS VARCHAR) AS log_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role)) AS text_md5 FROM conversations GROUP BY conv_id")
def concatenated_query(spark, sf_dir):
    """Several texts read as one log."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("log_id"), F.struct("turn", "role").alias("k"), "text")
    return concatenated(rows).select("log_id", F.md5("text").alias("text_md5"))


@_add("whole_logs", """
SELECT CAST(doc_id AS VARCHAR) AS log_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS input_lines, md5(text) AS text_md5, CAST(CASE WHEN text = '' THEN 1 ELSE 0 END AS BIGINT) AS exit_code
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE text <> ''""")
def whole_logs(spark, sf_dir):
    """Logs in which nothing is found are passed on as they are, whatever their line ends, and that is a success."""
    one = CustomFormat("none", "x", "^\x07no such line\x07$")
    r = sift_logs(_documents(spark, sf_dir).select(F.col("doc_id").alias("log_id"), "text"), SiftOptions(format=one.id, envelope="none", passthrough=True, formats=(one,)))
    out = r.render().join(r.summary.select("log_id", "input_lines", "exit_code"), "log_id")
    return out.where("input_lines > 0").select("log_id", "input_lines", F.md5("text").alias("text_md5"), F.col("exit_code").cast("long").alias("exit_code"))


@_add("oversized_line", "SELECT CAST(r_regionkey AS VARCHAR) AS log_id, CAST(r_regionkey + 2 AS BIGINT) AS input_lines, CAST(r_regionkey AS BIGINT) AS events_emitted, CAST(CASE WHEN r_regionkey = 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM region")
def oversized_line(spark, sf_dir):
    """A line of 1 MiB ends its log, but the lines after it count as read; a log that starts with it, or is empty, has no event."""
    text = "concat(repeat('ERROR x\n', cast(r_regionkey as int)), repeat('y', 1048576), '\nERROR late')"
    logs = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("log_id"), F.expr(text).alias("text"))
    return sift_logs(logs, SiftOptions(format="generic", envelope="none")).summary.select("log_id", "input_lines", "events_emitted", F.col("exit_code").cast("long").alias("exit_code"))


# Parts of parsers. ----------------------------------------------------------------------------------------------------

_PAINTED = f"SELECT log_id, line_no, chr(27) || '[1;3' || CAST(line_no % 8 AS STRING) || 'm' || line || chr(27) || '[0m' || chr(27) || '[K' AS line FROM ({APP_LOG}) p"


@_add("strip_ansi", f"SELECT log_id, line_no, line || chr(27) || '[K' AS line FROM ({APP_LOG})")
def strip_ansi_query(spark, sf_dir):
    return _sql(spark, sf_dir, _PAINTED).select("log_id", "line_no", strip_ansi(F.col("line")).alias("line"))


_TRACE = """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS i, CASE l_linenumber % 7 WHEN 0 THEN 'plain text' WHEN 1 THEN '  File "app/m' || CAST(l_suppkey AS STRING) || '.py", line ' || CAST(l_partkey AS STRING) || ', in run'
  WHEN 2 THEN '    at org.x.Main.go(Main.java:' || CAST(l_partkey AS STRING) || ')' WHEN 3 THEN 'main.work(0xc000)' WHEN 4 THEN chr(9) || '/src/a' || CAST(l_suppkey AS STRING) || '.go:' || CAST(l_partkey AS STRING) || ' +0x1d'
  WHEN 5 THEN '      at Object.fn (src/a.js:' || CAST(l_partkey AS STRING) || ':7)' ELSE 'tests/test_b.py:' || CAST(l_partkey AS STRING) || ': in helper' END AS line FROM lineitem"""
_BARE = "trim(before, ' ' || chr(9))"
_FRAME_OF = {
    "generic": f"CASE WHEN {_has('line', P.PYTHON_FRAME)} THEN {{'f': {_get('line', P.PYTHON_FRAME, 1)}, 'l': {_get('line', P.PYTHON_FRAME, 2)}, 'c': {_get('line', P.PYTHON_FRAME, 3)}}} WHEN {_has('line', P.JVM_FRAME)} THEN {{'f': {_get('line', P.JVM_FRAME, 2)}, 'l': {_get('line', P.JVM_FRAME, 3)}, 'c': {_get('line', P.JVM_FRAME, 1)}}} END",
    "panic": f"CASE WHEN {_has('line', P.GO_TAIL)} THEN {{'f': {_get('line', P.GO_TAIL, 1)}, 'l': {_get('line', P.GO_TAIL, 2)}, 'c': CASE WHEN before IS NULL THEN '' WHEN instr({_BARE}, '(') > 1 THEN split_part({_BARE}, '(', 1) ELSE {_BARE} END}} END",
    "gotest": f"CASE WHEN {_has('line', P.GO_TEST_TAIL)} THEN {{'f': {_get('line', P.GO_TEST_TAIL, 1)}, 'l': {_get('line', P.GO_TEST_TAIL, 2)}, 'c': CASE WHEN before IS NULL THEN '' WHEN {_has(_BARE, P.GO_CALL)} THEN {_get(_BARE, P.GO_CALL, 1)} ELSE {_BARE} END}} END",
    "jest": f"CASE WHEN {_has('line', P.JEST_FRAME)} THEN {{'f': {_get('line', P.JEST_FRAME, 2)}, 'l': {_get('line', P.JEST_FRAME, 3)}, 'c': {_get('line', P.JEST_FRAME, 1)}}} END",
    "pytest": f"CASE WHEN {_has('ltrim(line)', P.PY_SHORT_FRAME)} THEN {{'f': {_get('ltrim(line)', P.PY_SHORT_FRAME, 1)}, 'l': {_get('ltrim(line)', P.PY_SHORT_FRAME, 2)}, 'c': {_get('ltrim(line)', P.PY_SHORT_FRAME, 3)}}} WHEN {_has('line', P.PY_LONG_FRAME)} THEN {{'f': {_get('line', P.PY_LONG_FRAME, 1)}, 'l': {_get('line', P.PY_LONG_FRAME, 2)}, 'c': {_get('line', P.PY_LONG_FRAME, 3)}}} END",
}
_BY_LINE = f"SELECT *, lag(line) OVER (PARTITION BY l_orderkey ORDER BY i) AS before FROM ({_TRACE})"


@_add("frames", " UNION ALL ".join(f"SELECT '{fmt}' AS of, l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS BIGINT) AS k, r.f AS file, CAST(r.l AS BIGINT) AS line, r.c AS function FROM (SELECT l_orderkey, i, {frame} AS r FROM ({_BY_LINE})) WHERE r IS NOT NULL{' AND CAST(r.l AS BIGINT) > 0' * (fmt in ('generic', 'panic', 'gotest'))}" for fmt, frame in _FRAME_OF.items()))
def frames(spark, sf_dir):
    """Frames of all parsers out of the same bodies."""
    bodies = _sql(spark, sf_dir, _TRACE).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("body"))
    none = F.lit(None).cast("map<string,string>")
    out = None
    for name, fmt, kind in (("generic", "generic", "traceback"), ("panic", "generic", "panic"), ("gotest", "gotest", "panic"), ("jest", "jest", "test_failure"), ("pytest", "pytest", "test_failure")):
        made = PROJECTIONS[fmt](bodies.withColumns({"header": F.lit("h"), "kind": F.lit(kind), "severity": F.lit("error"), "attrs": none, "context": F.array().cast("array<string>")}))
        one = made.select(F.lit(name).alias("of"), F.col("l_orderkey").alias("o"), F.posexplode("frames").alias("k", "f")).select("of", "o", (F.col("k") + 1).cast("long").alias("k"), "f.file", F.col("f.line").cast("long").alias("line"), F.coalesce("f.function", F.lit("")).alias("function"))
        out = one if out is None else out.unionByName(one)
    return out


@_add("jest_kinds", f"""
SELECT o_orderkey AS o, CASE o_orderkey % 4 WHEN 0 THEN 'suite_error' WHEN 1 THEN 'snapshot_mismatch' WHEN 2 THEN 'snapshot_mismatch' ELSE 'test_failure' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'Error: no module' WHEN 1 THEN 'Snapshot mismatch: cart ' || o_orderkey WHEN 2 THEN 'Snapshot mismatch' ELSE 'Error: no module' END AS title,
 CAST(CASE WHEN o_orderkey % 4 IN (1, 2) THEN least(200, 4 + o_custkey % 400) ELSE 4 + o_custkey % 400 END AS BIGINT) AS n_body, CASE WHEN o_orderkey % 4 IN (1, 2) AND 4 + o_custkey % 400 > 200 THEN '{P.JEST_SNAPSHOT_CUT}' WHEN o_custkey % 400 > 0 THEN 'line ' || (o_custkey % 400) ELSE '    Snapshot name: `cart ' || o_orderkey || '`' END AS last,
 concat_ws(';', CASE o_orderkey % 4 WHEN 1 THEN 'snapshot_kind=file' WHEN 2 THEN 'snapshot_kind=inline' END, CASE WHEN o_orderkey % 4 IN (1, 2) AND 4 + o_custkey % 400 > 200 THEN 'snapshot_truncated=true' END, 'suite_file=src/a.test.js', CASE WHEN o_orderkey % 4 > 0 THEN 'test_id=cart > t' END) AS meta FROM orders""")
def jest_kinds(spark, sf_dir):
    """Snapshot mismatches, in files and inline, with their cap, and suites that failed as a whole."""
    o, n = F.col("o_orderkey"), (F.col("o_custkey") % 400).cast("int")
    said = F.when(o % 4 == 1, "    expect(x).toMatchSnapshot()").when(o % 4 == 2, "    expect(x).toMatchInlineSnapshot(`a`)").otherwise("    plain")
    head = F.array(F.lit("  ● cart"), said, F.lit("    Error: no module"), F.concat(F.lit("    Snapshot name: `cart "), o.cast("string"), F.lit("`")))
    body = F.when(n > 0, F.concat(head, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("line "), i.cast("string"))))).otherwise(head)
    header = F.when(o % 8 == 0, "Test suite failed to run").when(o % 8 == 4, "src/a.test.js").otherwise("cart › t")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        o.alias("o"), header.alias("header"), body.alias("body"), F.lit("test_failure").alias("kind"), F.lit("error").alias("severity"), F.create_map(F.lit("suite_file"), F.lit("src/a.test.js")).alias("attrs"), F.array().cast("array<string>").alias("context")
    )
    out = PROJECTIONS["jest"](rows)
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("o", "kind", "title", F.size("body").cast("long").alias("n_body"), F.element_at("body", -1).alias("last"), meta.alias("meta"))


@_add("detect_floor", f"""
WITH s AS (SELECT log_id, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS s FROM ({PYTEST_LOG}) GROUP BY log_id)
SELECT log_id, CAST(CASE WHEN {_has(f'left(s, {P.SAMPLE_BYTES})', P.DETECT_GENERIC)} THEN 0.1 ELSE 0 END AS DOUBLE) AS generic, CAST(CASE WHEN {_has(f'left(s, {P.SAMPLE_BYTES})', '(?m)^tests/test_a[.]py:5')} THEN 1 ELSE 0 END AS DOUBLE) AS own FROM s""")
def detect_floor(spark, sf_dir):
    """Scores of the fallback, which never wins, and of a custom format."""
    one = CustomFormat("mine", "(?m)^tests/test_a[.]py:5", "x")
    return samples(_sql(spark, sf_dir, PYTEST_LOG), P.SAMPLE_BYTES).select("log_id", detection.generic_score(F.col("sample")).cast("double").alias("generic"), one.detect(F.col("sample")).cast("double").alias("own"))


@_add("formats", "SELECT * FROM (VALUES ('custom:mine', 1), ('generic', 2), ('gotest', 3), ('gotestsum', 4), ('jest', 5), ('pytest', 6), ('shout', 7)) t(name, k)")
def formats(spark, sf_dir):
    """What listing shows when a program has registered a format and a configuration defines one."""
    detection.register_format(_SHOUT)
    try:
        rows = [(x.split("\t")[0], k) for k, x in enumerate(detection.list_formats([CustomFormat("mine", "x", "y")]), 1)]
    finally:
        detection.unregister_format(_SHOUT.name)
    return spark.createDataFrame(rows, "name string, k int")


def _shouts(lines):
    from .operators.formats.segments import blocks

    found = lines.where(F.col("line").startswith("ERROR")).select("log_id", F.col("line_no").alias("emit"), F.array("line").alias("body"), "line")
    return blocks(found, "shout", F.lit("shout"), F.lit("error"), F.upper("line"))


_SHOUT = detection.Format("shout", lambda s: F.when(s.contains("ERROR svc"), 1.0).otherwise(0.0), _shouts)


@_add("registered_format", f"SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq, upper(line) AS title FROM ({APP_LOG}) WHERE line LIKE 'ERROR%'")
def registered_format(spark, sf_dir):
    """A format that a program brings: it is asked for by name, parsed and projected as its own."""
    detection.register_format(_SHOUT)
    try:
        return sift(_sql(spark, sf_dir, APP_LOG), SiftOptions(format="shout", envelope="none")).events.select("log_id", "seq", "title")
    finally:
        detection.unregister_format(_SHOUT.name)


@_add("custom_defaults", f"SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq, 'error' AS severity, 'match' AS kind, line AS title FROM ({APP_LOG}) WHERE {_has('line', '^WARN')}")
def custom_defaults(spark, sf_dir):
    """Settings that a configuration leaves empty mean their defaults."""
    config = parse_config('schema_version = 1\n[[custom_formats]]\nname = "w"\ndetect_regex = "x"\nevent_start = "^WARN"\nevent_end = ""\nseverity = ""\nkind = ""\n')
    r = sift(_sql(spark, sf_dir, APP_LOG), apply_config(SiftOptions(format="custom:w", envelope="none"), config))
    return r.events.select("log_id", "seq", "severity", "kind", "title")


# Options. -------------------------------------------------------------------------------------------------------------


@_add("dedupe_flags", "SELECT d, n, w, CASE WHEN n = 1 THEN 0 WHEN w >= 0 THEN w WHEN d = 1 THEN 1024 ELSE 0 END AS size FROM (SELECT unnest([0, 1]) AS d), (SELECT unnest([0, 1]) AS n), (SELECT unnest([-1, 0, 7]) AS w)")
def dedupe_flags(spark, sf_dir):
    return spark.createDataFrame([(d, n, w, dedupe_window(bool(d), bool(n), w)) for d in (0, 1) for n in (0, 1) for w in (-1, 0, 7)], "d int, n int, w int, size int")


_CONFIG = 'schema_version = 1\ndefault_budget = 900\ndefault_severity = "warn"\n[formats.generic]\ndedupe_window = 5\ndefault_max_events = 2\n[formats.jest]\ndefault_max_events = 9\n'


@_add("config_by_format", f"""
WITH d AS ({_DETECTED}), e AS (SELECT log_id, count(*) AS n FROM ({_EVENTS}) GROUP BY log_id)
SELECT 'app-' || e.log_id AS log_id, least(2, n) AS n_events FROM e JOIN d ON d.log_id = 'app-' || e.log_id WHERE d.format = 'generic'
UNION ALL SELECT 'jest-' || j.log_id, least(9, n) FROM (SELECT log_id, count(*) AS n FROM ({SQL['jest_blocks']}) GROUP BY log_id) j JOIN d ON d.log_id = 'jest-' || j.log_id WHERE d.format = 'jest'""")
def config_by_format(spark, sf_dir):
    """Values of a configuration for one format hold for the logs that are detected as such."""
    options = apply_config(SiftOptions(), parse_config(_CONFIG.replace("default_budget = 900\n", "").replace("dedupe_window = 5\n", "")))
    lines = _sql(spark, sf_dir, MIXED_LOG).where("log_id like 'app-%' or log_id like 'jest-%'")
    return sift(lines, options).events.where("log_id like 'app-%' or log_id like 'jest-%'").groupBy("log_id").agg(F.count("*").alias("n_events"))


@_add("options_resolved", """SELECT * FROM (VALUES ('auto', 900, 'warn', 0, 0), ('generic', 900, 'warn', 5, 2), ('jest', 900, 'warn', 0, 9), ('gotest', 900, 'warn', 0, 0), ('generic, given', 7, 'warn', 5, 2)) t(of, budget, severity, dedupe_window, max_events)""")
def options_resolved(spark, sf_dir):
    """What was given wins over values for the format, and these over those for all."""
    config = parse_config(_CONFIG)
    auto = apply_config(SiftOptions(), config)
    cases = {"auto": auto, "generic": auto.of("generic"), "jest": auto.of("jest"), "gotest": auto.of("gotest"), "generic, given": apply_config(SiftOptions(format="generic", budget=7), config, {"budget"})}
    return spark.createDataFrame([(k, o.budget, o.severity, o.dedupe_window, o.max_events) for k, o in cases.items()], "of string, budget int, severity string, dedupe_window int, max_events int")


@_add("exit_codes", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 > 1 OR l_suppkey % 4 > 2 THEN 3 WHEN l_quantity <= 5 THEN 1 ELSE 0 END AS code, l_partkey % 3 > 1 OR l_suppkey % 4 > 2 AS forced FROM lineitem")
def exit_codes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({
        "events_emitted": F.when(F.col("l_quantity") <= 5, 0).otherwise(1), "events_dropped_budget": F.greatest(F.col("l_partkey") % 3 - 1, F.lit(0)), "events_truncated": F.greatest(F.col("l_suppkey") % 4 - 2, F.lit(0))
    })
    code = summaries.exit_code(F.col("events_emitted"), F.col("events_dropped_budget"), F.col("events_truncated"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code"), summaries.forced_drops(rows).alias("forced"))


@_add("severity_floor", f"SELECT f, count(*) AS n FROM ({_ANCHORS}), (SELECT unnest(['error', 'warn', 'info']) AS f) WHERE severity = 'error' OR severity = 'warn' AND f <> 'error' GROUP BY f")
def severity_floor(spark, sf_dir):
    """Anchors by the severity from which they count; keeping warnings lowers it to warn at most."""
    out = None
    for name, options in (("error", SiftOptions()), ("warn", SiftOptions(keep_warnings=True)), ("info", SiftOptions(severity="info", keep_warnings=True))):
        one = generic.anchors(_sql(spark, sf_dir, APP_LOG), options.least).agg(F.count("*").alias("n")).select(F.lit(name).alias("f"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_add("line_counts", "SELECT page_id, CAST(length(html) - length(replace(html, chr(10), '')) + CASE WHEN html <> '' AND right(html, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n FROM pages")
def line_counts(spark, sf_dir):
    """Lines split and counted agree."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    split = lines_of(pages, "page_id", "html").groupBy("log_id").agg(F.count("*").alias("n"))
    return pages.select(F.col("page_id").cast("string").alias("log_id"), "page_id", input_lines(F.col("html")).alias("told")).join(split, "log_id", "left").select("page_id", F.when(F.coalesce("n", F.lit(0)) == F.col("told"), F.col("told")).alias("n"))
