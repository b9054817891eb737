"""Queries over the test tables, one per operator or family, with the same query in SQL where SQL can say it.

No table holds logs, so logs are made from ``events``, ``orders`` and ``lineitem`` by SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions.text import estimate
from .operators import detection, encoders, envelopes, stages
from .operators.folding import fold_logs
from .operators.formats import generic, gotest, gotestsum, jest, pytest
from .operators.formats.custom import CustomFormat
from .operators.projection import events_of
from .plans.engine import Result, sift
from .plans.options import SiftOptions
from .sources.logs import input_lines, lines_of, samples
from .streaming.folds import GenericFold

# Logs. ----------------------------------------------------------------------------------------------------------------

APP_LOG = """
SELECT CAST(user_id AS STRING) AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
 CASE WHEN event_type = 'error' THEN 'ERROR svc/mod' || CAST(event_id % 7 AS STRING) || '.py:' || CAST(event_id % 90 + 1 AS STRING) || ': request failed'
  WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'WARN quota ' || CAST(event_id % 5 AS STRING) || ' reached at C:\\app\\q.cs:12:4'
  WHEN event_type = 'purchase' AND event_id % 13 = 0 THEN 'worker: ValueError: bad amount ' || CAST(event_id % 4 AS STRING)
  ELSE 'INFO ' || event_type || ' ' || CAST(event_id AS STRING) END AS line
FROM events"""

PANIC_LOG = """
SELECT CAST(user_id AS STRING) AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
 CASE WHEN event_id % 17 = 0 THEN 'Traceback (most recent call last):' WHEN event_id % 19 = 0 THEN 'panic: boom ' || CAST(event_id AS STRING)
  WHEN event_id % 5 = 0 THEN '  File "app/m' || CAST(event_id % 6 AS STRING) || '.py", line ' || CAST(event_id % 50 + 1 AS STRING) || ', in run'
  WHEN event_id % 5 = 1 THEN 'main.work(0xc000)' WHEN event_id % 5 = 2 THEN 'ValueError: bad ' || CAST(event_id % 3 AS STRING)
  WHEN event_id % 7 = 0 THEN '' WHEN event_type = 'error' THEN 'ERROR late' ELSE 'INFO ok' END AS line
FROM events"""


def _tests(case: str, parts: int) -> str:
    """One log per 40 customers; each order is a test of so many lines."""
    ks = " UNION ALL ".join(f"SELECT {k} AS k" for k in range(1, parts + 1))
    return f"""
SELECT CAST(b AS STRING) AS log_id, row_number() OVER (PARTITION BY b ORDER BY o, k) AS line_no, {case} AS line
FROM (SELECT o_custkey % 40 AS b, o_orderkey AS o, o_orderstatus AS s, CAST(o_orderkey AS STRING) AS t, k FROM orders, ({ks}) ks) x"""


SUM_LOG = _tests(
    """CASE WHEN k = 1 AND s = 'F' THEN CASE WHEN o % 3 = 0 THEN '=== FAIL: shop/cart Test' || t || ' (0.0' || CAST(o % 9 AS STRING) || 's)' WHEN o % 3 = 1 THEN '=== FAIL: shop/cart.Test' || t ELSE '=== FAIL: shop/tax' END
  WHEN k = 1 THEN 'ok shop ' || t WHEN k = 2 AND o % 4 = 0 THEN '    cart_test.go:' || CAST(o % 80 + 1 AS STRING) || ': want ' || t || ' got 0' WHEN k = 2 AND o % 4 = 1 THEN ''
  WHEN k = 2 THEN 'note build failed ' || t WHEN o % 10 = 0 THEN 'DONE 3 tests, 1 failure in 0.2s' ELSE '  log ' || t END""", 3,
)
SUM_ONLY_LOG = _tests("CASE WHEN k = 1 THEN 'ok shop ' || t WHEN o % 5 = 0 THEN 'DONE ' || t || ' tests, 2 errors' WHEN o % 7 = 0 THEN 'DONE 9 tests' ELSE 'note' END", 2)
JEST_LOG = _tests(
    """CASE WHEN k = 1 AND o % 6 = 0 THEN CASE WHEN s = 'F' THEN 'FAIL' ELSE 'PASS' END || ' src/a' || CAST(o % 5 AS STRING) || '.test.js' WHEN k = 1 AND s = 'F' THEN '  ● cart › adds ' || t
  WHEN k = 1 THEN '  console.log x' WHEN k = 2 AND o % 2 = 0 THEN '    expect(received).toBe(expected) ' || t WHEN k = 2 AND o % 5 = 0 THEN '    ✓ fine' WHEN k = 2 THEN '    Expected: ' || t
  WHEN k = 3 AND o % 3 = 0 THEN '      at Object.fn (src/a.js:' || CAST(o % 70 + 1 AS STRING) || ':' || CAST(o % 9 + 1 AS STRING) || ')' WHEN k = 3 AND o > 40000 THEN 'Tests:       3 failed' ELSE '' END""", 3,
)
PYTEST_LOG = _tests(
    """CASE WHEN k = 1 AND o % 9 = 0 THEN '=== FAILURES ===' WHEN k = 1 AND o % 14 = 0 THEN '=== ERRORS ===' WHEN k = 1 AND o % 22 = 0 THEN '=== warnings summary ===' WHEN k = 1 AND o % 25 = 0 THEN '=== short test summary info ==='
  WHEN k = 1 AND o % 31 = 0 THEN '=== slowest durations ===' WHEN k = 1 AND s = 'F' THEN '____ test_' || t || ' ____' WHEN k = 2 AND o % 3 = 0 THEN 'E   AssertionError: ' || t
  WHEN k = 2 AND o % 4 = 0 THEN 'tests/test_a.py:' || CAST(o % 60 AS STRING) WHEN k = 2 AND o % 4 = 1 THEN '  UserWarning: old ' || t WHEN k = 3 AND o % 2 = 0 THEN 'tests/test_b.py:' || CAST(o % 60 + 1 AS STRING) || ': AssertionError' ELSE '    pass' END""", 3,
)
GO_JSON_LOG = _tests(
    """CASE WHEN k = 1 AND o % 23 = 0 THEN 'not json' WHEN k = 1 THEN '{"Time":"t","Action":"run","Package":"shop","Test":"T' || CAST(o % 6 AS STRING) || '"}'
  WHEN k = 2 AND o % 11 = 0 THEN '{"Action":"output","Package":"shop","Output":"cart.go:' || CAST(o % 30 + 1 AS STRING) || ':7: undefined: x\\n"}' WHEN k = 2 AND o % 5 = 0 THEN '{"Action":"output","Package":"shop","Test":"T' || CAST(o % 6 AS STRING) || '","Output":"=== RUN T\\n"}'
  WHEN k = 2 THEN '{"Action":"output","Package":"shop","Test":"T' || CAST(o % 6 AS STRING) || '","Output":"    c_test.go:' || CAST(o % 30 + 1 AS STRING) || ': bad ' || t || '\\n"}'
  WHEN o % 3 = 0 THEN '{"Action":"fail","Package":"shop","Test":"T' || CAST(o % 6 AS STRING) || '"}' WHEN o % 3 = 1 THEN '{"Action":"pass","Package":"shop","Test":"T' || CAST(o % 6 AS STRING) || '"}' ELSE '{"Action":"cont"}' END""", 3,
)
GO_LOG = _tests(
    """CASE WHEN k = 1 AND o % 21 = 0 THEN 'panic: nil map ' || t WHEN k = 1 AND o % 27 = 0 THEN '==================' WHEN k = 1 THEN '=== RUN   Test' || t WHEN k = 2 AND o % 15 = 0 THEN 'cart.go:' || CAST(o % 30 + 1 AS STRING) || ':2: undefined: y'
  WHEN k = 2 THEN '    c_test.go:' || CAST(o % 30 + 1 AS STRING) || ': bad ' || t WHEN k = 3 AND s = 'F' THEN '--- FAIL: Test' || t || ' (0.01s)' WHEN k = 3 THEN '--- PASS: Test' || t || ' (0.00s)'
  WHEN o % 8 = 0 THEN 'FAIL' || chr(9) || 'shop/cart' || chr(9) || '0.2s' WHEN o % 24 = 1 THEN 'ok  ' || chr(9) || 'shop/tax' || chr(9) || '0.1s' WHEN o % 24 = 2 THEN 'exit status 1' WHEN o % 24 = 3 THEN 'FAIL' || chr(9) || 'shop/x [build failed]' WHEN o % 24 = 4 THEN '=== CONT  Test' || t ELSE '        more ' || t END""", 4,
)
MIXED_LOG = f"""
SELECT 'sum-' || log_id AS log_id, line_no, line FROM ({SUM_LOG}) a UNION ALL SELECT 'jest-' || log_id, line_no, line FROM ({JEST_LOG}) b
UNION ALL SELECT 'py-' || log_id, line_no, line FROM ({PYTEST_LOG}) c UNION ALL SELECT 'go-' || log_id, line_no, line FROM ({GO_LOG}) d UNION ALL SELECT 'app-' || log_id, line_no, line FROM ({APP_LOG}) e"""
COMPOSE_LOG = f"""
SELECT log_id, line_no, CASE WHEN line_no <= 2 THEN 'Pulling image' WHEN line_no % 5 = 0 THEN line ELSE 'svc-' || CAST(line_no % 3 + 1 AS STRING) || '  | ' || line END AS line FROM ({APP_LOG}) a"""
GHA_LOG = f"""
SELECT log_id, line_no, CASE WHEN line_no % 9 = 1 THEN '##[group]Run step ' || CAST(line_no AS STRING) WHEN line_no % 9 = 7 THEN '##[endgroup]' WHEN line_no % 11 = 0 THEN '##[error]Process completed with exit code ' || CAST(line_no % 4 AS STRING) || '.'
  WHEN line_no % 13 = 0 THEN '2024-01-02T03:04:05.678Z ##[warning]old node' WHEN line_no % 17 = 0 THEN '::add-path::x' ELSE '2024-01-02T03:04:05.678Z ' || line END AS line FROM ({APP_LOG}) a"""
GITLAB_LOG = f"""
SELECT log_id, line_no, CASE WHEN line_no % 9 = 1 THEN 'section_start:17:step_' || CAST(line_no % 4 AS STRING) WHEN line_no % 9 = 7 THEN 'section_end:18:step_' || CAST(line_no % 4 AS STRING)
  WHEN line_no % 23 = 0 THEN 'ERROR: Job failed: exit code ' || CAST(line_no % 4 AS STRING) ELSE '2024-01-02T03:04:05.678Z 01O ' || line END AS line FROM ({APP_LOG}) a"""
NESTED_LOG = f"""
SELECT log_id, line_no, CASE WHEN log_id LIKE '%1' THEN line WHEN log_id LIKE '%2' THEN '2024-01-02T03:04:05.678Z svc-1  | ' || line ELSE 'web-1  | ' || line END AS line FROM ({APP_LOG}) a"""

TABLES = ("events", "orders", "lineitem", "documents", "conversations", "pages")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text.replace("\\", "\\\\"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _flat(events: DataFrame, order: str = "seq") -> DataFrame:
    """Events as scalars."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map()))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return events.select(
        "log_id", order, "severity", "kind", "title", F.col("location.file").alias("file"), F.col("location.line").cast("long").alias("line"), F.col("location.column").cast("long").alias("col"), F.md5(F.array_join("body", "\n")).alias("body_md5"),
        F.size("body").cast("long").alias("n_body"), F.array_join("context", "\n").alias("context"), F.size("frames").cast("long").alias("n_frames"), meta.alias("meta"),
    )


def _blocks(parse, log: str, fmt: str, kinds: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _flat(events_of(parse(_sql(spark, sf_dir, log)), fmt).drop("rank"), "emit")
        return out.select("log_id", "emit", "kind", "title", "file", "line", "n_body", "body_md5", "meta")

    return query


def _q(text: str) -> str:
    return text.replace("'", "''")


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{_q(pattern)}')"


def _get(column: str, pattern: str, k: int) -> str:
    return f"regexp_extract({column}, '{_q(pattern)}', {k})"


# Queries. -------------------------------------------------------------------------------------------------------------

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_WORDS, _SYMBOLS = r"[\p{L}\p{Nd}]+", r"[^\p{L}\p{Nd}\t\n\x0B\f\r \x{0085}\p{Z}]+"


def _cost(column: str) -> str:
    return f"CAST(floor((len(regexp_extract_all({column}, '{_WORDS}')) * CAST(1.3 AS DOUBLE) + len(regexp_extract_all({column}, '{_SYMBOLS}'))) * CAST(1.1 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


@_add("tokens_documents", f"SELECT doc_id, {_cost('text')} AS tokens FROM documents")
def tokens_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", estimate(F.col("text")).alias("tokens"))


@_add("tokens_conversations", f"SELECT conv_id, turn, role, {_cost('text')} AS tokens FROM conversations")
def tokens_conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", estimate(F.col("text")).alias("tokens"))


@_add("input_lines", "SELECT page_id, CAST(length(html) - length(replace(html, chr(10), '')) + CASE WHEN html <> '' AND right(html, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM pages")
def input_lines_query(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", input_lines(F.col("html")).alias("n_lines"))


_DOC_LINES = "SELECT log_id, i AS line_no, l[i] AS line FROM (SELECT CAST(doc_id AS VARCHAR) AS log_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents))"


@_add("document_lines", f"SELECT log_id, CAST(line_no AS BIGINT) AS line_no, md5(CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END) AS line_md5 FROM ({_DOC_LINES})")
def document_lines(spark, sf_dir):
    return lines_of(_documents(spark, sf_dir), "doc_id").select("log_id", "line_no", F.md5("line").alias("line_md5"))


def _rules(value: int, plain: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(plain, rule[0])} THEN '{rule[value]}'" for rule in P.CATALOGUE) + " END"


_ANCHORS = f"SELECT log_id, line_no, line, {_rules(1, 'line')} AS severity, {_rules(2, 'line')} AS kind FROM ({APP_LOG})"


@_add("anchors", f"SELECT log_id, line_no, severity, kind FROM ({_ANCHORS}) WHERE severity IS NOT NULL")
def anchors(spark, sf_dir):
    return generic.anchors(_sql(spark, sf_dir, APP_LOG), "warn").select("log_id", "line_no", "severity", "kind")


@_add("anchor_context", f"""
WITH a AS ({_ANCHORS}), w AS (SELECT *, list(line) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pre, list(line) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS post,
 min(CASE WHEN severity = 'error' THEN line_no END) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - line_no AS gap FROM a)
SELECT log_id, line_no AS emit, kind, line AS title, nullif({_get('line', P.GENERIC_LOCATION, 1)}, '') AS file, CAST(nullif({_get('line', P.GENERIC_LOCATION, 2)}, '') AS BIGINT) AS line,
 array_to_string(list_concat(coalesce(pre, []), coalesce(post, [])[1:coalesce(gap, 3)]), chr(10)) AS context FROM w WHERE severity = 'error'""")
def anchor_context(spark, sf_dir):
    out = _flat(events_of(generic.with_context(_sql(spark, sf_dir, APP_LOG)), "generic"), "emit")
    return out.select("log_id", "emit", "kind", "title", "file", "line", "context")


_CUSTOM = CustomFormat("prose", "(?m)^The ", r"^[A-E]", r"^[R-Z]", "warn", "passage")


@_add("custom_blocks", f"""
WITH m AS (SELECT *, {_has('line', _CUSTOM.event_start)} AS s FROM ({_DOC_LINES})), i AS (SELECT *, sum(s::INT) OVER (PARTITION BY log_id ORDER BY line_no) AS g FROM m),
e AS (SELECT *, min(CASE WHEN NOT s AND {_has('line', _CUSTOM.event_end)} THEN line_no END) OVER (PARTITION BY log_id, g) AS z FROM i WHERE g > 0)
SELECT log_id, CAST(min(line_no) AS BIGINT) AS emit, 'passage' AS kind, CAST(count(*) AS BIGINT) AS n_body, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body_md5 FROM e WHERE z IS NULL OR line_no <= z GROUP BY log_id, g""")
def custom_blocks(spark, sf_dir):
    return _flat(events_of(_CUSTOM.parse(lines_of(_documents(spark, sf_dir), "doc_id")), "custom"), "emit").select("log_id", "emit", "kind", "n_body", "body_md5")


@_add("custom_lines", f"SELECT log_id, CAST(line_no AS BIGINT) AS emit, md5(line) AS body_md5 FROM ({_DOC_LINES}) WHERE {_has('line', '^[A-E]')}")
def custom_lines(spark, sf_dir):
    one = CustomFormat("starts", "x", r"^[A-E]")
    return _flat(events_of(one.parse(lines_of(_documents(spark, sf_dir), "doc_id")), "custom"), "emit").select("log_id", "emit", "body_md5")


_MD5 = "md5(string_agg(line, chr(10) ORDER BY line_no))"
QUERIES["gotestsum_blocks"] = _blocks(gotestsum.parse, SUM_LOG, "gotestsum")
SQL["gotestsum_blocks"] = f"""
WITH m AS (SELECT *, {_has('line', P.SUM_FAIL)} AS f, {_has('line', P.SUM_FAIL)} OR line LIKE 'DONE %' AS b FROM ({SUM_LOG})), i AS (SELECT *, sum(b::INT) OVER (PARTITION BY log_id ORDER BY line_no) AS g FROM m),
x AS (SELECT log_id, min(line_no) AS emit, arg_min(f, line_no) AS f, arg_min(line, line_no) AS head, count(*) AS n_body, {_MD5} AS body_md5, arg_min(CASE WHEN NOT b AND trim(line) <> '' THEN line END, CASE WHEN NOT b AND trim(line) <> '' THEN line_no END) AS said FROM i WHERE g > 0 GROUP BY log_id, g),
p AS (SELECT *, trim({_get('head', P.SUM_FAIL, 1)}) AS subject, {_get('head', P.SUM_FAIL, 2)} AS duration, {_has('said', P.SUM_LOCATION)} AS located FROM x WHERE f),
q AS (SELECT *, CASE WHEN subject LIKE '% %' THEN split_part(subject, ' ', 1) WHEN subject LIKE '%.%' THEN {_get('subject', '^(.*)[.]([^./]+)$', 1)} ELSE subject END AS package,
 CASE WHEN subject LIKE '% %' THEN split_part(subject, ' ', 2) WHEN subject LIKE '%.%' THEN {_get('subject', '^(.*)[.]([^./]+)$', 2)} ELSE '' END AS test_id, CASE WHEN said IS NULL THEN subject WHEN located THEN {_get('said', P.SUM_LOCATION, 4)} ELSE trim(said) END AS title FROM p)
SELECT log_id, emit, CASE WHEN test_id = '' AND title LIKE '%build failed%' THEN 'build_failure' ELSE 'test_failure' END AS kind, title, CASE WHEN located THEN {_get('said', P.SUM_LOCATION, 1)} END AS file, CASE WHEN located THEN CAST({_get('said', P.SUM_LOCATION, 2)} AS BIGINT) END AS line,
 n_body, body_md5, concat_ws(';', CASE WHEN duration <> '' THEN 'duration=' || duration END, 'package=' || package, 'subject=' || subject, CASE WHEN test_id <> '' THEN 'test_id=' || test_id END) AS meta FROM q"""

QUERIES["gotestsum_summary_only"] = _blocks(gotestsum.parse, SUM_ONLY_LOG, "gotestsum")
SQL["gotestsum_summary_only"] = f"""
SELECT log_id, max(line_no) AS emit, 'test_failure' AS kind, arg_max(line, line_no) AS title, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS line, CAST(1 AS BIGINT) AS n_body, md5(arg_max(line, line_no)) AS body_md5, 'summary_only=true' AS meta
FROM ({SUM_ONLY_LOG}) WHERE line LIKE 'DONE %' AND line LIKE '% error%' GROUP BY log_id"""

QUERIES["jest_blocks"] = _blocks(jest.parse, JEST_LOG, "jest")
SQL["jest_blocks"] = f"""
WITH m AS (SELECT *, {_has('line', P.JEST_FILE)} AS h, {_has('line', P.JEST_BULLET)} AS b FROM ({JEST_LOG})), s AS (SELECT *, max(CASE WHEN NOT h AND {_has('line', P.JEST_SUMMARY)} THEN 1 ELSE 0 END) OVER w AS z, last_value(CASE WHEN h THEN {_get('line', P.JEST_FILE, 2)} END IGNORE NULLS) OVER w AS suite FROM m WINDOW w AS (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
i AS (SELECT *, sum((h OR b)::INT) OVER (PARTITION BY log_id ORDER BY line_no) AS g FROM s WHERE z = 0 AND (h OR b OR NOT {_has('line', P.JEST_VERBOSE)})),
x AS (SELECT log_id, min(line_no) AS emit, arg_min(b AND NOT h, line_no) AS b, arg_min(line, line_no) AS head, arg_min(suite, line_no) AS suite, count(*) AS n_body, {_MD5} AS body_md5, arg_min(line, line_no) FILTER ({_has('line', P.JEST_EXPECT)}) AS e1, arg_min(line, line_no) FILTER ({_has('line', P.JEST_EXPECTED)}) AS e2, arg_min(line, line_no) FILTER ({_has('line', P.JEST_FRAME)}) AS fr FROM i WHERE g > 0 GROUP BY log_id, g)
SELECT log_id, emit, 'test_failure' AS kind, CASE WHEN e1 IS NOT NULL THEN {_get('e1', P.JEST_EXPECT, 1)} WHEN e2 IS NOT NULL THEN 'Expected: ' || {_get('e2', P.JEST_EXPECTED, 1)} ELSE {_get('head', P.JEST_BULLET, 1)} END AS title,
 CASE WHEN fr IS NOT NULL THEN {_get('fr', P.JEST_FRAME, 2)} END AS file, CASE WHEN fr IS NOT NULL THEN CAST({_get('fr', P.JEST_FRAME, 3)} AS BIGINT) END AS line, n_body, body_md5,
 concat_ws(';', CASE WHEN suite IS NOT NULL THEN 'suite_file=' || suite END, 'test_id=' || replace({_get('head', P.JEST_BULLET, 1)}, '›', '>')) AS meta FROM x WHERE b"""

QUERIES["pytest_blocks"] = _blocks(lambda lines: pytest.parse(lines, "warn"), PYTEST_LOG, "pytest")
SQL["pytest_blocks"] = f"""
WITH m AS (SELECT *, CASE WHEN {_has('line', P.PY_SUMMARY)} THEN 'summary' WHEN {_has('line', P.PY_FAILURES)} THEN 'failures' WHEN {_has('line', P.PY_ERRORS)} THEN 'errors' WHEN {_has('line', P.PY_WARNINGS)} THEN 'warnings' END AS c,
 {_has('line', P.PY_ENTRY)} AS e, {_has('line', '^===? .* ===?$')} AS b, {_has('line', P.PY_UNDERLINE)} AS u FROM ({PYTEST_LOG})),
l AS (SELECT *, last_value(coalesce(c, CASE WHEN b THEN 'b' END) IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
r AS (SELECT * FROM l WHERE NOT coalesce(c = 'warnings' AND before = 'warnings', false)),
s AS (SELECT *, sum((c IS NOT NULL)::INT) OVER w AS sec, max((c = 'failures')::INT) OVER w AS seen FROM r WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
t AS (SELECT *, first_value(c) OVER v AS kind, first_value(seen) OVER v AS seen0 FROM s WHERE sec > 0 WINDOW v AS (PARTITION BY log_id, sec ORDER BY line_no)),
k AS (SELECT *, sum((CASE WHEN kind = 'warnings' THEN e ELSE u END)::INT) OVER v AS blk FROM t WHERE c IS NULL AND kind <> 'summary' WINDOW v AS (PARTITION BY log_id, sec ORDER BY line_no)),
o AS (SELECT *, max((b AND (kind = 'warnings' AND NOT e OR kind <> 'warnings' AND NOT u AND blk > 0))::INT) OVER (PARTITION BY log_id, sec ORDER BY line_no) AS z FROM k),
x AS (SELECT log_id, min(line_no) AS emit, min(kind) AS sec, max(seen0) AS seen, arg_min(line, line_no) AS head, count(*) AS n_body, {_MD5} AS body_md5, arg_min(line, line_no) FILTER ({_has('line', P.PY_ASSERTION)}) AS said, arg_max(line, line_no) FILTER ({_has('line', P.PY_LOCATION)}) AS pos,
 arg_min(line, line_no) FILTER ({_has('line', P.PY_WARNING_CLASS)}) AS wc, list(line ORDER BY line_no)[2] AS second FROM o WHERE blk > 0 AND z = 0 GROUP BY log_id, o.sec, blk)
SELECT log_id, emit, CASE WHEN sec = 'warnings' THEN 'warning' WHEN sec = 'failures' THEN 'test_failure' WHEN seen = 1 THEN 'test_error' ELSE 'collection_error' END AS kind,
 CASE WHEN sec = 'warnings' THEN coalesce({_get('wc', P.PY_WARNING_CLASS, 1)} || ': ' || {_get('wc', P.PY_WARNING_CLASS, 2)}, nullif(trim(second), ''), head) WHEN said IS NOT NULL THEN {_get('said', P.PY_ASSERTION, 1)} ELSE {_get('head', P.PY_UNDERLINE, 1)} END AS title,
 CASE WHEN sec = 'warnings' THEN CASE WHEN TRY_CAST({_get('head', P.PY_ENTRY, 2)} AS BIGINT) > 0 THEN {_get('head', P.PY_ENTRY, 1)} END WHEN pos IS NOT NULL THEN {_get('pos', P.PY_LOCATION, 1)} END AS file,
 CASE WHEN sec = 'warnings' THEN CASE WHEN TRY_CAST({_get('head', P.PY_ENTRY, 2)} AS BIGINT) > 0 THEN TRY_CAST({_get('head', P.PY_ENTRY, 2)} AS BIGINT) END WHEN pos IS NOT NULL THEN TRY_CAST({_get('pos', P.PY_LOCATION, 2)} AS BIGINT) END AS line, n_body, body_md5,
 CASE WHEN sec = 'failures' OR sec = 'errors' AND seen = 1 THEN 'test_id=' || {_get('head', P.PY_UNDERLINE, 1)} ELSE '' END AS meta FROM x"""

QUERIES["gotest_json"] = _blocks(gotest.parse_json, GO_JSON_LOG, "gotest")
SQL["gotest_json"] = f"""
WITH j AS (SELECT log_id, line_no, line::JSON AS j FROM ({GO_JSON_LOG}) WHERE json_valid(line)),
r AS (SELECT log_id, line_no, j->>'Action' AS a, coalesce(j->>'Package', '') AS p, coalesce(j->>'Test', '') AS t, regexp_replace(coalesce(j->>'Output', ''), '\\n+$', '') AS line FROM j),
b AS (SELECT log_id, line_no AS emit, 'build_failure' AS kind, {_get('line', P.GO_BUILD_ERROR, 4)} AS title, {_get('line', P.GO_BUILD_ERROR, 1)} AS file, CAST({_get('line', P.GO_BUILD_ERROR, 2)} AS BIGINT) AS line, CAST(1 AS BIGINT) AS n_body, md5(line) AS body_md5, 'package=' || p AS meta FROM r WHERE a = 'output' AND t = '' AND {_has('line', P.GO_BUILD_ERROR)}),
n AS (SELECT *, coalesce(sum((a IN ('fail', 'pass', 'skip'))::INT) OVER (PARTITION BY log_id, p, t ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM r WHERE t <> '' AND a IN ('fail', 'pass', 'skip', 'output')),
f AS (SELECT log_id, p, t, max(line_no) FILTER (a = 'fail') AS emit, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (a = 'output' AND line <> '' AND NOT {_has('trim(line)', '^=== (RUN|PAUSE|CONT)|^--- (PASS|SKIP|FAIL)')}), '') AS body,
 count(*) FILTER (a = 'output' AND line <> '' AND NOT {_has('trim(line)', '^=== (RUN|PAUSE|CONT)|^--- (PASS|SKIP|FAIL)')}) AS n_body, arg_min(ltrim(line), line_no) FILTER (a = 'output' AND {_has('ltrim(line)', P.GO_ASSERTION)}) AS said FROM n GROUP BY log_id, p, t, g)
SELECT * FROM b UNION ALL SELECT log_id, emit, 'test_failure', coalesce({_get('said', P.GO_ASSERTION, 3)}, ''), {_get('said', P.GO_ASSERTION, 1)}, CAST({_get('said', P.GO_ASSERTION, 2)} AS BIGINT), n_body, md5(body), 'package=' || p || ';test_id=' || t FROM f WHERE emit IS NOT NULL"""

QUERIES["gotest_text"] = _blocks(gotest.parse, GO_LOG, "gotest")


@_add("build_errors", f"""
SELECT log_id, line_no AS emit, trim({_get('line', P.GO_BUILD_ERROR, 4)}) AS title, {_get('line', P.GO_BUILD_ERROR, 1)} AS file, CAST({_get('line', P.GO_BUILD_ERROR, 2)} AS BIGINT) AS line, CAST({_get('line', P.GO_BUILD_ERROR, 3)} AS BIGINT) AS col
FROM (SELECT log_id, line_no, 'x.go:' || CAST(line_no AS VARCHAR) || ':3:  ' || line AS line FROM ({APP_LOG}))""")
def build_errors(spark, sf_dir):
    lines = _sql(spark, sf_dir, APP_LOG).withColumn("line", F.concat(F.lit("x.go:"), F.col("line_no").cast("string"), F.lit(":3:  "), "line"))
    return _flat(events_of(gotest.parse(lines), "gotest"), "emit").select("log_id", "emit", "title", "file", "line", "col")


def _app_events(spark, sf_dir, **options) -> Result:
    return sift(_sql(spark, sf_dir, APP_LOG), SiftOptions(format="generic", envelope="none", **options))


_EVENTS = f"""SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq, severity, kind, line AS title, {_get('line', P.GENERIC_LOCATION, 1)} AS file, {_get('line', P.GENERIC_LOCATION, 2)} AS pos, context FROM (
WITH a AS ({_ANCHORS}), w AS (SELECT *, list(line) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pre, list(line) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS post,
 min(CASE WHEN severity IS NOT NULL THEN line_no END) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - line_no AS gap FROM a)
SELECT *, list_concat(coalesce(pre, []), coalesce(post, [])[1:coalesce(gap, 3)]) AS context FROM w WHERE severity IS NOT NULL)"""
_SIG = "log_id, title, file, pos"
_DEDUPED = f"SELECT log_id, min(seq) AS seq, count(*) AS n, title, min(severity) AS severity FROM ({_EVENTS}) GROUP BY {_SIG}"


@_add("dedupe_unbounded", f"SELECT log_id, seq, title, n AS n_times FROM ({_DEDUPED})")
def dedupe_unbounded(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", dedupe_window=1024).deduped.select("log_id", "seq", "title", F.col("count").cast("long").alias("n_times"))


_EVENT_COST = f"{_cost('title')} + {_cost('file')} + {_cost('title')} + list_sum(list_transform(context, lambda x: {_cost('x')}))"


@_add("event_cost", f"SELECT log_id, seq, CAST(coalesce({_EVENT_COST}, {_cost('title')} * 2 + {_cost('file')}) AS BIGINT) AS tokens FROM ({_EVENTS})")
def event_cost(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn").found.select("log_id", "seq", stages.cost().alias("tokens"))


_BUDGET = 400
_DECIDED = f"""
WITH RECURSIVE e AS (SELECT log_id, seq, severity, title, file, pos, CAST(coalesce({_EVENT_COST}, {_cost('title')} * 2 + {_cost('file')}) AS BIGINT) AS cost, CAST({_cost('title')} * 2 + {_cost('file')} + {_cost("'" + P.BUDGET_CUT + "'")} AS BIGINT) AS cut FROM ({_EVENTS})),
o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, seq) AS place FROM e),
f AS (SELECT log_id, CAST(0 AS BIGINT) AS place, CAST({_BUDGET - P.BUDGET_RESERVE} AS BIGINT) AS left_over, '' AS decision, CAST(0 AS BIGINT) AS tokens FROM (SELECT DISTINCT log_id FROM o)
 UNION ALL SELECT o.log_id, o.place, CASE WHEN left_over <= 0 THEN left_over WHEN cost <= left_over THEN left_over - cost WHEN cut <= left_over THEN left_over - cut ELSE left_over END,
 CASE WHEN left_over <= 0 THEN 'drop' WHEN cost <= left_over THEN 'keep' WHEN cut <= left_over THEN 'cut' ELSE 'drop' END, CASE WHEN left_over <= 0 THEN 0 WHEN cost <= left_over THEN cost WHEN cut <= left_over THEN cut ELSE 0 END FROM f JOIN o ON o.log_id = f.log_id AND o.place = f.place + 1),
d AS (SELECT o.log_id, o.seq, o.severity, o.title, o.file, o.pos, f.place, f.decision, f.tokens FROM f JOIN o ON o.log_id = f.log_id AND o.place = f.place)
"""


@_add("budget_greedy", f"{_DECIDED} SELECT log_id, seq, place, decision, tokens FROM d")
def budget_greedy(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", budget=_BUDGET).decisions


@_add("max_events", f"SELECT log_id, seq, title FROM ({_EVENTS}) WHERE seq <= 5")
def max_events(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", max_events=5).events.select("log_id", "seq", "title")


_LABEL = "CASE severity WHEN 'error' THEN 'ERROR' ELSE 'WARN' END"
_AT = "CASE WHEN pos <> '' THEN ' at ' || file || ':' || pos ELSE '' END"


@_add("explain_rows", f"""{_DECIDED}
SELECT log_id, CAST(0 AS BIGINT) AS part, CAST(row_number() OVER (PARTITION BY log_id ORDER BY place) AS BIGINT) AS seq, 'kept   ' || {_LABEL} || ' ' || title || {_AT} || CASE WHEN decision = 'cut' THEN ' <truncated>' ELSE '' END AS line FROM d WHERE decision <> 'drop'
UNION ALL SELECT log_id, 1, place, 'dropped:budget ' || {_LABEL} || ' ' || title || CASE WHEN decision = 'cut' THEN ' [truncated]' ELSE '' END || {_AT} FROM d WHERE decision <> 'keep'""")
def explain_rows(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", budget=_BUDGET).explain().withColumn("part", F.col("part").cast("long"))


@_add("summary", f"""{_DECIDED}, n AS (SELECT log_id, count(*) AS input_lines FROM ({APP_LOG}) GROUP BY log_id),
t AS (SELECT log_id, count(*) FILTER (decision <> 'drop') AS kept, count(*) FILTER (decision = 'drop') AS dropped, count(*) FILTER (decision = 'cut') AS cuts, CAST(sum(tokens) AS BIGINT) AS spent FROM d GROUP BY log_id)
SELECT n.log_id, input_lines, coalesce(kept + dropped, 0) AS events_found, coalesce(kept, 0) AS events_emitted, coalesce(dropped, 0) AS events_dropped_budget, coalesce(cuts, 0) AS events_truncated, coalesce(spent, 0) AS estimated_tokens,
 CASE WHEN coalesce(dropped + cuts, 0) > 0 THEN 3 WHEN coalesce(kept, 0) = 0 THEN 1 ELSE 0 END AS exit_code FROM n LEFT JOIN t ON t.log_id = n.log_id""")
def summary(spark, sf_dir):
    out = _app_events(spark, sf_dir, severity="warn", budget=_BUDGET).summary
    return out.select("log_id", "input_lines", "events_found", "events_emitted", "events_dropped_budget", "events_truncated", "estimated_tokens", "exit_code")


_FRAMES = """SELECT CAST(l_orderkey AS STRING) AS log_id, l_linenumber AS k, CASE l_linenumber % 4 WHEN 0 THEN '/usr/lib/python3.11/site-packages/x.py' WHEN 1 THEN 'app/m.py' WHEN 2 THEN 'web/node_modules/r/i.js' ELSE 'core/a.go' END AS file, CASE WHEN l_linenumber % 5 = 0 THEN 'org.junit.Run' ELSE 'f' || CAST(l_suppkey AS STRING) END AS function FROM lineitem"""


@_add("collapse_frames", f"""SELECT log_id, count(*) FILTER (NOT v) AS n_own, count(*) FILTER (v) AS n_collapsed, string_agg(file || '|' || function, ';' ORDER BY k, file, function) FILTER (NOT v) AS own
FROM (SELECT *, {_has('file', '|'.join(f'(?:{p})' for p in P.VENDOR_FILES))} OR {_has('function', '|'.join(f'(?:{p})' for p in P.VENDOR_FUNCTIONS))} AS v FROM ({_FRAMES})) GROUP BY log_id""")
def collapse_frames(spark, sf_dir):
    rows = _sql(spark, sf_dir, _FRAMES).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("k", "file", "function"))).alias("f"))
    events = rows.withColumns({"frames": F.transform("f", lambda x: F.struct(x["file"].alias("file"), F.lit(1).alias("line"), x["function"].alias("function"), F.lit(False).alias("vendor"))), "frames_collapsed": F.lit(0)})
    own = F.transform("frames", lambda x: F.concat(x["file"], F.lit("|"), x["function"]))
    out = stages.collapse_frames(events)
    return out.select("log_id", F.size("frames").cast("long").alias("n_own"), F.col("frames_collapsed").cast("long").alias("n_collapsed"), F.when(F.size("frames") > 0, F.array_join(own, ";")).alias("own"))


_TEXTS = f"SELECT log_id, left(string_agg(line, chr(10) ORDER BY line_no) || chr(10), {P.SAMPLE_BYTES}) AS s FROM ({MIXED_LOG}) GROUP BY log_id"


def _all(column: str, patterns: list[str], word: str) -> str:
    return "(" + f" {word} ".join(_has(column, p) for p in patterns) + ")"


@_add("detect_winner", f"""
WITH c AS (SELECT log_id, unnest([
 {{'n': 'gotest', 's': CASE WHEN {_all('s', P.DETECT_GOTEST, 'OR')} THEN 1.0 WHEN {_all('s', P.DETECT_GOTEST_FUZZY, 'AND')} THEN 0.8 ELSE 0.0 END}}, {{'n': 'gotestsum', 's': CASE WHEN {_all('s', P.DETECT_GOTESTSUM, 'OR')} THEN 1.0 ELSE 0.0 END}},
 {{'n': 'jest', 's': CASE WHEN {_has('s', P.DETECT_JEST)} OR {_has(_get('s', P.DETECT_JEST_FILE, 2), P.DETECT_JEST_PATH)} THEN 1.0 WHEN {_all('s', P.DETECT_JEST_FUZZY, 'AND')} THEN 0.8 ELSE 0.0 END}},
 {{'n': 'pytest', 's': CASE WHEN {_all('s', P.DETECT_PYTEST, 'OR')} THEN 1.0 WHEN {_all('s', P.DETECT_PYTEST_FUZZY, 'AND')} THEN 0.8 ELSE 0.0 END}}]) AS c FROM ({_TEXTS}))
SELECT log_id, CASE WHEN c.s >= 0.6 THEN c.n ELSE 'generic' END AS format, CAST(CASE WHEN c.s >= 0.6 THEN c.s ELSE 0 END AS DOUBLE) AS confidence, c.s < 0.6 AS fellback_to_generic FROM c QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY c.s DESC, c.n) = 1""")
def detect_winner(spark, sf_dir):
    return detection.detect(samples(_sql(spark, sf_dir, MIXED_LOG), P.SAMPLE_BYTES)).select("log_id", "format", F.col("confidence").cast("double").alias("confidence"), "fellback_to_generic")


def _stripped(log: str, name: str):
    def query(spark, sf_dir):
        return envelopes.strip(_sql(spark, sf_dir, log), name)[0]

    return query


QUERIES["compose_strip"] = _stripped(COMPOSE_LOG, "docker-compose")
SQL["compose_strip"] = f"""SELECT log_id, line_no, regexp_replace(line, '{P.COMPOSE_LINE}', '') AS line FROM (SELECT *, max(({_has('line', P.COMPOSE_LINE)})::INT) OVER (PARTITION BY log_id ORDER BY line_no) AS hit FROM ({COMPOSE_LOG})) WHERE hit = 1"""
QUERIES["gha_strip"] = _stripped(GHA_LOG, "github-actions")
SQL["gha_strip"] = f"""SELECT log_id, line_no, line FROM (SELECT log_id, line_no, regexp_replace(line, '{P.GHA_TIME}', '') AS line FROM ({GHA_LOG})) WHERE NOT ({_has('line', P.GHA_COMMAND)} AND coalesce(nullif({_get('line', P.GHA_COMMAND, 1)}, ''), {_get('line', P.GHA_COMMAND, 3)}) IN ('group', 'endgroup', 'error', 'warning', 'notice', 'debug', 'echo'))"""
QUERIES["gitlab_strip"] = _stripped(GITLAB_LOG, "gitlab-ci")
SQL["gitlab_strip"] = f"""SELECT log_id, line_no, line FROM (SELECT log_id, line_no, regexp_replace(line, '{P.GITLAB_PREFIX}', '') AS line FROM ({GITLAB_LOG})) WHERE NOT {_has('line', P.GITLAB_SECTION)} AND NOT {_has('line', P.GITLAB_FAILED)}"""


@_add("gitlab_signals")
def gitlab_signals(spark, sf_dir):
    return _flat(events_of(envelopes.strip(_sql(spark, sf_dir, GITLAB_LOG), "gitlab-ci")[1], "envelope"), "emit")


@_add("envelope_chain", f"SELECT DISTINCT log_id, CASE WHEN log_id LIKE '%1' THEN 'none' WHEN log_id LIKE '%2' THEN 'github-actions+docker-compose' ELSE 'docker-compose' END AS envelope FROM ({APP_LOG})")
def envelope_chain(spark, sf_dir):
    return envelopes.strip(_sql(spark, sf_dir, NESTED_LOG))[2]


@_add("encode_ndjson", f"""
WITH e AS ({_EVENTS})
SELECT log_id, seq, json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.location.file') AS file, CAST(json_extract_string(j, '$.location.line') AS BIGINT) AS line, CAST(json_array_length(j, '$.context') AS BIGINT) AS n_context
FROM (SELECT log_id, seq, CASE WHEN pos <> '' THEN json_object('title', title, 'location', json_object('file', file, 'line', CAST(pos AS BIGINT)), 'context', to_json(context)) ELSE json_object('title', title, 'context', to_json(context)) END AS j FROM e)""")
def encode_ndjson(spark, sf_dir):
    r = _app_events(spark, sf_dir, severity="warn")
    shape = "event struct<title string, location struct<file string, line bigint>, context array<string>>"
    out = encoders.ndjson(r.events, r.summary).select("log_id", "seq", F.from_json("line", shape).alias("j")).where("j.event is not null")
    return out.select("log_id", "seq", "j.event.title", F.col("j.event.location.file").alias("file"), F.col("j.event.location.line").alias("line"), F.coalesce(F.size("j.event.context"), F.lit(0)).cast("long").alias("n_context"))


@_add("passthrough", f"""SELECT log_id, md5(string_agg(line || chr(10), '' ORDER BY line_no)) AS text_md5 FROM ({APP_LOG}) WHERE log_id NOT IN (SELECT log_id FROM ({_ANCHORS}) WHERE kind = 'exception') GROUP BY log_id""")
def passthrough(spark, sf_dir):
    lines = _sql(spark, sf_dir, APP_LOG)
    one = CustomFormat("none", "x", "Exception:")
    r = sift(lines, SiftOptions(format=one.id, envelope="none", passthrough=True, formats=(one,)))
    return r.render().where(~F.col("text").startswith("events from")).select("log_id", F.md5("text").alias("text_md5"))


@_add("distill_app", f"""
WITH n AS (SELECT log_id, count(*) AS input_lines FROM ({APP_LOG}) GROUP BY log_id), d AS (SELECT log_id, count(*) AS kinds, sum(n) - count(*) AS again FROM ({_DEDUPED}) GROUP BY log_id)
SELECT n.log_id, input_lines, coalesce(kinds, 0) AS events_emitted, CAST(coalesce(again, 0) AS BIGINT) AS events_deduped, CASE WHEN coalesce(kinds, 0) = 0 THEN 1 ELSE 0 END AS exit_code FROM n LEFT JOIN d ON d.log_id = n.log_id""")
def distill_app(spark, sf_dir):
    return _app_events(spark, sf_dir, severity="warn", dedupe_window=1024).summary.select("log_id", "input_lines", "events_emitted", "events_deduped", "exit_code")


@_add("fold_equals_windows", f"SELECT log_id, line_no AS emit, kind, line AS title FROM ({_ANCHORS}) WHERE severity = 'error'")
def fold_equals_windows(spark, sf_dir):
    out = _flat(events_of(fold_logs(_sql(spark, sf_dir, APP_LOG), "generic", GenericFold), "generic"), "emit")
    return out.select("log_id", F.row_number().over(_by_emit()).cast("long").alias("k"), "kind", "title").join(_numbered_anchors(spark, sf_dir), ["log_id", "k"]).select("log_id", "emit", "kind", "title")


def _by_emit():
    from pyspark.sql.window import Window

    return Window.partitionBy("log_id").orderBy("emit")


def _numbered_anchors(spark, sf_dir):
    found = generic.anchors(_sql(spark, sf_dir, APP_LOG)).select("log_id", F.col("line_no").alias("emit"))
    return found.select("log_id", "emit", F.row_number().over(_by_emit()).cast("long").alias("k"))


