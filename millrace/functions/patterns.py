"""Regular expressions and texts that decide what counts as what, and their two dialects.

They are written in RE2 syntax, the syntax users of custom formats write too. ``java`` and ``python`` give the same
language in the engines used here: RE2 knows only ``\\n`` as a line end, its ``\\s`` lacks the vertical tab and its
``\\b`` is ASCII.
"""

from __future__ import annotations

import re

# Fixed values. Results depend on these patterns, texts and limits as they stand.

ANSI = r"\x1b\[[0-9;]*m"

# Severity anchors of unstructured logs, the first that matches wins: pattern, severity, kind.
CATALOGUE = [
    (r"\bTraceback ", "error", "traceback"),
    (r"^panic:", "error", "panic"),
    (r"^Exception in thread", "error", "traceback"),
    (r"\b[A-Z][A-Za-z0-9_]*Exception:", "error", "exception"),
    (r"\bException:", "error", "exception"),
    (r"\bERROR\b", "error", "error_line"),
    (r"\bFATAL\b", "error", "error_line"),
    (r"(?i)\bcaused by:", "error", "error_line"),
    (r"\b[A-Z][A-Za-z0-9_]*Error:", "error", "error_line"),
    (r"\bError:", "error", "error_line"),
    (r"\bWARN(?:ING)?\b", "warn", "warning_line"),
    (r"\bDeprecation\b", "warn", "warning_line"),
    (r"^W\d{4}:", "warn", "warning_line"),
    (r"\bWarning:", "warn", "warning_line"),
]
GENERIC_LOCATION = r"([^\s:]*[/\\][^\s:]*):(\d+)(?::(\d+))?"
TRACEBACK_GOES_ON = r"^(?:\s|$|\s*\.{3} \d+ more$|[A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning):)"
PANIC_GOES_ON = r"^(?:\s|$|\s*goroutine \d+|\s*0x[0-9a-f]+|panic: |\[|[\w./*()]+\([\w *,.]*\)$)"
PYTHON_FRAME = r'File "([^"]+)", line (\d+)(?:, in (\S+))?'
JVM_FRAME = r"at ([\w.$]+)\(([^):]+):(\d+)\)"
GO_TAIL = r"^\s*(\S+):(\d+)(?: \+0x[0-9a-f]+)?$"
GENERIC_BLOCK_LINES, GENERIC_BLOCK_CUT = 100, "... [block truncated]"
CONTEXT_LINES = 3

# go test.
GO_FAIL = r"^(?:\s*)--- FAIL: (\S+)(?: \(([0-9.]+s)\))?\s*$"
GO_PASS_OR_SKIP = r"^(?:\s*)--- (?:PASS|SKIP): "
GO_RUN = r"^=== RUN {3}(\S+)"
GO_PAUSE_OR_CONT = r"^=== (PAUSE|CONT) "
GO_PACKAGE = r"^FAIL\t(\S+)(?:\t.+)?$"
GO_OK = r"^(?:ok {2}\t|PASS$)"
GO_EXIT = r"^exit status \d+$"
GO_ASSERTION = r"^(\S+\.go|\S+/\S+):(\d+):\s+(.*)$"
GO_RACE = r"^={5,}$"
GO_PANIC = r"^panic: "
GO_PANIC_GOES_ON = r"^(?:\s|$|goroutine \d+ |panic: |\[|created by |[\w./*()]+\(.*\)$)"
GO_BUILD_ERROR = r"^(\S+\.go):(\d+):(\d+):\s+(.*)$"
GO_BUILD_FAILED = r"^FAIL\t(\S+) \[(?:build|setup) failed\]$"
GO_TEST_TAIL = r"^\s+(\S+\.go):(\d+)(?: \+0x[0-9a-f]+)?$"
GO_CALL = r"^([\w./*()\[\]-]+)\("
GO_JSON_START = '{"Time":"'
GO_JSON_FRAMING = ["=== RUN", "=== PAUSE", "=== CONT", "--- PASS", "--- SKIP", "--- FAIL"]
GO_OWN_VENDOR_FILES, GO_OWN_VENDOR_FUNCTIONS = ["/src/runtime/", "/src/testing/", "pkg/mod/", "/vendor/"], ["runtime.", "testing."]
GO_PANIC_LINES, GO_PANIC_CUT = 200, "... [panic block truncated]"
GO_RACE_LINES, GO_RACE_CUT = 300, "... [race report truncated]"
GO_RACE_TITLE = "WARNING: DATA RACE"

# gotestsum.
SUM_FAIL = r"^=== FAIL: (.+?)(?: \(([^)]+)\))?\s*$"
SUM_LOCATION = r"^\s*(\S+\.go):(\d+)(?::(\d+))?:\s+(.*)$"
SUM_DONE = "DONE "
SUM_FLAG, SUM_BUILD = "flag provided but not defined:", "build failed"
SUM_FAILING = [" failure", " error"]

# pytest.
PY_FAILURES = r"^=+\s+FAILURES\s+=+\s*$"
PY_ERRORS = r"^=+\s+ERRORS\s+=+\s*$"
PY_SUMMARY = r"^=+\s+short test summary info\s+=+\s*$"
PY_RESULT = r"^=+\s+\d+\s+(?:failed|passed|error|skipped|warning|deselected|xfailed|xpassed)"
PY_WARNINGS = r"^=+\s+warnings summary\s+=+\s*$"
PY_UNDERLINE = r"^_{3,}\s+(.+?)\s+_{3,}\s*$"
PY_COLLECTING = r"^ERROR collecting\s+(\S+)"
PY_ASSERTION = r"^E\s+(.+?)\s*$"
PY_LOCATION = r"^(\S+\.py|\S+[/\\]\S+):(\d+):\s*(.*)$"
PY_LONG_FRAME = r'(?:^|\s)File "([^"]+)", line (\d+), in (\S+)'
PY_SHORT_FRAME = r"^(\S+\.py|\S+[/\\]\S+):(\d+):\s+in\s+(\S+)"
PY_ENTRY = r"^(\S+\.py)(?::(\d+))?(?:::(\S+))?\s*$"
PY_WARNING_CLASS = r"(\b\w+Warning):\s+(.+?)\s*$"

# jest.
JEST_BULLET = r"^\s*●\s+(.+?)\s*$"
JEST_FILE = r"^(FAIL|PASS)\s+(\S+)"
JEST_SUMMARY = r"^(?:Test Suites|Tests):\s+"
JEST_FRAME = r"^\s+at\s+(\S+(?:\s\S+)*)\s+\((\S+?):(\d+):(\d+)\)\s*$"
JEST_BARE_FRAME = r"^\s+at\s+(\S+?):(\d+):(\d+)\s*$"
JEST_EXPECT = r"^\s*(expect\([^)]*\)\.\S+)"
JEST_EXPECTED = r"^\s*Expected:\s+(.+?)\s*$"
JEST_ERROR = r"^\s*((?:\w*Error|AssertionError):\s+.+?)\s*$"
JEST_VERBOSE = r"^\s*[✓✗]\s+"
JEST_SNAPSHOT = r"expect\([^)]*\)\.toMatchSnapshot\("
JEST_INLINE = r"expect\([^)]*\)\.toMatchInlineSnapshot\("
JEST_SNAPSHOT_NAME = r"^\s*Snapshot name:\s+`(.+?)`\s*$"
JEST_SNAPSHOT_LINES, JEST_SNAPSHOT_CUT = 200, "... [snapshot truncated]"
JEST_SUITE = "Test suite failed to run"

# Detection: markers over a sample, many lines at once.
DETECT_GOTEST = [r"(?m)^--- FAIL: ", r"(?m)^=== RUN {3}", r"(?m)^FAIL\t(?:\S+/\S+|\w+(?:\.\w+)+)"]
DETECT_GOTEST_FUZZY = [r"(?m)^goroutine \d+ \[\w+\]:", r"\.go:\d+"]
DETECT_GOTESTSUM = [r"(?m)^=== Failed$", r"(?m)^=== FAIL: ", r"(?m)^DONE \d+ tests?", r"(?m)^(?:PASS|FAIL|SKIP) \S+\.\S+ \([^)]+\)$"]
DETECT_PYTEST = [r"(?m)^=+ test session starts =+\s*$", r"(?m)^=+ FAILURES =+\s*$"]
DETECT_PYTEST_FUZZY = [r"(?m)^>\s+", r"\b(?:conftest\.py|pytest\.ini)\b"]
DETECT_JEST = r"(?m)^\s*● "
DETECT_JEST_FILE, DETECT_JEST_PATH = r"(?m)^(FAIL|PASS) (\S+)", r"\.(?:test|spec)\.(?:js|ts|jsx|tsx)$"
DETECT_JEST_FUZZY = [r"(?m)^Tests:\s+\d+\s+(?:passed|failed|skipped|total)", r"\bjest\b|\.(?:test|spec)\.(?:js|ts|jsx|tsx)\b"]
DETECT_GENERIC = r"(?m)^.*(?:\bERROR\b|\bFATAL\b|\bWARN(?:ING)?\b|\bpanic:|\bException:|\bTraceback |\bError:|\bWarning:).*$"
CLEAR, FUZZY, LEAST_CONFIDENCE, GENERIC_CONFIDENCE = 1.0, 0.8, 0.6, 0.1
SAMPLE_BYTES, SAMPLE_STEP, SAMPLE_MOST = 16384, 65536, 262144

# Envelopes.
GHA_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z "
GHA_COMMAND = r"^(?:##\[(\w+)\](.*)|::(\w+)::(.*))$"
GHA_DROPPED = ["group", "endgroup", "error", "warning", "notice", "debug", "echo"]
GHA_EXIT = r"^Process completed with exit code (\d+)\.?$"
GHA_MARKERS = ["##[group]", "##[error]", "##[warning]", "##[debug]", "##[notice]", "::set-output "]
GITLAB_SECTION = r"^section_(start|end):(\d+):([a-zA-Z0-9_]+)\r?$"
GITLAB_FAILED = r"^ERROR: Job failed: exit (?:code|status) (\d+)$"
GITLAB_PREFIX = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z \d{2}[A-Z](?: |\+\x1b\[0K)(?:\x1b\[[0-9;]*[A-Za-z])*"
GITLAB_BANNER = r"(?m)^Running with gitlab-runner "
COMPOSE_LINE = r"^([a-z0-9][a-z0-9_-]*(?:-\d+)?)( +)\| "
GROUP_DEPTH, GITLAB_HEAD, GITLAB_CSI, COMPOSE_LINES = 8, 1024, 5, 4

# Frames of code that isn't the user's.
VENDOR_FILES = [
    r"(?:^|/)(?:site|dist)-packages/",
    r"(?:^|/)(?:usr/lib|usr/local/lib|opt/.+?/lib)/python\d+(?:\.\d+)?/",
    r"^<frozen ",
    r"(?:^|/)node_modules/",
    r"(?:^|/)src/runtime/",
    r"(?:^|/)vendor/",
    r"(?:^|/)pkg/mod/",
]
VENDOR_FUNCTIONS = [r"^(?:java|javax|sun|jdk)\.", r"^(?:org\.junit|org\.gradle|org\.testng)\."]

BUDGET_RESERVE, BUDGET_CUT = 30, "... [truncated by --budget]"
DEDUPE_WINDOW = 1024
LINE_BYTES = 1 << 20

# End of fixed values.

_WORD = "[0-9A-Za-z_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_SPACE = {r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\b": _EDGE}


def _plain(pattern: str, inside: dict[str, str]) -> str:
    """Spells out the classes whose meaning differs, inside brackets without brackets of their own."""
    out, i, bracket = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern[i] == "\\" and len(two) == 2:
            if two in inside:
                part = inside[two]
                out.append(r"\t\n\f\r " if bracket and two == r"\s" else part)
            else:
                out.append(two)
            i += 2
            continue
        if pattern[i] == "[" and not bracket:
            bracket = True
        elif pattern[i] == "[" and bracket:
            out.append("\\")
        elif pattern[i] == "]" and bracket:
            bracket = False
        out.append(pattern[i])
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """For ``rlike`` and ``regexp_*``."""
    return "(?d)" + _plain(pattern, _SPACE)


def needed(pattern: str) -> str:
    """The longest literal text that every match of a pattern without alternatives outside groups holds, in lower case if case doesn't matter; may be empty."""
    bare = re.sub(r"^\(\?\w+\)", "", pattern)
    bare = re.sub(r"\[[^\]]*\]|\([^()]*\)|\\.", "\0", bare)
    bare = re.sub(r".(?:[*+?]|\{[^}]*\})+", "\0", bare)
    longest = max(re.split(r"[\0^$.]", bare), key=len)
    return longest.lower() if pattern.startswith("(?i)") else longest


def python(pattern: str) -> re.Pattern:
    """For sequential folds."""
    text = _plain(pattern, _SPACE)
    if "(?m)" not in pattern:
        text = _dollar(text)
    return re.compile(text, re.ASCII)


def _dollar(text: str) -> str:
    """``$`` as the end of the text, but for those in brackets and after a backslash."""
    out, i, bracket = [], 0, False
    while i < len(text):
        if text[i] == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        bracket = text[i] == "[" or bracket and text[i] != "]"
        out.append(r"\Z" if text[i] == "$" and not bracket else text[i])
        i += 1
    return "".join(out)
