"""Parsers: hand-made logs, and windows against folds on random logs."""

import random

import pytest

from millrace.operators.formats import generic, gotest, gotestsum, jest, pytest as py
from millrace.operators.formats.custom import CustomFormat
from millrace.operators.folding import fold_logs
from millrace.operators.projection import events_of, numbered
from millrace.sources.logs import lines_of
from millrace.streaming.folds import CustomFold, GenericFold, GotestsumFold, JestFold, PytestFold


def frame(spark, logs):
    return lines_of(spark.createDataFrame(list(logs.items()), "log_id string, text string"))


def parsed(spark, module, text, fmt, *args):
    return numbered(events_of(module.parse(frame(spark, {"a": text}), *args), fmt)).orderBy("seq").collect()


def test_lines(spark):
    got = frame(spark, {"a": "x\r\ny\rz\n\nlast", "b": "", "c": "\n"}).orderBy("log_id", "line_no").collect()
    assert [(r.log_id, r.line_no, r.line) for r in got] == [("a", 1, "x"), ("a", 2, "y\rz"), ("a", 3, ""), ("a", 4, "last"), ("c", 1, "")]


def test_long_line_ends_the_log(spark):
    got = frame(spark, {"a": "x\n" + "y" * (1 << 20) + "\nz\n"}).collect()
    assert [r.line for r in got] == ["x"]


def test_generic_context_and_blocks(spark):
    text = "\n".join(["one", "two", "éERROR no", "\x1b[31mERROR\x1b[0m at /srv/app.py:12:3 boom  ", "after", "ERROR next", "x", "Traceback (most recent call last):", '  File "a/b.py", line 4, in go', "KeyError: k", "done"])
    got = parsed(spark, generic, text, "generic")
    assert [e.kind for e in got] == ["error_line", "error_line", "error_line", "traceback"][-len(got):]
    first = next(e for e in got if e.location)
    assert (first.location.file, first.location.line, first.location.column) == ("/srv/app.py", 12, 3)
    assert first.title == "ERROR at /srv/app.py:12:3 boom" and first.context[-2:] == ["after", "ERROR next"]
    last = got[-1]
    assert last.title == "KeyError: k" and last.frames[0].function == "go" and last.context == ["after", "ERROR next", "x", "done"]


def test_generic_long_block(spark):
    got = parsed(spark, generic, "panic: x\n" + "\n".join(f"\tf{i}.go:{i + 1} +0x1" for i in range(150)), "generic")
    assert len(got[0].body) == 100 and got[0].body[-1] == "... [block truncated]"


def test_gotest(spark):
    text = "\n".join(["=== RUN   TestA", "    a_test.go:7: want 1", "--- FAIL: TestA (0.01s)", "--- PASS: TestZ (0s)", "=== RUN   TestB", "x.go:3:4: undefined: q", "panic: nil", "main.f(0x1)", "\t/src/m.go:9 +0x2", "FAIL\tshop/a\t0.1s", "--- FAIL: TestB (0.00s)"])
    got = parsed(spark, gotest, text, "gotest")
    assert [e.kind for e in got] == ["build_failure", "panic", "test_failure"]
    assert got[2].title == "want 1" and got[2].metadata == {"test_id": "TestA", "package": "shop/a", "duration": "0.01s"} and got[2].body[0] == "    a_test.go:7: want 1"
    assert got[1].location.file == "/src/m.go" and got[1].frames[0].function == "main.f" and got[1].metadata == {"test_id": "TestB"}
    assert got[0].body == ["x.go:3:4: undefined: q"] and got[0].location.column == 4


def test_gotest_race(spark):
    got = parsed(spark, gotest, "=== RUN   TestR\n==================\nWARNING: DATA RACE\n" + "x\n" * 400 + "==================\n--- FAIL: TestR (0s)\n", "gotest")
    assert len(got) == 1 and got[0].kind == "race_condition" and len(got[0].body) == 300
    assert got[0].metadata == {"test_id": "TestR", "race_goroutines": "2", "race_truncated": "true"}


def test_gotest_json(spark):
    text = '{"Time":"t","Action":"run","Test":"A"}\nnoise\n{"Action":"output","Package":"p","Test":"A","Output":"    a.go:3: bad\\n"}\n{"Action":"fail","Package":"p","Test":"A"}\n{"Action":"fail","Package":"p"}\n{"Action":"fail","Package":"p","Test":"B"}'
    got = parsed(spark, gotest, text, "gotest")
    assert [(e.title, len(e.body), e.metadata["test_id"]) for e in got] == [("bad", 1, "A"), ("", 0, "B")]


def test_jest_snapshot_and_suite(spark):
    text = "FAIL src/a.test.js\n  ● cart › x\n    expect(received).toMatchSnapshot()\n    Snapshot name: `cart x 1`\n" + "    y\n" * 250 + "  ● Test suite failed to run\n    Error: no\n      at f (/a.js:3:4)\nTests: 1 failed\n  ● late"
    got = parsed(spark, jest, text, "jest")
    assert [e.kind for e in got] == ["snapshot_mismatch", "suite_error"] and got[0].title == "Snapshot mismatch: cart x 1" and len(got[0].body) == 200
    assert got[0].metadata["snapshot_truncated"] == "true" and got[0].metadata["test_id"] == "cart > x" and got[1].title == "Error: no"
    assert (got[1].location.file, got[1].location.line, got[1].location.column) == ("/a.js", 3, 4) and got[1].metadata == {"suite_file": "src/a.test.js"}


def test_pytest_sections(spark):
    text = "=== ERRORS ===\n___ ERROR collecting t/x.py ___\nE   SyntaxError: bad\n=== FAILURES ===\n___ test_a ___\n>   assert 0\nE   assert 0\nt/a.py:4: AssertionError\n=== warnings summary ===\nt/a.py:9\n  t/a.py:9: UserWarning: old\n=== short test summary info ===\nx"
    got = parsed(spark, py, text, "pytest", "warn")
    assert [(e.kind, e.title) for e in got] == [("collection_error", "SyntaxError: bad"), ("test_failure", "assert 0"), ("warning", "UserWarning: old")]
    assert got[0].location.file == "t/x.py" and got[0].location.line == 0 and got[1].location.line == 4 and got[2].location.line == 9
    assert len(parsed(spark, py, text, "pytest", "error")) == 2


def test_custom_is_validated():
    for bad in ({"event_start": ""}, {"event_start": "("}, {"event_start": "(?=x)"}, {"event_start": "x", "severity": "bad"}):
        with pytest.raises(ValueError):
            CustomFormat(**({"name": "n", "detect_regex": "x"} | bad))


ALPHABETS = {
    "gotestsum": ["=== FAIL: a/b TestX (0.1s)", "=== FAIL: a.B", "DONE 3 tests, 1 failure", "DONE 1 tests", "", "  a_test.go:3: x", "text"],
    "jest": ["FAIL src/a.test.js", "PASS b", "  ● one", "  ✓ ok", "Tests: 1 failed", "expect(a).toBe(1)", "at x"],
    "pytest": ["=== FAILURES ===", "=== ERRORS ===", "=== warnings summary ===", "=== short test summary info ===", "=== other ===", "___ t1 ___", "t/a.py:3", "  UserWarning: x", "E   bad", "", "text"],
    "custom": ["start a", "end", "mid", "start end"],
    "generic": ["ERROR a", "WARN b", "x", "y", "z", "W1234: c", "ValueError: d"],
}


@pytest.mark.parametrize("fmt", ALPHABETS)
def test_windows_equal_folds(spark, fmt):
    rng = random.Random(fmt)
    weights = [0.15 if x.startswith("Tests") else 1 for x in ALPHABETS[fmt]]
    logs = {str(i): "\n".join(rng.choices(ALPHABETS[fmt], weights, k=rng.randint(0, 25))) for i in range(150)}
    one = CustomFormat("n", "x", "start", "end", "warn", "k")
    windows, fold = {
        "gotestsum": (gotestsum.parse, GotestsumFold), "jest": (jest.parse, JestFold), "pytest": (lambda x: py.parse(x, "warn"), lambda: PytestFold(least="warn")),
        "custom": (one.parse, lambda: CustomFold(start="start", end="end", severity="warn", kind="k", name="n")), "generic": (lambda x: generic.parse(x, "warn", 2), lambda: GenericFold(least="warn", context=2)),
    }[fmt]
    lines = frame(spark, logs)
    cols = ("log_id", "seq", "kind", "severity", "title", "location", "body", "context", "metadata")
    a, b = (sorted(map(str, numbered(events_of(x, fmt)).select(*cols).collect())) for x in (windows(lines), fold_logs(lines, fmt, fold)))
    assert a == b and a


def test_blocks_of_mixed_kinds(spark):
    """Against a plain reading of the rules: a block's lines are those that go on with it; what follows is context, up to three lines or the next anchor."""
    anchor = {"Traceback (x": "traceback", "panic: p": "panic", "ERROR e": "error_line", "ValueError: v": "error_line"}
    goes = {"traceback": {"  in", "", "ValueError: v"}, "panic": {"  in", "", "panic: p", "main.f(a)"}, "error_line": set()}
    rng = random.Random(3)
    for _ in range(4):
        text = rng.choices(["Traceback (x", "panic: p", "  in", "", "plain", "ERROR e", "ValueError: v", "main.f(a)"], k=60) + ["end"]
        want, i, inside = [], 0, None
        while i < len(text):
            if text[i] in anchor:
                kind, j = anchor[text[i]], i + 1
                while j < len(text) and text[j] in goes[kind]:
                    j += 1
                after = j
                while after < len(text) and after < j + 3 and (after == j or text[after - 1] not in anchor):
                    after += 1
                want.append((kind, text[i:j], text[max(0, i - 3) : i] + text[j:after]))
                i = j
            else:
                i += 1
        got = parsed(spark, generic, "\n".join(text), "generic")
        assert [(e.kind, e.body, e.context) for e in got] == want
