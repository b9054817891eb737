"""Stages, envelopes, detection, rendering, options and streams."""

import json
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions import patterns as P
from millrace.functions.text import SPACES, estimate, trimmed
from millrace.operators import stages
from millrace.operators import envelopes
from millrace.operators.detection import Format, detect, list_formats, register_format, unregister_format
from millrace.operators.envelopes import EnvelopeError, strip
from millrace.operators.formats import generic
from millrace.operators.formats.custom import CustomFormat
from millrace.operators.projection import events_of
from millrace.plans.engine import detect_report, report_lines, sift, sift_logs
from millrace.plans.options import Config, ConfigError, OptionError, SiftOptions, TokenizerUnavailable, apply_config, dedupe_window, discover, merge, parse_config
from millrace.schema import EVENTS
from millrace.sources.logs import input_lines, lines_of, read_concatenated, read_lines, read_logs
from millrace.streaming.folds import GenericFold
from millrace.streaming.sessions import fold_stream


def lines(spark, **logs):
    return lines_of(spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "log_id string, text string"))


def events(spark, *titles):
    rows = [("a", i, s, "k", t, None, ["b"], [], [], 0, 0, False, None) for i, (s, t) in enumerate(titles, 1)]
    return spark.createDataFrame(rows, EVENTS)


def test_estimate(spark):
    got = spark.createDataFrame([("",), ("ab cd",), ("a.b_c",), ("héllo wörld 12!!",), ("  ",)], "t string").select(estimate(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [0, 3, 6, 5, 0]


def test_dedupe(spark):
    e = events(spark, *(("error", t) for t in "abacbadda"))
    assert [(r.seq, r["count"]) for r in stages.dedupe(e, 9).orderBy("seq").collect()] == [(1, 4), (2, 2), (4, 1), (7, 2)]
    assert [(r.seq, r["count"]) for r in stages.dedupe(e, 2).orderBy("seq").collect()] == [(1, 2), (2, 2), (4, 1), (6, 2), (7, 2)]
    assert [r["count"] for r in stages.dedupe(e, 0).collect()] == [1] * 9


def test_budget_takes_severe_first_and_skips(spark):
    e = events(spark, ("warn", "w"), ("error", "word " * 40), ("error", "x"), ("info", "i"))
    d = {r.seq: (r.place, r.decision) for r in stages.decide(e, 40).collect()}
    assert d[2] == (1, "drop") and d[3] == (2, "keep") and d[1] == (3, "keep") and d[4][0] == 4
    assert [r.title for r in stages.apply_budget(e, stages.decide(e, 40)).orderBy("seq").collect()][:2] == ["x", "w"]
    assert {r.decision for r in stages.decide(e, 10).collect()} == {"drop"}


def test_budget_cuts(spark):
    e = events(spark, ("error", "t")).withColumn("body", F.array(*(F.lit("many words in a line") for _ in range(40))))
    got = stages.budget(e, 60).collect()[0]
    assert got.truncated and got.body == ["many words in a line", "... [truncated by --budget]"]


def test_collapse(spark):
    frames = [("/x/site-packages/a.py", 1, "f", False), ("app.py", 2, "java.lang.X", False), ("app.py", 3, "g", False)]
    e = events(spark, ("error", "t")).withColumn("frames", F.lit(None).cast("array<struct<file:string,line:int,function:string,vendor:boolean>>"))
    e = spark.createDataFrame([("a", 1, "error", "k", "t", None, [], [], frames, 0, 0, False, None)], EVENTS)
    got = stages.collapse_frames(e).collect()[0]
    assert got.frames_collapsed == 2 and [f.line for f in got.frames] == [3]
    kept = stages.collapse_frames(e, keep_vendor=True).collect()[0]
    assert kept.frames_collapsed == 0 and [f.vendor for f in kept.frames] == [True, True, False]


def test_envelopes(spark):
    t = "2024-01-02T03:04:05.678Z "
    gha = [t + "##[group]Run tests", t + "plain", t + "svc-1  | ERROR a", t + "##[error]Process completed with exit code 2.", t + "##[endgroup]", t + "##[warning]old", t + "::unknown::x", "::set-output name=a::b"]
    lab = ["section_start:1:build", "\x1b[0mhi", "section_start:2:inner", "section_end:3:build", "ERROR: Job failed: exit status 7"]
    clean, signals, names = strip(lines(spark, gha=gha, lab=lab, bare=["x"]))
    got = {r.log_id: r.envelope for r in names.collect()}
    assert got == {"gha": "github-actions", "lab": "gitlab-ci", "bare": "none"}
    assert [r.line for r in clean.where("log_id = 'gha'").orderBy("line_no").collect()] == ["plain", "svc-1  | ERROR a", "::unknown::x", "::set-output name=a::b"]
    s = events_of(signals, "envelope").orderBy("log_id", "emit").collect()
    assert [(r.kind, r.title, r.metadata) for r in s if r.log_id == "gha"] == [("envelope_step_failure", "Run tests", {"exit_code": "2", "step": "Run tests"}), ("envelope_warning", "old", {})]
    assert [(r.title, r.body) for r in s if r.log_id == "lab"] == [("", ["Job failed: exit code 7"])]
    with pytest.raises(EnvelopeError):
        strip(lines(spark, a=["x"]), "nope")


def test_envelope_chain(spark):
    t = "2024-01-02T03:04:05.678Z "
    clean, _, names = strip(lines(spark, a=[t + "##[group]g", t + "web-1  | ERROR x", t + "web-1  | y"]))
    assert names.collect()[0].envelope == "github-actions+docker-compose"
    assert [r.line for r in clean.orderBy("line_no").collect()] == ["ERROR x", "y"]


def test_detect(spark):
    one = CustomFormat("mine", "^BEGIN", "x")
    s = spark.createDataFrame([("g", "--- FAIL: T"), ("both", "=== FAIL: a\n--- FAIL: T\n"), ("j", "FAIL src/a.spec.ts\n"), ("n", "FAIL: reboot\n"), ("p", "> x\nconftest.py"), ("c", "BEGIN"), ("z", "ERROR")], "log_id string, sample string")
    got = {r.log_id: (r.format, r.confidence) for r in detect(s, [one]).collect()}
    assert got == {"g": ("gotest", 1.0), "both": ("gotest", 1.0), "j": ("jest", 1.0), "n": ("generic", 0.0), "p": ("pytest", 0.8), "c": ("custom:mine", 1.0), "z": ("generic", 0.0)}
    with pytest.raises(Exception, match="no format"):
        detect(s, strict=True).collect()
    assert list_formats([one])[0] == "custom:mine\t1\tbuiltin" and len(list_formats()) == 5


def test_whole_run_and_rendering(spark):
    app = ["start", "ERROR a/b.py:3: bad", "ERROR a/b.py:3: bad", "WARN w", "end"]
    r = sift(lines(spark, app=app, quiet=["fine"]), SiftOptions(format="generic", dedupe_window=10, passthrough=True))
    text = {x.log_id: x.text for x in r.render().collect()}
    assert text["quiet"] == "fine\n" and text["app"].startswith("events from generic\n\n[1] ERROR ERROR a/b.py:3: bad\n  at a/b.py:3\n  ERROR a/b.py:3: bad\n  context:\n    start\n") and "  (×2)\n" in text["app"]
    s = {x.log_id: x for x in r.summary.collect()}
    assert (s["app"].input_lines, s["app"].events_emitted, s["app"].events_deduped, s["app"].exit_code) == (5, 1, 1, 0) and s["quiet"].exit_code == 0
    j = {x.log_id: json.loads(x.text) for x in sift(lines(spark, app=app), SiftOptions(format="generic", output="json")).render().collect()}["app"]
    assert j["events"][0]["location"] == {"file": "a/b.py", "line": 3, "column": None} and "metadata" not in j["events"][0] and j["summary"]["events_found"] == 2
    nd = sift(lines(spark, app=app), SiftOptions(format="generic", output="ndjson")).render().collect()[0].text.splitlines()
    assert [("event" in json.loads(x), "summary" in json.loads(x)) for x in nd] == [(True, False), (True, False), (False, True)]
    md = sift(lines(spark, app=app), SiftOptions(format="generic", output="markdown", fence="log")).render().collect()[0].text
    assert md.startswith("# events from generic\n\n### [1] ERROR") and "```log\n" in md and "- **Events emitted:** 2\n" in md
    ex = sift(lines(spark, app=app), SiftOptions(format="generic", budget=80)).explain().orderBy("part", "seq").collect()
    assert ex[0].line.startswith("kept   ERROR") and any(x.line.startswith("dropped:budget ERROR") for x in ex)


def test_auto_mixed(spark):
    r = sift(lines(spark, a=["--- FAIL: TestA (0.01s)", "    a.go:3: x"], b=["web-1  | ● t", "web-1  |   expect(a).toBe(1)"], c=["ERROR x"]), SiftOptions(budget=500, dedupe_window=5))
    assert {x.log_id: x.format for x in r.summary.collect()} == {"a": "gotest", "b": "jest", "c": "generic"}
    assert {x.log_id: x.kind for x in r.events.collect()} == {"a": "test_failure", "b": "test_failure", "c": "error_line"}
    assert {x.log_id: x.exit_code for x in detect_report(lines(spark, a=["--- FAIL: T"], c=["ERROR x"])).collect()} == {"a": 0, "c": 1}


def test_options_and_config(tmp_path):
    assert SiftOptions(keep_warnings=True).least == "warn" and SiftOptions(severity="info", keep_warnings=True).least == "info"
    assert (dedupe_window(), dedupe_window(True), dedupe_window(True, True), dedupe_window(True, False, 7)) == (0, 1024, 0, 7)
    for bad in ({"severity": "x"}, {"budget": -1}, {"output": "x"}):
        with pytest.raises(OptionError):
            SiftOptions(**bad)
    with pytest.raises(TokenizerUnavailable):
        SiftOptions(tokenizer="tiktoken")
    c = parse_config('schema_version = 1\ndefault_budget = 5\n[formats.jest]\ndefault_budget = 9\n[[custom_formats]]\nname = "b"\ndetect_regex = "x"\nevent_start = "y"\n')
    auto = apply_config(SiftOptions(), c)
    assert auto.of("jest").budget == 9 and auto.of("gotest").budget == 5 and apply_config(SiftOptions(), c, {"budget"}).by_format == ()
    with pytest.raises(OptionError):
        apply_config(SiftOptions(), parse_config("[formats.jest]\ndedupe_window = -4"))
    assert apply_config(SiftOptions(format="jest"), c).budget == 9 and apply_config(SiftOptions(), c).budget == 5 and apply_config(SiftOptions(budget=1), c, {"budget"}).budget == 1
    assert merge(c, Config({"default_budget": 6}, {}, ())).values["default_budget"] == 6 and c.custom[0].id == "custom:b"
    for bad in ("nope = 1", "[formats.jest]\nx = 1", "schema_version = 2", "a = [", '[[custom_formats]]\nname = "b"'):
        with pytest.raises(ConfigError):
            parse_config(bad)
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/millrace.toml").write_text("")
    assert discover(tmp_path / "p/q") == [tmp_path / "p/millrace.toml"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\r\ny")
    (tmp_path / "b").write_text("z\n")
    assert read_logs(spark, str(tmp_path / "a")).collect()[0].text == "x\r\ny"
    assert read_concatenated(spark, str(tmp_path / "b"), str(tmp_path / "a")).collect()[0].text == "z\n\nx\r\ny"
    assert [(r.line_no, r.line) for r in read_lines(spark, str(tmp_path / "a")).orderBy("line_no").collect()] == [(1, "x"), (2, "y")]
    got = spark.createDataFrame([("a\nb",), ("a\n",), ("",), (None,)], "t string").select(input_lines(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [2, 1, 0, 0]


def whole(spark, **logs):
    return spark.createDataFrame(list(logs.items()), "log_id string, text string")


def test_logs_without_events(spark):
    logs = whole(spark, empty="", null=None, quiet="a\r\nb", loud="ERROR x", long="a\n" + "y" * (1 << 20) + "\nb\n")
    for fmt in ("generic", "auto"):
        r = sift_logs(logs, SiftOptions(format=fmt))
        s = {x.log_id: (x.input_lines, x.events_emitted, x.exit_code, x.format) for x in r.summary.collect()}
        assert s == {"empty": (0, 0, 1, "generic"), "null": (0, 0, 1, "generic"), "quiet": (2, 0, 1, "generic"), "loud": (1, 1, 0, "generic"), "long": (3, 0, 1, "generic")}
    text = {x.log_id: x.text for x in r.render().collect()}
    assert text["empty"] == "no events found\n---\ndistilled ? lines → 0 lines (0 tokens, heuristic)\ndropped: 0 events, 0 truncated, 0 deduped, 0 vendor frames\n"
    md = {x.log_id: x.text for x in sift_logs(logs, SiftOptions(format="generic", output="markdown")).render().collect()}
    assert md["quiet"].startswith("_no events found_\n---\n\n- **Lines distilled:** 2 → 0\n")
    r = sift_logs(logs, SiftOptions(format="generic", passthrough=True))
    assert {x.log_id: x.exit_code for x in r.summary.collect()} == {"empty": 1, "null": 1, "quiet": 0, "loud": 0, "long": 0}
    assert {x.log_id: x.text for x in r.render().collect()}["quiet"] == "a\r\nb"
    # What the budget drops isn't passed through.
    r = sift_logs(logs, SiftOptions(format="generic", passthrough=True, budget=31))
    assert {x.log_id: x.exit_code for x in r.summary.collect()}["loud"] == 3 and {x.log_id: x.text for x in r.render().collect()}["loud"].startswith("no events found")


def test_events_are_numbered_without_gaps(spark):
    r = sift(lines(spark, a=["ERROR x", "ERROR x", "ERROR y"]), SiftOptions(format="generic", dedupe_window=9))
    assert sorted((x.seq, x.title) for x in r.events.collect()) == [(1, "ERROR x"), (2, "ERROR y")]


def test_settings_left_empty_are_defaults():
    one = CustomFormat("n", "x", "y", "", "", "")
    assert (one.event_end, one.severity, one.kind) == (None, "error", "match")


def test_registered_format(spark):
    from millrace.queries_whole import _shouts

    with pytest.raises(ValueError):
        register_format(Format("jest", None, None))
    register_format(Format("shout", lambda s: F.when(s.contains("SHOUT"), 1.0).otherwise(0.0), _shouts))
    try:
        r = sift(lines(spark, a=["SHOUT", "ERROR x"], b=["ERROR y"]))
        assert {x.log_id: (x.format, x.events_emitted) for x in r.summary.collect()} == {"a": ("shout", 1), "b": ("generic", 1)}
        assert "shout\t1\tbuiltin" in list_formats()
    finally:
        unregister_format("shout")


def test_exact_tokenizer_in_the_budget(spark, tmp_path):
    import base64

    # Single bytes, and "ab" as one token.
    tokens = [bytes([i]) for i in range(256)] + [b"ab"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    e = events(spark, ("error", "abab x"), ("warn", "zzz"))
    r = sift(lines(spark, a=["ERROR abab"]), SiftOptions(format="generic", budget=100, tokenizer="tiktoken", vocabulary=str(tmp_path / "ranks"), token_pattern=r"\s+|\S+"))
    # Title and body: E R R O R, a blank, ab ab.
    assert r.summary.collect()[0].estimated_tokens == 16 and r.summary.collect()[0].estimator == "tiktoken"
    assert stages.decide(e, 40, 30, r._total).count() == 2


def test_report_lines(spark):
    rows = {x.log_id: report_lines(x) for x in detect_report(lines(spark, a=["--- FAIL: T", "=== FAIL: a"], z=["hm"])).collect()}
    assert rows["a"] == ["source: a", "envelope: none", "format: gotest", "confidence: 1.00", "sample_bytes: 24", "fellback_to_generic: false", "runner: gotestsum", "runner_confidence: 1.00"]
    assert rows["z"][-2:] == ["fellback_to_generic: true", "runner: (none)"]


def test_inner_samples_grow_and_logs_are_read_on(spark, monkeypatch):
    assert envelopes.inner_sizes() == [16384, 81920, 147456, 212992, 262144]
    monkeypatch.setattr(envelopes, "FIRST_READ", 20_000)
    t = "2024-01-02T03:04:05.678Z "
    far = ["##[group]g", *["##[debug]" + "d" * 90] * 700, *[t + "web-1  | x"] * 5]
    _, _, names = strip(lines(spark, far=far, none=["x"]))
    assert {r.log_id: r.envelope for r in names.collect()} == {"far": "github-actions+docker-compose", "none": "none"}


def test_groups_nested_deeper_than_counted(spark):
    gha = ["##[group]g" + str(i) for i in range(10)] + ["##[endgroup]", "##[error]Process completed with exit code 1."]
    _, signals, _ = strip(lines(spark, a=gha), "github-actions")
    assert signals.collect()[0].attrs == {"exit_code": "1", "step": "g6"}


def test_white_space_of_other_kinds(spark):
    text = "ERROR\x0bx\xa0\n\xa0 ERROR y \xa0\t\r\néERROR\n"
    got = sift_logs(whole(spark, a=text), SiftOptions(format="generic", envelope="none")).events.orderBy("seq").collect()
    assert [e.title for e in got] == ["ERROR\x0bx\xa0", "\xa0 ERROR y \xa0", "éERROR"] and got[1].body == ["\xa0 ERROR y \xa0\t"]


def test_command_line(spark, tmp_path, monkeypatch, capfdbinary):
    import io
    import sys
    import types

    from millrace.__main__ import main

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(Path, "home", lambda: tmp_path)
    monkeypatch.setattr(sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(b"fine\r\nno end")))
    assert main(["run", "generic", "--passthrough"]) == 0 and b"fine\r\nno end" in capfdbinary.readouterr().out
    monkeypatch.setattr(sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(b"ERROR x\n")))
    assert main(["run", "--no-footer", "-v", "-"]) == 0
    said = capfdbinary.readouterr()
    assert said.out.startswith(b"events from generic\n\n[1] ERROR ERROR x\n") and b"format: generic" in said.err
    (tmp_path / "a").write_text("--- FAIL: T (0s)\n")
    assert main(["detect", str(tmp_path / "a")]) == 0 and b"format: gotest\n" in capfdbinary.readouterr().out


def test_stream(spark, tmp_path):
    shape = "log_id string, line_no long, line string"
    parts = [[("a", 1, "ERROR x"), ("a", 2, "p")], [("a", 3, "q"), ("b", 1, "Traceback x"), ("b", 2, "  in")], [("b", 3, "KeyError: k"), ("a", 4, "r"), ("b", 4, None)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold_stream(source, "generic", GenericFold).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(Path(tmp_path) / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.log_id, r.title): r for r in spark.table("folded").collect()}
    assert got["a", "ERROR x"].context == ["p", "q", "r"] and got["b", "KeyError: k"].body == ["Traceback x", "  in", "KeyError: k"]


def test_rules_search_their_own_text_first(spark):
    rng = random.Random(5)
    parts = [P.needed(p) for p, _, _ in P.CATALOGUE] + [" ", "x", "_", "ERRORS", "caused By:", "W1234:", "IOException:", "WARNING", "KeyError:", "\x1b[31m", "é"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))),) for _ in range(2000)]
    got = generic.classified(spark.createDataFrame(rows, "line string")).select("line", "severity", "kind").collect()
    rules = [(P.python(p), severity, kind) for p, severity, kind in P.CATALOGUE]
    for r in got:
        plain = re.sub(P.ANSI, "", r.line)
        assert (r.severity, r.kind) == next(((s, k) for p, s, k in rules if p.search(plain)), (None, None)), r.line
    assert len({r.kind for r in got}) == 6


def test_white_space_and_estimate_by_class(spark):
    rng = random.Random(6)
    chars = SPACES + "aZ09é١ß漢.-_(\u200b\x1c\x00"
    rows = [("".join(rng.choice(chars[: 14 if i % 2 else None]) for _ in range(rng.randint(0, 9))) + rng.choice(["", "b-", "é"]),) for i in range(2000)] + [(None,)]
    space, word = r"[\t\n\x0B\f\r \x{0085}\p{Z}]", r"[\p{L}\p{Nd}]"
    t = spark.createDataFrame(rows, "t string").select("t", trimmed(F.col("t")).alias("bare"), estimate(F.col("t")).alias("n"))
    t = t.withColumn("bare0", F.regexp_replace("t", f"^{space}+|{space}+$", "")).withColumn("words", F.size(F.regexp_extract_all("t", F.lit(f"{word}+"), F.lit(0))))
    t = t.withColumn("symbols", F.size(F.regexp_extract_all("t", F.lit(r"[^\p{L}\p{Nd}\t\n\x0B\f\r \x{0085}\p{Z}]+"), F.lit(0))))
    for r in t.collect():
        assert r.bare == r.bare0
        assert r.n == (None if r.t is None else math.floor((r.words * 1.3 + r.symbols) * 1.1 + 0.5)), ascii(r.t)
