"""Classification, pruning, pins and metering over hand-written sessions: the branches that the driver's tables never reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.scenes import big, block, call, frame, message, result, run, said, used, user
from threadloom.functions import keys, tokens
from threadloom.functions import text as tx
from threadloom.operators import analysis, items, pins, prune
from threadloom.schema import ENGINE_ID

AT = "2024-01-01T00:00:00.000Z"


def padded(target, n=8):
    """``target`` and then ``n`` fresh results that push it out of the recent ones."""
    return target + [m for i in range(n) for m in used("bash", {"command": f"python p{i}.py"}, f"new{i}", f"pad{i}")]


SCENES = {
    "install": used("bash", {"command": "npm install"}, big("added 1 package"), "a"),
    "failed install": used("bash", {"command": "npm install"}, "ERESOLVE conflict\n" + big("error", 200), "a", True),
    "read edit read": [user("fix it"), *used("read", {"path": "src/a.py"}, "v1", "a"), *used("edit", {"path": "src/a.py"}, "ok", "b"), *used("read", {"path": "./src/A.py"}, "v2", "c"), said("done")],
    "tests": [user("run"), *used("bash", {"command": "pytest tests/"}, "FAIL test_a\nAssertionError", "a", True), *used("bash", {"command": "pytest tests/"}, "217 passed in 3.2s", "b"), *used("bash", {"command": "pytest tests/"}, "220 passed", "c")],
    "unclear test": used("bash", {"command": "pytest tests/"}, "no outcome here", "a"),
    "trivial": [run("git status", "clean\n"), run("ls", "", 2), run("pwd", "", 0, True)],
    "diffs": [*used("bash", {"command": "git diff"}, big("+diff", 300), "a"), *used("bash", {"command": "git diff"}, "+diff2", "b"), run("git diff --stat", "a.py | 2 +-")],
    "errors": [*used("bash", {"command": "python x.py"}, "boom", "a", True), *used("bash", {"command": "python  X.py"}, "boom", "b", True)],
    "listings": [*used("ls", {"path": "src"}, "a b", "a"), *used("ls", {"path": "SRC "}, "a b", "b"), *used("ls", {}, "x", "c")],
    "searches": [*used("find", {"pattern": "*.py"}, "a", "a"), *used("find", {"pattern": "*.py"}, "a", "b"), *used("grep", {"pattern": "x", "glob": "*.ts"}, "a", "c"), *used("grep", {"pattern": "x", "path": "*.ts"}, "a", "d"), *used("grep", {"pattern": " "}, "a", "e")],
    "old outputs": padded([*used("bash", {"command": "python small.py"}, "1", "s"), *used("bash", {"command": "seq 1 3000"}, big("seq"), "b"), *used("grep", {"pattern": "old"}, "g", "g"), *used("write", {"path": "w.py"}, "w", "w"), result("custom_tool", "c")]),
    "others": [result("custom_tool", "text"), result("custom_tool", "bad", None, True), result(None, "orphan", "nowhere"), message("custom", content_text="note", custom_type="memo"), message("system", content_text="sys")],
    "summaries": [message("compactionSummary", summary="earlier work"), message("branchSummary", summary="a branch")],
    "stub": [result("bash", "[x] pruned", None, details_json='{"engine": "%s", "kind": "stub"}' % ENGINE_ID), result("bash", "x", None, details_json='{"engine": "another"}')],
    "twice the same id": [call("read", {"path": "one.py"}, "same"), call("read", {"path": "two.py"}, "same"), result("read", "which", "same")],
    "parallel calls": [said(block("toolCall", id="p", name="read", arguments_json='{"path": "p.py"}'), block("toolCall", id="q", name="read", arguments_json='{"file_path": "q.py"}')), result("read", "q text", "q"), result("read", "p text", "p")],
    "bad arguments": [said(block("toolCall", id="b", name="read", arguments_json="{broken")), result("read", "t", "b"), said(block("toolCall", id="n", name="bash", arguments_json='{"command": 7}')), result("bash", "t", "n")],
}


@pytest.fixture(scope="module")
def classified(spark):
    rows = items.classify(frame(spark, SCENES)).select("session_id", "message_index", "class", "importance", "tags", "reason", "type", "source", "superseded_by", "related_files", "engine_stub").collect()
    return {(r.session_id, r.message_index): r for r in rows}


def has(row, cls, importance, *tags):
    assert (row["class"], row.importance) == (cls, importance), row
    assert [t for t in row.tags if t] == list(tags), row


def test_install_noise_and_its_failure(classified):
    has(classified["install", 1], "disposable", 10, "bash", "install", "noise")
    has(classified["failed install", 1], "working", 90, "bash", "install", "active-failure")
    assert classified["failed install", 1].reason == "failing build/install output"


def test_reads_of_one_file(classified):
    old, edit, new = (classified["read edit read", i] for i in (2, 4, 6))
    has(old, "stale", 25, "read", "superseded-read")
    has(edit, "working", 85, "edit", "file-mutation", "active-diff")
    has(new, "working", 70, "read", "file-read")
    assert old.superseded_by == 6 and old.related_files == new.related_files == ["src/a.py"] and new.superseded_by is None
    has(classified["read edit read", 0], "critical", 100, "user", "latest-user")
    has(classified["read edit read", 1], "working", 60, "assistant", "tool-call")
    has(classified["read edit read", 7], "working", 60, "assistant", "reasoning")


def test_runs_of_one_suite(classified):
    has(classified["tests", 2], "stale", 25, "bash", "test", "superseded-failure")
    has(classified["tests", 4], "stale", 20, "bash", "test", "superseded-pass")
    has(classified["tests", 6], "working", 30, "bash", "test", "pass")
    has(classified["unclear test", 1], "working", 60, "bash")


def test_trivial_commands(classified):
    has(classified["trivial", 0], "disposable", 10, "bash", "trivial")
    has(classified["trivial", 1], "working", 40, "bash", "trivial", "active-failure")
    has(classified["trivial", 2], "working", 40, "bash", "trivial", "active-failure")


def test_diffs(classified):
    has(classified["diffs", 1], "stale", 20, "bash", "old-diff")
    has(classified["diffs", 3], "working", 85, "bash", "active-diff")
    has(classified["diffs", 4], "disposable", 10, "bash", "trivial")


def test_errors_of_one_command(classified):
    has(classified["errors", 1], "stale", 25, "bash", "superseded-error")
    has(classified["errors", 3], "working", 90, "bash", "active-failure")


def test_listings_and_searches(classified):
    has(classified["listings", 1], "disposable", 5, "ls", "duplicate")
    has(classified["listings", 3], "disposable", 10, "ls", "listing")
    has(classified["listings", 5], "disposable", 10, "ls", "listing")
    has(classified["searches", 1], "stale", 15, "find", "duplicate-search")
    has(classified["searches", 3], "working", 40, "find", "search")
    has(classified["searches", 5], "stale", 15, "grep", "duplicate-search")  # a path and a glob share their place in the key
    has(classified["searches", 9], "working", 40, "grep", "search")


def test_what_is_no_longer_recent(classified):
    has(classified["old outputs", 1], "working", 35, "bash", "old-output")
    has(classified["old outputs", 3], "stale", 20, "bash", "old-output", "oversized")
    has(classified["old outputs", 5], "stale", 25, "grep", "search")
    has(classified["old outputs", 7], "stale", 35, "write", "file-mutation")
    has(classified["old outputs", 8], "stale", 20, "custom_tool")


def test_other_messages(classified):
    has(classified["others", 0], "working", 40, "custom_tool")
    has(classified["others", 1], "working", 90, "custom_tool", "active-failure")
    assert classified["others", 2].source == "unknown" and classified["others", 2].superseded_by is None
    has(classified["others", 3], "working", 50, "memo", "custom")
    assert classified["others", 4].type == "custom"
    has(classified["summaries", 0], "critical", 80, "summary")
    has(classified["summaries", 1], "critical", 80, "summary")
    has(classified["stub", 0], "disposable", 5, "engine-stub")
    assert classified["stub", 0].engine_stub and not classified["stub", 1].engine_stub


def test_answers_find_their_calls(classified):
    assert classified["twice the same id", 2].related_files == ["two.py"]
    assert classified["parallel calls", 1].related_files == ["q.py"] and classified["parallel calls", 2].related_files == ["p.py"]
    assert classified["bad arguments", 1].related_files == [] and classified["bad arguments", 3]["class"] == "working"


RANGES = {
    "apart": [{"offset": 0, "limit": 100}, {"offset": 200, "limit": 100}],
    "overlapping": [{"offset": 0, "limit": 100}, {"offset": 50, "limit": 100}],
    "part then whole": [{"offset": 0, "limit": 100}, {}],
    "whole then part": [{}, {"offset": 5, "limit": 1}],
    "names": [{"start_line": 1, "end_line": 9}, {"line_start": 9}, {"offset": "7"}, {"offset": 30, "limit": 0}],
    "first that overlaps": [{"offset": 0, "limit": 10}, {"offset": 20, "limit": 10}, {"offset": 5, "limit": 10}, {"offset": 0, "limit": 3}, {}, {"offset": 0, "limit": 3}],
}


def test_ranges_of_reads(spark):
    sessions = {s: [m for i, r in enumerate(all_) for m in used("read", {"path": "f.ts", **r}, "t", f"{i}")] for s, all_ in RANGES.items()}
    rows = items.superseded(items.with_calls(frame(spark, sessions))).where("role = 'toolResult'").collect()
    by = {s: [r.superseded_by for r in sorted((x for x in rows if x.session_id == s), key=lambda r: r.message_index)] for s in sessions}
    assert by == {"apart": [None, None], "overlapping": [3, None], "part then whole": [3, None], "whole then part": [3, None], "names": [3, 5, 7, None], "first that overlaps": [5, 9, 9, 9, 11, None]}


def test_many_reads_against_the_plain_rule(spark):
    import random

    rng = random.Random(3)
    reads = [{} if rng.random() < 0.1 else {"offset": rng.randrange(60), "limit": rng.randrange(1, 15)} for _ in range(150)]
    span = lambda r: (0, 1e9) if not r else (r["offset"], r["offset"] + r["limit"] - 1)
    want = []
    for i, a in enumerate(reads):
        hit = next((j for j in range(i + 1, len(reads)) if not a or not reads[j] or max(span(a)[0], span(reads[j])[0]) <= min(span(a)[1], span(reads[j])[1])), None)
        want.append(None if hit is None else 2 * hit + 1)
    rows = items.superseded(items.with_calls(frame(spark, {"s": [m for i, r in enumerate(reads) for m in used("read", {"path": "f", **r}, "t", str(i))]}))).where("role = 'toolResult'")
    assert [r.superseded_by for r in rows.orderBy("message_index").collect()] == want


def test_one_exchange_for_a_session(spark):
    plan = items.classify(frame(spark, SCENES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_categories(spark):
    cases = {
        "npm install": "install", "pnpm add foo": "install", "pip install requests": "install", "uv sync": "install", "cargo build --release": "build", "cargo fetch": "install", "npm run build": "normal",
        "pytest tests/": "test", "python -m pytest -x": "test", "npm test": "test", "go test ./...": "test", "jest": "test", "docker build .": "build", "wget https://example.com/x.tar.gz": "fetch",
        "curl -o x https://example.com": "fetch", "ls": "trivial", "pwd": "trivial", "git status": "trivial", "echo hello": "trivial", "python main.py": "normal", "git diff": "gitdiff", "git diff --stat": "trivial", "": "normal",
    }
    rows = spark.createDataFrame(list(cases.items()), "c string, want string").select("c", "want", tx.command_category(F.col("c")).alias("got"), tx.is_noise_command(F.col("c"), F.lit(False)).alias("noise"), tx.is_noise_command(F.col("c"), F.lit(True)).alias("failed")).collect()
    assert {r.c: r.got for r in rows} == cases
    assert all(r.noise == (r.got in ("install", "fetch", "trivial", "build")) and not r.failed for r in rows)
    outcomes = {"217 passed in 3.2s": "pass", "3 failed, 214 passed": "fail", "Traceback (most recent call last):": "fail", "random output": "unknown"}
    rows = spark.createDataFrame(list(outcomes.items()), "t string, want string").select("t", tx.test_outcome(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == outcomes
    same = spark.range(1).select(keys.test_key(F.lit("pytest tests/parser")).alias("a"), keys.test_key(F.lit("pytest tests/api")).alias("b"), keys.normalized_command(F.lit("  Git   Status ")).alias("c")).first()
    assert same.a != same.b and same.c == "git status"
    types = {"Don't touch it": "constraint", "you must run it": "requirement", "src/a.py:12": "file", "use npm here": "command", "不要改": "constraint", "必须运行": "requirement", "just so": "note", "npm " * 40: "note"}
    rows = spark.createDataFrame(list(types.items()), "t string, want string").select("t", tx.pin_type(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == types


def test_tokens(spark):
    texts = {"Hello world!": 3, "你好，世界！": 4, "Hello world! 你好世界！": 7, "": 0, "🙂": 1, "🙂" * 3: 3, "é" * 8: 2, "カナ": 2}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.text_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts
    blocks = {
        "image": [said(block("image"))], "thinking": [said(block("thinking", thinking="x" * 40))], "thinking text": [said(block("thinking", text="x" * 8))], "other": [said(block("video"))],
        "call": [call("read", {"path": "a"}, "i")], "summary": [message("compactionSummary", summary="x" * 8)], "run": [run("ls", "x" * 8)], "details": [result("t", "x" * 8, details_json="y" * 5000)], "user": [user("x" * 8)],
    }
    rows = frame(spark, blocks).select("session_id", tokens.message_tokens().alias("n"), tokens.message_text().alias("t")).collect()
    assert {r.session_id: r.n for r in rows} == {"image": 1624, "thinking": 34, "thinking text": 26, "other": 56, "call": 35, "summary": 98, "run": 27, "details": 274, "user": 18}
    texts = {r.session_id: r.t for r in rows}
    assert texts["call"] == 'call:read({"path": "a"})' and texts["thinking"] == "x" * 40 and texts["image"] == texts["run"] == ""
    marks = spark.createDataFrame([("",), ("x" * 5000,), ("y" * 5000,), ("x" * 4999 + "y",)], "t string").select(tokens.fingerprint(F.col("t")).alias("f")).collect()
    assert marks[0].f == "0:empty" and len({m.f for m in marks}) == 4


def acted(spark, sessions, **options):
    return prune.actions(items.classify(frame(spark, sessions)), **options)


def test_pruning_leaves_pairs_and_people_alone(spark):
    scene = {"s": [user("please don't change the CLI"), *used("bash", {"command": "npm install"}, big("noise"), "z"), said("I will keep it."), *used("bash", {"command": "seq 1 3000"}, big("seq"), "f")]}
    rows = acted(spark, scene).cache()
    kinds = {r.message_index: r.kind for r in rows.collect()}
    assert kinds == {0: "keep", 1: "keep", 2: "stub", 3: "keep", 4: "keep", 5: "fold"}
    before, after = ({r.message_index: r for r in df.collect()} for df in (frame(spark, scene), prune.rewritten(rows, AT)))
    assert all(before[i] == after[i] for i in (0, 1, 3, 4))
    stub = after[2]
    assert (stub.role, stub.tool_call_id, stub.tool_name) == ("toolResult", "z", "bash") and len(stub.blocks[0].text) < 400 and '"kind":"stub"' in stub.details_json
    # a second pass finds nothing left to do
    again = prune.actions(items.classify(prune.rewritten(rows, AT)))
    assert again.where("kind <> 'keep'").count() == 0
    summary = prune.action_summary(rows).first()
    assert summary.n_actions == 2 and summary.removed_tokens > 8000


def test_runs_are_rewritten_in_their_output(spark):
    rows = acted(spark, {"s": [run("npm install", big("noise")), run("python a.py", "short")]})
    after = {r.message_index: r for r in prune.rewritten(rows, AT).collect()}
    assert after[0].output.startswith(f"[{ENGINE_ID}] bash result pruned") and after[0].blocks is None and after[1].output == "short"


def test_a_replacement_must_be_smaller(spark):
    text = "x" * 150  # 54 tokens: a stub would take more
    rows = acted(spark, {"s": used("bash", {"command": "npm install"}, text, "a"), "t": used("bash", {"command": "npm install"}, "x" * 4000, "a")}, stub_min=20)
    assert {(r.session_id, r.kind) for r in rows.where("role = 'toolResult'").collect()} == {("s", "keep"), ("t", "stub")}
    assert {r.session_id for r in prune.effective(rows, AT).collect()} == {"t"}


def test_folds_keep_notable_lines(spark):
    lines = [f"info line {i}: normal execution log" for i in range(60)]
    lines[25] = "FAILED test_login: assertion error"
    lines[40] = "  ValueError: x" + "y" * 300
    text = "\n".join(lines)
    fold = lambda command, t, most: spark.createDataFrame([(t,)], "t string").select(prune._cut(prune.fold_output(F.lit(command), F.col("t"), F.split("t", "\n"), most), F.lit(most)).alias("f")).first().f
    got = fold("npm test", text, 9000)
    parts = got.split("\n\n")
    assert parts[0].split("\n")[1] == "command: npm test" and parts[1] == "-- head --\n" + "\n".join(lines[:8]) and parts[3] == "-- tail --\n" + "\n".join(lines[-6:]) and parts[4] == "(46 lines folded)"
    notable = parts[2].split("\n")[1:]
    assert notable[:5] == lines[23:28] and notable[7] == lines[40].strip()[:160] and len(notable) == 10
    assert fold("x" * 300, text, 500).endswith("\n…[truncated]") and "x" * 200 + "…\n" in fold("x" * 300, text, 500)
    assert fold("c", "\n".join(lines[:18]), 10_000) == "\n".join(lines[:18]) and "folded" in fold("c", "\n".join(lines[:19]), 10_000)
    many = "\n".join(f"error {i}" for i in range(100))
    assert fold("c", many, 9000).split("-- notable lines --\n")[1].split("\n\n")[0].count("\n") == 14
    reads = spark.createDataFrame([("\n".join(f"l{i}" for i in range(n)),) for n in (63, 64)], "t string").select(prune.fold_text(F.col("t"), F.split("t", "\n"), F.lit(2200)).alias("f")).collect()
    assert reads[0].f.count("\n") == 62 and f"[{ENGINE_ID} … 4 lines folded …]" in reads[1].f and reads[1].f.endswith("l63")


def pin(kind, content, active=True, at=1, session="s", pid=None):
    return (session, pid or f"{kind}{at}", kind, content, at, None, "manual", active)


PIN_SCHEMA = "session_id string, id string, type string, content string, created_at long, source_message_id string, expires string, active boolean"


def test_pinned_items(spark):
    sessions = {"s": [*used("read", {"path": "src/a.py"}, "code", "a"), *used("read", {"path": "src/b.py"}, "never touch PROD", "b"), result("bash", "never touch prod", None, details_json='{"engine": "%s"}' % ENGINE_ID)], "t": used("read", {"path": "src/a.py"}, "x", "a")}
    given = spark.createDataFrame([pin("file", "./src/A.py"), pin("constraint", "  Never touch prod ", at=2), pin("note", "code", False, 3), pin("note", "  ", at=4)], PIN_SCHEMA)
    rows = {(r.session_id, r.message_index): r for r in items.classify(frame(spark, sessions), given).collect()}
    assert [rows["s", i].pinned for i in range(5)] == [False, True, False, True, False] and not rows["t", 1].pinned
    assert (rows["s", 1]["class"], rows["s", 1].importance, rows["s", 1].tags[-1]) == ("critical", 100, "pinned")


def test_pins_stay_in_view(spark):
    messages = frame(spark, {"s": [user("Keep the API stable"), said("yes")], "t": [user("hello")], "u": [user("x")]})
    given = spark.createDataFrame(
        [pin("constraint", "keep the API"), pin("constraint", "never force-push", at=2), pin("note", "gone", False, 3), pin("file", "src/Main.py", at=4), pin("note", "hello", session="t")], PIN_SCHEMA)
    lost = {(r.session_id, r.id) for r in pins.missing_pins(messages, given).collect()}
    assert lost == {("s", "constraint2"), ("s", "file4")}
    whole = pins.with_pins(messages, given, 9)
    (added,) = whole.where("role = 'custom'").collect()
    assert (added.session_id, added.message_index) == ("s", 2)
    assert added.content_text.split("\n")[1:] == ["- [constraint] never force-push", "- [file] pinned file: src/Main.py"]
    assert pins.missing_pins(whole, given).count() == 0 and pins.with_pins(whole, given, 9).count() == whole.count()


def test_pins_are_added_once(spark):
    have = spark.createDataFrame([pin("constraint", "a"), pin("file", "src/X.py", at=2), pin("note", "off", False, 3)], PIN_SCHEMA)
    new = spark.createDataFrame([pin("constraint", " a ", at=5, pid="n1"), pin("constraint", "A", at=6, pid="n2"), pin("file", "SRC/x.py", at=7, pid="n3"), pin("note", "off", at=8, pid="n4"), pin("note", " ", at=9, pid="n5")], PIN_SCHEMA)
    got = pins.add_pins(have, new)
    assert {r.id for r in got.collect()} == {"constraint1", "file2", "note3", "n2", "n4"}
    assert {r.id for r in pins.remove_pin(got, "s", "n2").collect()} == {"constraint1", "file2", "note3", "n4"}


def test_reported_usage_and_calibration(spark):
    rows = items.classify(frame(spark, {"s": [user("x" * 4000)], "t": [user("x" * 4000)]}))
    usage = spark.createDataFrame([("s", 100_000, 200_000, 4096, None), ("t", None, 32_768, None, 2.0)], "session_id string, tokens long, context_window long, max_tokens long, ratio double")
    got = {r.session_id: r for r in analysis.analyze(rows, usage).collect()}
    assert (got["s"].total_tokens, got["s"].usable_tokens) == (100_000, 191_808)
    assert (got["t"].total_tokens, got["t"].usable_tokens) == (2 * 1016 + 4000, 20_480)
    same = analysis.analyze_with_consumers(rows)
    assert {(r.session_id, r.raw_tokens, tuple(r.top)) for r in same.collect()} == {("s", 1016, ()), ("t", 1016, ())}


def test_other_meters(spark):
    rows = items.classify(frame(spark, {"s": [user("abcd"), user("x")]}), estimator=F.when(F.col("message_index") == 0, F.lit(77).cast("long")))
    assert {r.message_index: r.estimated_tokens for r in rows.collect()} == {0: 77, 1: 17}
