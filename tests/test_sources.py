"""Session logs, states, audit rows, commands, checkpoints and hand-offs over hand-written rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.scenes import big, frame, message, result, run, said, used, user
from tests.test_rules import AT, PIN_SCHEMA, pin
from threadloom.functions import tokens
from threadloom.operators import analysis, checkpoints, commands, items, pins, prune
from threadloom.schema import MESSAGES
from threadloom.sources import logs


def lines(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return f"file://{path}"


def test_entries_of_a_log_become_messages(spark, tmp_path):
    text = lambda t: {"type": "text", "text": t}
    entries = [
        {"type": "model_change", "id": "m"}, {"type": "message", "id": "1", "message": {"role": "user", "content_text": "hi", "ts_ms": 5}}, {"type": "compaction", "summary": "so far", "ts_ms": 6},
        {"type": "message", "message": {"role": "toolResult", "tool_call_id": "c", "tool_name": "read", "is_error": True, "blocks": [text("a"), text("b")]}},
        {"type": "custom_message", "content_text": "pins", "custom_type": "p", "details_json": "{}"}, {"type": "branch_summary", "summary": "side"}, {"type": "label"},
    ]
    path = lines(tmp_path, "log.jsonl", [{"session_id": "s", "entries": entries}, "", {"session_id": "t", "entries": []}, {"session_id": "u", "entries": [entries[1]]}])
    df = logs.read_messages(spark, path)
    assert df.columns == [f.split(" ")[0] for f in MESSAGES.split(", ")]
    rows = df.where("session_id = 's'").withColumn("text", tokens.message_text()).orderBy("message_index").collect()
    assert [(r.message_index, r.role, r.text, r.summary) for r in rows] == [(0, "user", "hi", None), (1, "compactionSummary", "", "so far"), (2, "toolResult", "a\nb", None), (3, "custom", "pins", None), (4, "branchSummary", "", "side")]
    assert rows[0].ts_ms == 5 and rows[1].ts_ms == 6 and rows[2].is_error and rows[2].tool_call_id == "c" and rows[3].custom_type == "p"
    assert df.where("session_id = 'u'").count() == 1 and df.where("session_id = 't'").count() == 0
    frame(spark, {"s": [user("x")]}).write.parquet(f"{tmp_path}/m.parquet")
    assert logs.read_messages(spark, f"{tmp_path}/m.parquet").count() == 1


def test_broken_lines(spark, tmp_path):
    path = lines(tmp_path, "x.jsonl", ['{"id": "a"}', "  ", "{broken"])
    assert [r.id for r in logs.read_jsonl(spark, path, "id string", strict=False).collect()] == ["a", None]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        logs.read_jsonl(spark, path, "id string").collect()
    pins_path = lines(tmp_path, "p.jsonl", [{"session_id": "s", "id": "a", "type": "note", "content": "c"}, {"session_id": "s", "content": "no id"}, "{broken"])
    assert [r.id for r in logs.read_pins(spark, pins_path).collect()] == ["a"]
    states = lines(tmp_path, "s.jsonl", [{"session_id": "s", "state": {"turn": 3}}, {"session_id": "t"}, {"state": {}}, "{broken"])
    assert [tuple(r) for r in logs.read_states(spark, states).collect()] == [("s", '{"turn":3}')]


def test_a_stale_snapshot_gives_way_to_the_log(spark):
    cached, log = (frame(spark, {s: [user(f"{w} {s}")] for s in "abc"}).withColumn("leaf_id", F.lit("1")) for w in ("cached", "log"))
    leaves = spark.createDataFrame([("a", "1"), ("b", "2")], "session_id string, leaf_id string")
    assert {r.session_id: r.content_text for r in logs.snapshot_or_log(cached, log, leaves).collect()} == {"a": "cached a", "b": "log b", "c": "log c"}
    entries = spark.createDataFrame([("a", "compaction"), ("a", "message"), ("a", "compaction"), ("b", "message")], "session_id string, type string")
    assert {r.session_id: r.compactions for r in logs.compaction_counts(entries).collect()} == {"a": 2, "b": 0}


def test_numbers_of_checkpoints(spark):
    have = spark.createDataFrame([("s", 1, "x"), ("s", 7, "y"), ("t", 2, "z")], "session_id string, checkpoint_no int, created_at string")
    assert {(r.session_id, r.checkpoint_no) for r in logs.latest_checkpoints(have).collect()} == {("s", 7), ("t", 2)}
    new = spark.createDataFrame([("s", "b"), ("s", "a"), ("n", "c")], "session_id string, created_at string")
    assert {(r.session_id, r.created_at, r.checkpoint_no) for r in logs.numbered(new, have).collect()} == {("s", "a", 8), ("s", "b", 9), ("n", "c", 1)}


def test_latest_rows_replace_a_sessions_own(spark, tmp_path):
    path, schema = f"{tmp_path}/state", "session_id string, state string"
    logs.write_latest(spark.createDataFrame([(f"s{i}", "old") for i in range(40)], schema), path)
    logs.write_latest(spark.createDataFrame([("s1", "new"), ("s2", "new"), ("s2", "more"), ("x", "new")], schema), path)
    rows = sorted((r.session_id, r.state) for r in spark.read.parquet(path).collect())
    assert len(rows) == 42 and [r for r in rows if r[1] != "old"] == [("s1", "new"), ("s2", "more"), ("s2", "new"), ("x", "new")]


@pytest.fixture(scope="module")
def acted(spark):
    scene = {"s": [user("go on, but never push"), *used("bash", {"command": "npm install"}, big("noise"), "a"), *used("bash", {"command": "seq 1 9"}, big("seq"), "b")], "t": [user("  ")]}
    return prune.actions(items.classify(frame(spark, scene)))


def test_audit_rows(spark, acted):
    log = logs.prune_log(acted, AT, "manual")
    rows = {r.item_id: r for r in log.collect()}
    assert {k: (r.action, r.tool, r.mode) for k, r in rows.items()} == {"toolResult:2": ("stub", "bash", "manual"), "toolResult:4": ("fold", "bash", "manual")}
    assert rows["toolResult:2"].original_tokens > rows["toolResult:2"].replacement_tokens and "noise" in rows["toolResult:2"].tags
    totals = spark.createDataFrame([("s", 9000, 1000), ("t", 5, 5)], "session_id string, tokens_before long, tokens_after long")
    (event,) = logs.prune_events(log, totals).collect()
    assert (event.session_id, event.action, event.actions, event.saved) == ("s", "prune", 2, 8000)
    usage = spark.createDataFrame([("s", 1, AT, 100, 0.5), ("s", 2, AT, None, None)], "session_id string, turn int, time string, tokens long, percent double")
    plans = spark.createDataFrame([("s", 1, 2, 3), ("s", 2, 2, 3)], "session_id string, turn int, compactions int, checkpoints int")
    (metric,) = logs.turn_metrics(usage, plans).collect()
    assert (metric.action, metric.context_tokens, metric.compactions, metric.checkpoints) == ("metric", 100, 2, 3)
    events = spark.createDataFrame([("s", f"2024-01-0{i}", "prune" if i % 2 else "metric", '{"n":%d}' % i) for i in range(1, 9)], "session_id string, time string, action string, data string")
    (shown,) = commands.history_lists(log, events, n=3).collect()
    assert shown.text.split("\n") == [f"#toolResult:2 stub bash {_k(rows['toolResult:2'])} — install command succeeded; output is noise", f"#toolResult:4 fold bash {_k(rows['toolResult:4'])} — recent successful command output", '2024-01-03 prune {"n":3}', '2024-01-05 prune {"n":5}', '2024-01-07 prune {"n":7}']
    last = logs.history(log.withColumn("time", F.col("item_id")), events, n=2)
    assert sorted(r.time for r in last.collect()) == ["2024-01-05", "2024-01-07", "toolResult:2", "toolResult:4"]


def _k(row):
    short = lambda n: f"{n / 1000:.1f}K" if n >= 1000 else str(n)
    return f"{short(row.original_tokens)}→{short(row.replacement_tokens)}"


def test_a_clean_arms_sessions_with_something_to_prune(acted):
    (row,) = commands.cleaned(acted, analysis.analyze(acted), 77).collect()
    assert (row.session_id, row.clean_at_ms) == ("s", 77) and row.tokens_after < row.tokens_before - 8000


def test_pin_commands(spark, acted):
    messages = frame(spark, {"s": [user("first"), said("x"), user("  never push " + "y" * 600)], "t": [user("  ")], "u": [said("only me")]})
    (last,) = commands.pin_last(messages, 5).collect()
    assert (last.session_id, last.type, len(last.content), last.created_at, last.active) == ("s", "constraint", 500, 5, True)
    typed = commands.pin_texts(spark.createDataFrame([("s", " src/a.py "), ("s", " "), ("t", "some note")], "session_id string, text string"), 6)
    assert {(r.session_id, r.type, r.content) for r in typed.collect()} == {("s", "file", "src/a.py"), ("t", "note", "some note")}
    files = commands.pin_files(spark.createDataFrame([("s", "any thing")], "session_id string, path string"), 7)
    whole = pins.add_pins(spark.createDataFrame([pin("note", "z" * 150, False)], PIN_SCHEMA), typed.unionByName(files))
    shown = {r.session_id: r.text.split("\n") for r in commands.pin_lists(whole).collect()}
    assert shown["s"][0] == "✗ note1 [note] " + "z" * 100 + " (inactive)" and shown["s"][1].endswith("[file] src/a.py") and shown["s"][2].startswith("✓ pin-") and len(shown["t"]) == 1


GOOD = {
    "version": 1, "created_at": "2024-01-01T00:00:00.000Z", "task": {"goal": "ship it", "phase": "build", "status": "blocked"}, "requirements": ["r1"], "constraints": ["never drop"],
    "decisions": [{"decision": "use X", "reason": "", "status": "active"}], "files": {"inspected": ["i.py"], "modified": ["m.py"], "created": ["c.py"], "deleted": []},
    "verification": {"passed": ["a", "b"], "failed": [], "pending": ["c"]}, "issues": [{"description": "slow", "status": "open"}], "next_actions": ["one", "two", "three"],
}


def errors(spark, *documents):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "session_id int, reply string")
    return [r.errors for r in checkpoints.validated(rows).orderBy("session_id").collect()]


def test_checkpoints_are_checked_field_by_field(spark):
    over = lambda **kw: {**GOOD, **kw}
    no = lambda key: {k: v for k, v in GOOD.items() if k != key}
    cases = [
        (GOOD, []), (no("version"), []), (no("created_at"), []), (no("issues"), []), (over(decisions=[{"decision": "d"}]), []), (over(task={"goal": "g"}), []),
        (over(version=2), ["unsupported version 2 (expected 1)"]), (over(version="1"), ['unsupported version "1" (expected 1)']), (over(created_at="soon"), ["created_at must be an ISO-8601 timestamp string"]), (over(created_at=5), ["created_at must be an ISO-8601 timestamp string"]),
        (over(task=7), ["task must be an object", "task.goal is required and must be a non-empty string"]), (over(task={"goal": "  "}), ["task.goal is required and must be a non-empty string"]),
        (over(task={"goal": "g", "phase": 1}), ["task.phase must be a string"]), (over(task={"goal": "g", "status": "open"}), ["task.status must be one of in_progress | blocked | done"]),
        (no("requirements"), ["requirements must be an array"]), (over(constraints=["a", 3, None]), ["constraints[1] must be a string", "constraints[2] must be a string"]), (over(next_actions="x"), ["next_actions must be an array"]),
        (over(files={}), [f"files.{k} must be an array" for k in ("inspected", "modified", "created", "deleted")]), (over(issues=[{"description": "d", "status": "gone"}]), ["issues[0].status must be one of open | resolved | blocked"]),
        (over(issues=[3, {"description": ""}]), ["issues[0] must be an object", "issues[1].description must be a non-empty string"]), (over(decisions=[{"decision": "d", "reason": 4, "status": "x"}]), ["decisions[0].reason must be a string", "decisions[0].status must be one of active | superseded | abandoned"]),
        (no("decisions"), ["decisions must be an array"]), ([1], ["checkpoint must be a JSON object"]), (None, ["checkpoint must be a JSON object"]),
    ]
    assert errors(spark, *(d for d, _ in cases)) == [e for _, e in cases]


def test_json_in_replies(spark):
    text = json.dumps(GOOD)
    replies = [text, f"```json\n{text}\n```", f"Sure!\n```\n{text}\n``` bye", f"Here: {text} done", "not json", "", None, "{broken", "```json\n{}"]
    rows = spark.createDataFrame([(str(i), r, "auto", 9) for i, r in enumerate(replies)], "session_id string, reply string, source string, tokens_before long")
    assert [r.ok for r in checkpoints.validated(rows).orderBy("session_id").collect()] == [True] * 4 + [False] * 5
    prompts = spark.createDataFrame([(str(i), "p") for i in range(9)] + [("none", None)], "session_id string, prompt string")
    got = {r.session_id: r for r in checkpoints.generated(prompts, rows).collect()}
    assert json.loads(got["1"].checkpoint) == GOOD | {"meta": {"session_id": "1", "tokens_before": 9, "source": "auto"}}
    assert got["4"].errors == ["checkpoint must be a JSON object"] and got["4"].checkpoint is None and not got["none"].ok and got["none"].errors == ["empty conversation — nothing to checkpoint"]


def test_serialised_sessions(spark):
    scene = {
        "s": [user("  "), user(" Fix the leak "), said("ok", {"type": "toolCall", "name": "read", "arguments_json": '{"path":"%s"}' % ("p" * 300)}), result("read", "  a\nb" + "x" * 500, "c", True), run("ls -la", "\n out \n" + "y" * 400 + "\n\n", 2), run("true", "", 0), message("compactionSummary", summary=" earlier "), message("custom", content_text="left out"), result("grep", " \n ", "d"), result("t", "  short\n\n", "e")],
        "empty": [user(" ")],
    }
    rows = {r.session_id: r.text for r in checkpoints.serialized(frame(spark, scene)).collect()}
    call = "call:read({\"path\":\"%s\"})" % ("p" * 300)
    assert rows["empty"] == "" and rows["s"].split("\n\n") == [
        "User: Fix the leak", f"Assistant: ok\n{call}\nTool read " + ('{"path":"' + "p" * 300)[:200], "Result(read [ERROR]): a b" + "x" * 397 + " …[truncated]", "Bash(ls -la): out  " + "y" * 395 + " … [exit 2]", "Bash(true): ", "[Earlier compaction summary]: earlier", "Result(t): short",
    ]
    long = {"s": [user("Fix the memory leak"), *(run(f"c{i}", big("out", 40)) for i in range(60)), said("Final message near the tail")]}
    given = spark.createDataFrame([pin("constraint", "Do not modify"), pin("note", "off", False, 2)], PIN_SCHEMA)
    (row,) = checkpoints.serialized(frame(spark, long), given, max_total=5000).collect()
    assert row.text.startswith("User (Initial Goal): Fix the memory leak\n\nActive Pins:\n- [constraint] Do not modify\n\n[... earlier") and row.text.endswith("Assistant: Final message near the tail") and len(row.text) <= 5100


def test_prompts_for_checkpoints(spark):
    given = spark.createDataFrame([pin("constraint", "keep"), pin("file", "a.py", at=2), pin("note", "off", False, 3)], PIN_SCHEMA)
    rows = {r.session_id: r for r in checkpoints.checkpoint_prompts(frame(spark, {"s": [user("hi")], "e": [user(" ")]}), given).collect()}
    assert rows["s"].prompt == "Generate the recovery checkpoint for this coding session.\nHard pins (must appear in constraints): keep | pinned file: a.py\n<conversation>\nUser: hi\n</conversation>" and rows["e"].prompt is None
    assert json.loads(rows["s"].system.split("schema:\n")[1].split("\n\nRules")[0])["task"]["status"] == "in_progress|blocked|done"
    (bare,) = checkpoints.checkpoint_prompts(frame(spark, {"s": [user("hi")]})).collect()
    assert "Hard pins" not in bare.prompt


def test_handoffs_and_instructions(spark):
    docs = spark.createDataFrame([("s", json.dumps(GOOD))], "session_id string, json string")
    given = spark.createDataFrame([pin("constraint", "never drop"), pin("requirement", "be quick", at=2), pin("file", "f.py", at=3), pin("constraint", "off", False, 4), pin("constraint", "alone", session="t")], PIN_SCHEMA)
    inputs = spark.createDataFrame([("s", "another goal", " a.py | 2 +-"), ("t", None, "")], "session_id string, goal string, git_diff string")
    plain = {r.session_id: r.prompt for r in checkpoints.handoff_prompts(docs, given).collect()}
    assert plain["s"].split("\n")[2:] == [
        "## Goal", "ship it", "", "## Hard constraints", "- never drop", "- be quick", "", "## Current state", "Phase: build · Status: blocked", "", "Requirements:", "- r1", "", "Decisions:", "- use X (no reason recorded) [active]", "",
        "## Modified files", "- modified: m.py", "- created: c.py", "", "Inspected files: i.py", "", "## Verification", "- passed: a, b", "- pending: c", "", "## Open issues", "- [open] slow", "", "## Next action", "one (remaining: two; three)", "", "Continue directly from this state.",
    ]
    assert "(no checkpoint available" in plain["t"] and "- alone" in plain["t"] and "(no goal recorded" in plain["t"]
    told = {r.session_id: r.prompt for r in checkpoints.handoff_prompts(docs, given, inputs).collect()}
    assert "## Goal\nanother goal\n" in told["s"] and "\n\n## Current git diff (summary)\n a.py | 2 +-\n\n## Next action" in told["s"] and "git diff" not in told["t"]
    got = {r.session_id: r.instructions for r in checkpoints.compact_instructions(docs, given, F.lit(True)).collect()}
    assert "Hard constraints: never drop; be quick." in got["s"] and "Next action: one." in got["s"] and "more aggressively" in got["s"]
