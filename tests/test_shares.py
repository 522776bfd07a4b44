"""Messages are dealt into as many tasks as their size asks for, so that a task's memory does not grow with the table."""

from __future__ import annotations

from tests.scenes import call, frame, result, user
from threadloom.functions import rows
from threadloom.operators import items, steps
from threadloom.plans.config import DEFAULTS
from threadloom.sources import traces


def _sessions(n, lines):
    return {f"s{i}": [user("go"), call("bash", {"command": "python a.py"}, "c"), result("bash", "output line 1\n" * lines, "c")] for i in range(n)}


def test_shares_follow_rows_and_texts(spark, monkeypatch):
    monkeypatch.setattr(rows, "SHARE_BYTES", 10_000)
    few, many, long = (rows.shares(frame(spark, _sessions(*x))) for x in ((2, 1), (40, 1), (40, 200)))
    assert few == 4  # the session's own number at least
    assert 12 <= many < 15 and long > 20 and long - many >= 40 * 200 * 14 // 10_000 - 1
    assert rows.shares(frame(spark, {"s": [user("x" * 20_000)] * 3}).where("false")) == 4


def test_larger_tables_make_more_tasks_and_the_same_rows(spark, monkeypatch):
    messages = frame(spark, _sessions(40, 5))
    calls = spark.createDataFrame([(f"s{i}", 1, 3, 1000) for i in range(40)], "session_id string, turn int, message_index int, now_ms long")
    names = [f.split(" ") for f in steps.CALLS.split(", ")]
    calls = calls.selectExpr(*(n if n in calls.columns else f"cast(null as {t}) {n}" for n, t in names))
    pinned = spark.createDataFrame([("s1", "p", "note", "line 1", 1, True)], "session_id string, id string, type string, content string, created_at long, active boolean")
    found = lambda: [df for df in (items.classify(messages, pinned), steps.context_steps(messages, calls, pinned, DEFAULTS))]
    plain = [sorted(map(str, df.collect())) for df in found()]
    monkeypatch.setattr(rows, "SHARE_BYTES", 10_000)
    parts = rows.shares(messages)
    assert parts > 4
    for df, want in zip(found(), plain):
        assert f", {parts}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, df.collect())) == want


def test_events_are_dealt_by_their_number(spark, monkeypatch):
    events = spark.range(400).selectExpr("id event_id", "timestamp'2024-01-01' ts", "id % 40 user_id", "'view' event_type", "1.0D value", "'{\"k\": 1}' props")
    few = traces.tool_messages(events)
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(traces, "SHARE_EVENTS", 30)
    many = traces.tool_messages(events)
    assert ", 14), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, many.collect())) == want
