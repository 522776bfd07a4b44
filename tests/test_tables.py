"""Versions of state tables, whole files, rule tables, checkpoints' dates and documents, estimators."""

from __future__ import annotations

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tests.scenes import frame, said, user
from threadloom.functions import tokens as tk
from threadloom.operators import checkpoints, items
from threadloom.plans import config, rules
from threadloom.sources import logs, tables

STATE = "session_id string, state string"


def rows_of(df):
    return sorted((r.session_id or "", r.state) for r in df.collect())


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    state = lambda names, value: spark.createDataFrame([(n, value) for n in names], STATE)
    assert tables.current(spark, path) is None
    assert tables.commit(state([f"s{i}" for i in range(40)], "old"), path) == 1
    before = tables.current(spark, path)
    assert tables.commit(state(["s1", "s2", "s2", None], "new"), path) == 2
    assert [r for r in rows_of(before) if r[1] != "old"] == [] and len(rows_of(before)) == 40  # a reader keeps its version
    now = rows_of(tables.current(spark, path))
    assert len(now) == 42 and [r for r in now if r[1] == "new"] == [("", "new"), ("s1", "new"), ("s2", "new"), ("s2", "new")]
    assert tables.commit(state([], "x"), path) == 2
    assert tables.commit(state([None], "newer"), path) == 3 and ("", "newer") in rows_of(tables.current(spark, path))
    assert len(rows_of(tables.current(spark, path, 1))) == 40
    assert tables.expired(spark, path, keep=1) >= 0 and len(rows_of(tables.current(spark, path))) == 42


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.commit(spark.createDataFrame([("a", "1")], STATE), path)

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        tables.commit(spark.createDataFrame([("a", "2"), ("b", "2")], STATE), path, killed)
    assert rows_of(tables.current(spark, path)) == [("a", "1")]
    assert tables.commit(spark.createDataFrame([("b", "3")], STATE), path) == 2
    assert rows_of(tables.current(spark, path)) == [("a", "1"), ("b", "3")]


def test_two_writers(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.commit(spark.createDataFrame([("a", "0"), ("b", "0")], STATE), path)
    once = []

    def other():
        if not once:
            once.append(tables.commit(spark.createDataFrame([("a", "other")], STATE), path))

    assert tables.commit(spark.createDataFrame([("a", "mine"), ("c", "mine")], STATE), path, other) == 3 and once == [2]
    assert rows_of(tables.current(spark, path)) == [("a", "mine"), ("b", "0"), ("c", "mine")]
    threads = [threading.Thread(target=lambda k=k: tables.commit(spark.createDataFrame([(f"t{k}", "x")], STATE), path)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {s for s, _ in rows_of(tables.current(spark, path))} == {"a", "b", "c", "t0", "t1", "t2"}


def test_a_broken_line_takes_its_file(spark, tmp_path):
    for name, lines in {"one": ['{"id":"a"}', "", '{"id":"b"}'], "two": ['{"id":"c"}', '{"id":', '{"id":"d"}'], "three": ["null", '{"id":"e","x":1}']}.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    rows, bad = logs.whole_files(spark, str(tmp_path), "id string")
    assert sorted(r.id for r in rows.collect()) == ["a", "b", "e"]
    assert [(r.file.rsplit("/", 1)[1], r.bad_lines, r.lines) for r in bad.collect()] == [("two.jsonl", 1, 3)]


def test_ten_thousand_rules(spark):
    dice = random.Random(9)
    word = lambda n: "".join(dice.choice("ab/.-") for _ in range(dice.randint(1, n)))
    share = lambda: round(dice.uniform(0.2, 0.9), 3)
    pair = lambda: dice.choice([share(), {"enter": share()}, {"enter": share(), "exit": 0.1}, {"exit": 0.15}, {}, None, "x", 7])
    models = {}
    while len(models) < 10_000:
        pattern = dice.choice([word(6) + "*", word(5) + "?" + word(3), word(8), "*" + word(3), "*", word(3) + "*" + word(2)])
        models[pattern + ("" if len(models) < 3000 else str(len(models)))] = {"prune": pair(), "compact": pair(), "checkpoint": pair(), "handoff": dice.choice([None, share(), {"enter": share()}]), "reclaimableMin": dice.choice([None, 5, 77, -1])}
    conf = config.merged(config.DEFAULTS, {}) | {"models": models}
    names = sorted({word(9) for _ in range(120)})
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "model string")
    got = {r.model: r for r in rules.with_rules(rows, rules.rule_table(spark, conf), conf).collect()}
    assert len(got) == len(names) + 1
    for n in [*names, None]:
        want = config.thresholds_for(conf, n)
        mine = got[n]
        for k in ("prune", "checkpoint", "compact"):
            assert (mine[f"{k}_enter"], mine[f"{k}_exit"]) == pytest.approx((want[k]["enter"], want[k]["exit"])), (n, k)
        assert (mine.handoff_enter, mine.reclaimable_min) == pytest.approx((want["handoff"]["enter"], want["reclaimableMin"]))


def test_dates(spark):
    good = ["2026-01-05", "2026-01-05T10:00:00Z", "2026-01-05T10:00:00.123+02:00", "2026-01-05 10:00", "2026-01", "Mon, 05 Jan 2026 10:00:00 GMT", "5 January 2026", "05 Jan 2026 10:00 +0200"]
    bad = ["10:30", "soon", "", "2026-13-01", "2026-01-05T25:00:00Z", "Mon, 45 Jan 2026 10:00:00 GMT", "05 Jan 2026 29:00", "tomorrow at 5"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", checkpoints.is_date(F.col("t")).alias("ok")).collect()
    assert {r.t for r in rows if r.ok} == set(good)


def test_documents_are_rebuilt(spark):
    raw = {"meta": {"a": 1}, "task": {"goal": " g ", "phase": " "}, "requirements": [" r"], "constraints": [], "decisions": [{"decision": " d ", "why": 1}], "files": {k: [] for k in ("inspected", "modified", "created", "deleted")}, "verification": {k: [] for k in ("passed", "failed", "pending")}, "next_actions": ["n"], "more": {}}
    prompts = spark.createDataFrame([("s", "p"), ("t", "p"), ("u", None)], "session_id string, prompt string")
    replies = spark.createDataFrame([("s", json.dumps(raw), "auto", 3), ("t", json.dumps(raw | {"issues": {}}), "auto", 3)], "session_id string, reply string, source string, tokens_before long")
    got = {r.session_id: r for r in checkpoints.generated(prompts, replies, "2024-01-01T00:00:00.000Z").collect()}
    assert not got["t"].ok and not got["u"].ok and got["t"].checkpoint is None
    assert json.loads(got["s"].checkpoint) == {
        "version": 1, "created_at": "2024-01-01T00:00:00.000Z", "task": {"goal": "g", "phase": "in_progress", "status": "in_progress"}, "requirements": [" r"], "constraints": [], "decisions": [{"decision": "d", "reason": "", "status": "active"}],
        "files": raw["files"], "verification": raw["verification"], "issues": [], "next_actions": ["n"], "meta": {"session_id": "s", "tokens_before": 3, "source": "auto"},
    }
    assert got["s"].checkpoint.count('"meta"') == 1


def test_an_estimator_that_fails_on_some_rows(spark):
    messages = frame(spark, {"s": [user("x" * 40), said("y" * 80), user("boom"), user("")]})

    def estimate(row):
        if row["content_text"] == "boom":
            raise RuntimeError
        return None if row["role"] == "assistant" else 7

    own = {r.message_index: r.estimated_tokens for r in items.classify(messages).collect()}
    got = {r.message_index: r.estimated_tokens for r in items.classify(messages, estimator=tk.guarded(estimate, "role", "content_text")).collect()}
    assert got == {0: 7, 1: own[1], 2: own[2], 3: 7}


def test_only_the_end_of_a_long_session_is_gathered(spark):
    scene = [user("goal here"), *(said(f"part {i} " + "z" * 300) for i in range(400))]
    messages = frame(spark, {"s": scene, "t": scene[:3]})
    whole = {r.session_id: r.text for r in checkpoints.serialized(messages, max_total=10**9).collect()}
    for most in (500, 3000, 20_000):
        cut = {r.session_id: r.text for r in checkpoints.serialized(messages, max_total=most).collect()}
        assert cut["t"] == whole["t"] if len(whole["t"]) <= most else cut["t"].endswith(whole["t"][-400:])
        tail = max(1000, most - len("User (Initial Goal): goal here") - 4)
        assert cut["s"] == "User (Initial Goal): goal here\n\n[... earlier conversation truncated ...]\n\n" + whole["s"][-tail:]
