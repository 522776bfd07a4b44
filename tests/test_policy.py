"""The policy over turns: stages, latches, limits, backoff, adaption, cleans and hand-offs; batch, stored state and stream."""

from __future__ import annotations

import copy

import pytest
from pyspark.sql import functions as F

from threadloom.plans import config as cfg
from threadloom.plans import policy
from threadloom.schema import TURNS
from threadloom.streaming.sessions import plan_stream

DEFAULT = cfg.DEFAULTS
NAMES = [f.split(" ")[0] for f in TURNS.split(", ")]


def turn(n, pressure, **given):
    base = {"session_id": "s", "turn": n, "now_ms": 20_000 * n + 1_000_000, "pressure": pressure, "quality": 0.8, "total_tokens": int(pressure * 100_000), "usable_tokens": 100_000, "reclaimable_tokens": 0, "message_count": 2 * n}
    return {k: None for k in NAMES} | base | given


def played(turns, config=DEFAULT, **state):
    now, plans = policy.initial_state() | state, []
    for t in turns:
        now, plan = policy.step(now, t, config)
        plans.append(plan)
    return now, plans


def decided(pressure, reclaimable=0, quality=0.8, fresh=True, **state):
    t = turn(1, pressure, reclaimable_tokens=reclaimable, quality=quality)
    return policy.decide(policy.initial_state() | state, DEFAULT, cfg.thresholds_for(DEFAULT, None), t, fresh)


def changed(**sections):
    out = copy.deepcopy(DEFAULT)
    for k, v in sections.items():
        out[k] = out[k] | v
    return out


def test_stages_of_pressure():
    assert decided(0.40, 1000)[0] == "none"
    assert decided(0.70, 8000) == ("prune", "pressure 70% with ~8000 reclaimable tokens")
    assert decided(0.70, 5000)[0] == "prune" and decided(0.70, 4999)[0] == "none"
    assert decided(0.82, fresh=False) == ("checkpoint", "pressure 82% and no fresh checkpoint")
    assert decided(0.90) == ("compact", "pressure 90% past compact threshold")
    assert decided(0.96, quality=0.4, compactions=2) == ("handoff", "pressure 96%, 2 compactions, quality 40%")
    assert decided(0.96, quality=0.4, compactions=1)[0] == "compact" and decided(0.96, quality=0.6, compactions=2)[0] == "compact"
    assert decided(0.96, ineffective_compacts=1)[0] == "handoff" and decided(0.96, fresh=False, compactions=2, quality=0.4)[0] == "checkpoint"
    assert decided(0.50, quality=0.5)[0] == "none" and decided(0.50, quality=0.5)[1].startswith("within policy")


def test_latches_and_deltas_hold_actions_back():
    assert decided(0.90, band={"prune": False, "checkpoint": False, "compact": True})[0] == "none"
    assert decided(0.92, compact_delta=0.08)[0] == "none" and decided(0.70, 8000, prune_delta=0.1)[0] == "none"
    assert decided(0.995, compact_delta=0.5)[0] == "compact"  # a raised limit stops at 0.99


def test_a_latch_opens_after_two_low_turns_in_a_row():
    latched = {"prune": False, "checkpoint": False, "compact": True}
    quiet = changed(auto={"checkpoint": False})
    state, _ = played([turn(1, 0.70)], quiet, band=latched)
    assert state["band"]["compact"]
    state, _ = played([turn(1, 0.70), turn(2, 0.70)], quiet, band=latched)
    assert not state["band"]["compact"]
    series = [0.70, 0.80, 0.70, 0.70]
    found = [played([turn(i + 1, p) for i, p in enumerate(series[:n])], quiet, band=latched)[0]["band"]["compact"] for n in range(1, 5)]
    assert found == [True, True, True, False]


def test_cooldowns_and_switches():
    t = turn(1, 0.70, reclaimable_tokens=30_000)
    assert played([t], last_prune=t["now_ms"] - 1000)[1][0]["prune"] is False
    assert played([t], last_prune=t["now_ms"] - 15_000)[1][0]["prune"] is True
    _, (plan,) = played([t], changed(auto={"prune": False}))
    assert plan["action"] == "prune" and not plan["prune"]


def test_three_actions_in_ten_turns():
    t = turn(1, 0.70, reclaimable_tokens=10_000)
    for history, allowed in (([("prune", None)] * 3, False), ([("prune", 0)] * 2, True)):
        _, (plan,) = played([t], history=history)
        assert plan["prune"] is allowed and plan["throttled"] == ("" if allowed else "prune")
    late = turn(1, 0.70, reclaimable_tokens=10_000)
    assert played([late], history=[("prune", 1), ("prune", 2), ("prune", 3)], turn=12)[1][0]["prune"]
    assert not played([late], history=[("prune", 4), ("prune", 5), ("prune", 6)], turn=12)[1][0]["prune"]


def test_a_prune_without_actions_leaves_no_trace():
    state, (plan,) = played([turn(1, 0.70, reclaimable_tokens=10_000, prune_actions=0)])
    assert plan["action"] == "prune" and not plan["prune"]
    assert state["last_prune"] == 0 and not state["history"] and not state["band"]["prune"] and state["ineffective_prunes"] == 0


def test_pruning_that_does_not_help_raises_its_threshold():
    each = [turn(3 * i + k, p, reclaimable_tokens=9000, pressure_after_prune=0.64) for i in range(3) for k, p in ((1, 0.75), (2, 0.5), (3, 0.5))]
    state, plans = played(each)
    assert [p["prune_delta"] for p in plans if p["prune"]] == [0.0, 0.05, 0.1]
    good, _ = played([turn(1, 0.75, reclaimable_tokens=9000, pressure_after_prune=0.5)], ineffective_prunes=1)
    assert good["ineffective_prunes"] == 0
    fixed, _ = played(each, changed(policy={"adaptiveThresholds": False}))
    assert fixed["prune_delta"] == 0


def test_compaction_that_does_not_help_raises_its_threshold():
    state, plans = played([turn(1, 0.90), turn(2, 0.89)], last_checkpoint=1_000_000, compact_pressure=None)
    assert plans[0]["compact"] and state["ineffective_compacts"] == 1 and state["compact_pressure"] is None
    state, _ = played([turn(1, 0.80)], compact_pressure=0.82, ineffective_compacts=1, last_checkpoint=1_000_000)
    assert state["compact_delta"] == pytest.approx(0.04)
    state, _ = played([turn(1, 0.60)], compact_pressure=0.82, ineffective_compacts=1)
    assert state["ineffective_compacts"] == 0 and state["compact_delta"] == 0


def test_after_a_prune_that_is_not_enough_comes_compaction():
    t = turn(1, 0.95, reclaimable_tokens=9000, pressure_after_prune=0.9)
    _, (plan,) = played([t])
    assert plan["action"] == "prune" and plan["prune"] and plan["compact"] and not plan["checkpoint"]
    _, (plan,) = played([t], last_compact=t["now_ms"] - 1000)
    assert plan["prune"] and not plan["compact"]


def test_where_compaction_begins_below_checkpoints_both_are_planned():
    inverted = changed(thresholds={"checkpoint": {"enter": 0.86, "exit": 0.70}, "compact": {"enter": 0.80, "exit": 0.70}})
    state, (plan,) = played([turn(1, 0.82)], inverted)
    assert (plan["action"], plan["checkpoint"], plan["compact"]) == ("compact", True, True) and state["checkpoints"] == 1
    state, (plan,) = played([turn(1, 0.82, checkpoint_ok=False)], inverted)
    assert plan["compact"] and state["fail_streak"] == 1


def test_failing_checkpoints_wait_longer_and_then_stop():
    config = changed(thresholds={"checkpoint": {"enter": 0.8, "exit": 2.0}, "compact": {"enter": 1.9, "exit": 1.8}}, policy={"maxActionsPer10Turns": 99})
    # the exit above every pressure opens the latch after two turns
    turns = [turn(i, 0.85, now_ms=1_000_000 + 10_000 * i, checkpoint_ok=False) for i in range(1, 60)]
    state, plans = played(turns, config)
    at = [10 * (i + 1) for i, p in enumerate(plans) if p["checkpoint"]]
    assert at == [10, 40, 100] and state["broken"] and state["fail_streak"] == 3
    assert not policy.may_checkpoint(policy.initial_state() | {"checkpoints": 20}, config, 0)
    waits = [next(w for w in range(0, 700_001, 1000) if policy.may_checkpoint(policy.initial_state() | {"fail_streak": n, "last_attempt": 1}, changed(checkpoint={"maxFailStreak": 99}), 1 + w)) for n in (1, 2, 3, 4, 5, 9)]
    assert waits == [30_000, 60_000, 120_000, 240_000, 480_000, 600_000]


def test_freshness_of_checkpoints():
    state = policy.initial_state() | {"last_checkpoint": 1000, "tokens_at_checkpoint": 50_000, "messages_at_checkpoint": 20}
    fresh = lambda tokens=55_000, messages=25, now=2000: policy.is_fresh(state, DEFAULT, tokens, messages, now)
    assert fresh() and not fresh(tokens=70_000) and not fresh(messages=50) and not fresh(now=601_000) and fresh(tokens=10, messages=1)
    assert not policy.is_fresh(policy.initial_state(), DEFAULT, 0, 0, 10)


def test_handoff_is_suggested_again_only_after_ten_minutes():
    high = lambda at: turn(1, 0.96, quality=0.3, now_ms=at, total_tokens=10)
    known = {"compactions": 2, "last_checkpoint": 5_000_000, "last_handoff": 5_000_000}
    for later, again in ((599_999, False), (600_000, False), (600_001, True)):
        state, (plan,) = played([high(5_000_000 + later)], changed(checkpoint={"freshMs": 10**9}), **known)
        assert plan["action"] == "handoff" and plan["handoff"] is again and (state["last_handoff"] > 5_000_000) is again


def test_a_manual_clean_waits_fifteen_minutes_for_one_prune():
    t = turn(1, 0.30, clean_at_ms=1_000_000, pressure_after_prune=0.2, prune_actions=4)
    state, (plan,) = played([t])
    assert plan["action"] == "none" and plan["prune"] and plan["manual"]
    assert state["armed_until"] == 0 and not state["band"]["prune"] and state["history"] == [("prune", 1)] and state["last_prune"] == t["now_ms"]
    _, plans = played([t, turn(2, 0.30)])
    assert not plans[1]["prune"]
    # nothing to prune: it stays armed until its time is over
    idle = [turn(1, 0.30, clean_at_ms=1_000_000, prune_actions=0), turn(2, 0.30, now_ms=1_899_999, prune_actions=1)]
    assert [p["manual"] for p in played(idle)[1]] == [False, True]
    assert not played([turn(1, 0.30, clean_at_ms=1_000_000, now_ms=1_900_000)])[1][0]["prune"]


def test_only_the_hosts_event_counts_compactions():
    state, plans = played([turn(1, 0.90), turn(2, 0.5, compact_event=True)], last_checkpoint=1_000_000)
    assert [p["compactions"] for p in plans] == [0, 1] and plans[0]["compact"] and state["compactions"] == 1


def test_swinging_pressure_compacts_seldom():
    series = [turn(i, 0.86 + 0.04 * (i % 2), quality=0.7) for i in range(1, 21)]
    _, plans = played(series)
    assert sum(p["compact"] for p in plans) <= 2


def series(session, n, seed):
    import random

    rng = random.Random(seed)
    return [turn(i, round(rng.uniform(0.3, 1.1), 2), session_id=session, quality=rng.choice([0.3, 0.8]), reclaimable_tokens=rng.randrange(0, 12_000), pressure_after_prune=rng.choice([None, 0.4]), checkpoint_ok=rng.random() < 0.6, compact_event=rng.random() < 0.2, model=rng.choice([None, "qwen-x/y"])) for i in range(1, n)]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [t for k in range(6) for t in series(f"s{k}", 40, k)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], TURNS), rows


def plain(rows):
    return sorted(tuple(r.asDict().items()) for r in rows)


def test_the_fold_is_the_step_over_each_session(spark, turns):
    df, rows = turns
    got = {(r.session_id, r.turn): r for r in policy.fold_turns(df).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        _, plans = played([t for t in rows if t["session_id"] == f"s{k}"])
        for p in plans:
            assert {c: got[f"s{k}", p["turn"]][c] for c in p} == p


def test_a_stored_state_goes_on_where_it_ended(spark, turns):
    df, _ = turns
    whole = plain(policy.fold_turns(df).collect())
    states = policy.final_states(df.where("turn <= 15")).cache()
    parts = policy.fold_turns(df.where("turn <= 15")).unionByName(policy.fold_turns(df.where("turn > 15"), states=states))
    assert plain(parts.collect()) == whole
    assert {r.session_id for r in policy.final_states(df.limit(0), states=states).collect()} == {f"s{k}" for k in range(6)}
    assert policy.stored_state('{"turn": 7, "history": [["prune", 3]]}') == policy.initial_state() | {"turn": 7, "history": [("prune", 3)]}
    assert policy.stored_state(None) == policy.stored_state("{broken") == policy.stored_state("[1]") == policy.initial_state()


def test_the_stream_is_the_fold_whatever_its_batches(spark, turns, tmp_path):
    df, _ = turns
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    query = lambda: plan_stream(spark.readStream.schema(TURNS).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    for lo, hi in ((0, 10), (10, 11), (11, 40)):
        df.where((F.col("turn") > lo) & (F.col("turn") <= hi)).coalesce(2).write.mode("append").parquet(source)
        query()
    assert plain(spark.read.parquet(sink).collect()) == plain(policy.fold_turns(df).collect())


def test_decisions_as_columns(spark):
    rows = spark.createDataFrame([(0.4, 0.8, 1000), (0.7, 0.8, 8000), (0.82, 0.8, 0), (0.9, 0.8, 0), (0.5, 0.5, 0)], "pressure double, quality double, reclaimable_tokens long").withColumn("model", F.lit(None).cast("string"))
    for fresh in (True, False):
        action, reason = policy.decided(F.lit(fresh))
        got = cfg.with_thresholds(rows, DEFAULT).select("pressure", "quality", "reclaimable_tokens", action.alias("a"), reason.alias("r")).collect()
        assert [(r.a, r.r) for r in got] == [decided(r.pressure, r.reclaimable_tokens, r.quality, fresh) for r in got]
