"""The per-session policy: what to do at each turn, and the state it leaves.

``step`` is the one transition function; batch jobs fold it over a session's
turns and the streaming processor applies it as turns arrive. The decision of a
single turn against known state is also a column expression (``decided``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import percent
from threadloom.plans.config import DEFAULTS, thresholds_for
from threadloom.schema import TURNS, as_turns

ACTIONS = ("prune", "checkpoint", "compact")
HISTORY, MAX_BACKOFF_MS, ENTER_CAP = 20, 600_000, 0.99
#: How long a manual clean waits for the next turn, and the least time between two hand-off suggestions.
CLEAN_MS, HANDOFF_MS = 900_000, 600_000


def initial_state() -> dict[str, Any]:
    return {
        "compactions": 0, "checkpoints": 0, "last_prune": 0, "last_checkpoint": 0, "last_compact": 0, "last_attempt": 0, "fail_streak": 0, "broken": False,
        "tokens_at_checkpoint": 0, "messages_at_checkpoint": 0, "compact_pressure": None, "ineffective_compacts": 0, "ineffective_prunes": 0,
        "prune_delta": 0.0, "compact_delta": 0.0, "history": [], "turn": 0, "band": dict.fromkeys(ACTIONS, False), "low": dict.fromkeys(ACTIONS, 0), "last_handoff": 0, "armed_until": 0,
    }


def stored_state(text: str | None) -> dict[str, Any]:
    """A state as ``state_text`` wrote it, over the defaults; text that is no JSON object counts as absent."""
    try:
        given = json.loads(text) if text else {}
    except ValueError:
        given = {}
    state = initial_state() | (given if isinstance(given, dict) else {})
    return state | {"history": [tuple(x) for x in state["history"]]}


def state_text(state: dict) -> str:
    return json.dumps(state)


def is_fresh(state: dict, config: dict, tokens: int, messages: int, now: int) -> bool:
    limits = config["checkpoint"]
    if state["last_checkpoint"] <= 0 or now - state["last_checkpoint"] >= limits["freshMs"]:
        return False
    if state["tokens_at_checkpoint"] > 0 and max(0, tokens - state["tokens_at_checkpoint"]) >= limits["staleTokens"]:
        return False
    return not (state["messages_at_checkpoint"] > 0 and max(0, messages - state["messages_at_checkpoint"]) >= limits["staleMessages"])


def _percent(x: float) -> str:
    return f"{math.floor(x * 100 + 0.5)}%"


def decide(state: dict, config: dict, limits: dict, turn: dict, fresh: bool) -> tuple[str, str]:
    """(action, reason) of the first rule that holds."""
    p, q = turn["pressure"], turn["quality"]
    adaptive = config["policy"]["adaptiveThresholds"]
    prune = min(ENTER_CAP, limits["prune"]["enter"] + (state["prune_delta"] if adaptive else 0))
    compact = min(ENTER_CAP, limits["compact"]["enter"] + (state["compact_delta"] if adaptive else 0))
    if p < config["pressure"]["green"] and q > 0.6:
        return "none", "pressure low and quality healthy"
    if not state["band"]["prune"] and p >= prune and turn["reclaimable_tokens"] >= limits["reclaimableMin"]:
        return "prune", f"pressure {_percent(p)} with ~{turn['reclaimable_tokens']} reclaimable tokens"
    if not state["band"]["checkpoint"] and p >= limits["checkpoint"]["enter"] and not fresh:
        return "checkpoint", f"pressure {_percent(p)} and no fresh checkpoint"
    if p >= limits["handoff"]["enter"] and fresh and (state["compactions"] >= 2 and q < 0.5 or state["ineffective_compacts"] >= 1):
        return "handoff", f"pressure {_percent(p)}, {state['compactions']} compactions, quality {_percent(q)}"
    if not state["band"]["compact"] and p >= compact:
        return "compact", f"pressure {_percent(p)} past compact threshold"
    return "none", f"within policy (pressure {_percent(p)}, quality {_percent(q)})"


def may_checkpoint(state: dict, config: dict, now: int) -> bool:
    limits, streak = config["checkpoint"], state["fail_streak"]
    if state["broken"] or state["checkpoints"] >= limits["maxPerSession"] or streak >= limits["maxFailStreak"]:
        return False
    if streak and state["last_attempt"]:
        waits, step = limits["backoffMs"], streak - 1
        wait = waits[step] if step < len(waits) else min(MAX_BACKOFF_MS, (waits[-1] if waits else 30_000) * 2 ** (step - len(waits) + 1))
        return now - state["last_attempt"] >= wait
    return True


def _recent(state: dict, action: str) -> int:
    return sum(a == action and (t is None or t >= state["turn"] - 9) for a, t in state["history"])


def _fired(state: dict, action: str, latch: bool = True) -> None:
    state["history"] = [*state["history"][-(HISTORY - 1) :], (action, state["turn"])]
    if latch:
        state["band"] = state["band"] | {action: True}
        state["low"] = state["low"] | {action: 0}


def step(state: dict, turn: dict, config: dict, limits: dict | None = None) -> tuple[dict, dict]:
    """State after one turn, and what it planned.

    ``turn`` has the columns of TURNS: pressure_after_prune is the pressure
    under the same meter if this turn prunes (null: unchanged), prune_actions
    how many items that would replace (null: some; with none, nothing has been
    pruned), checkpoint_ok the outcome of a checkpoint attempted this turn
    (null: it succeeds), compact_event says that the host has compacted since
    the turn before, clean_at_ms that a manual clean was armed then: it prunes
    at the next turn within CLEAN_MS that has something to prune, once, and
    latches nothing; clean_actions and pressure_after_clean, if given, hold for
    it. ``limits``: the thresholds of the turn's model. The plan's ``fast`` says
    that nothing was to be done, so that the context goes on untouched.
    """
    state = dict(state, band=dict(state["band"]), low=dict(state["low"]))
    now, p = turn["now_ms"], turn["pressure"]
    limits = limits or thresholds_for(config, turn.get("model"))
    if turn.get("compact_event"):
        state["compactions"] += 1
    if turn.get("clean_at_ms") is not None:
        state["armed_until"] = turn["clean_at_ms"] + CLEAN_MS
    if state["compact_pressure"] is not None:
        dropped = state["compact_pressure"] - p
        state["compact_pressure"] = None
        state["ineffective_compacts"] = state["ineffective_compacts"] + 1 if dropped < 0.05 else 0
        if state["ineffective_compacts"] >= 2 and config["policy"]["adaptiveThresholds"]:
            state["compact_delta"] += 0.04
    state["turn"] += 1
    for a in ACTIONS:
        if state["band"][a] and p < limits[a]["exit"]:
            state["low"][a] += 1
            if state["low"][a] >= 2:
                state["band"][a], state["low"][a] = False, 0
        else:
            state["low"][a] = 0
    fresh = is_fresh(state, config, turn["total_tokens"], turn["message_count"], now)
    action, reason = decide(state, config, limits, turn, fresh)
    most = config["policy"]["maxActionsPer10Turns"]
    full = {a: _recent(state, a) >= most for a in ACTIONS}
    saves = action in ("checkpoint", "compact")
    throttled = [a for a in ACTIONS if full[a] and (action == a or a == "checkpoint" and saves)]
    prune = action == "prune" and config["auto"]["prune"] and not full["prune"] and now - state["last_prune"] >= config["cooldowns"]["pruneMs"]
    checkpoint = saves and config["auto"]["checkpoint"] and not fresh and not full["checkpoint"] and may_checkpoint(state, config, now)
    compact = action == "compact" and config["auto"]["compact"] and not full["compact"] and now - state["last_compact"] >= config["cooldowns"]["compactMs"]
    after, manual = p, now < state["armed_until"]
    fast = not (prune or manual or checkpoint or compact or action == "handoff")
    cleaned = manual and turn.get("clean_actions") is not None
    actions, left = (turn["clean_actions"], turn["pressure_after_clean"]) if cleaned else (turn.get("prune_actions"), turn.get("pressure_after_prune"))
    some = actions is None or actions > 0
    prune, manual = (prune or manual) and some, manual and some
    if prune:
        after = p if left is None else left
        state["last_prune"] = now
        _fired(state, "prune", latch=not manual)
        if manual:
            state["armed_until"] = 0
        if after >= limits["prune"]["enter"] - 0.05:
            state["ineffective_prunes"] += 1
            if state["ineffective_prunes"] >= 2 and config["policy"]["adaptiveThresholds"]:
                state["prune_delta"] += 0.05
        else:
            state["ineffective_prunes"] = 0
        if not compact and not state["band"]["compact"] and config["auto"]["compact"] and after >= limits["compact"]["enter"] + state["compact_delta"] and now - state["last_compact"] >= config["cooldowns"]["compactMs"]:
            compact = True
    if checkpoint:
        state["last_attempt"] = now
        _fired(state, "checkpoint")
        if turn.get("checkpoint_ok") is None or turn["checkpoint_ok"]:
            state |= {"checkpoints": state["checkpoints"] + 1, "last_checkpoint": now, "fail_streak": 0, "tokens_at_checkpoint": turn["total_tokens"], "messages_at_checkpoint": turn["message_count"]}
        else:
            state["fail_streak"] += 1
            state["broken"] = state["broken"] or state["fail_streak"] >= config["checkpoint"]["maxFailStreak"]
    if compact:
        state["last_compact"], state["compact_pressure"] = now, after
        _fired(state, "compact")
    suggest = action == "handoff" and now - state["last_handoff"] > HANDOFF_MS
    if suggest:
        state["last_handoff"] = now
    return state, {
        "turn": turn["turn"], "action": action, "reason": reason, "prune": prune, "manual": manual, "checkpoint": checkpoint, "compact": compact, "handoff": suggest,
        "throttled": ",".join(throttled), "checkpoint_fresh": fresh, "compactions": state["compactions"], "checkpoints": state["checkpoints"],
        "prune_delta": round(state["prune_delta"], 6), "compact_delta": round(state["compact_delta"], 6), "fast": fast, "pressure_after": after,
    }


PLANS = "session_id string, turn int, action string, reason string, prune boolean, manual boolean, checkpoint boolean, compact boolean, handoff boolean, throttled string, checkpoint_fresh boolean, compactions int, checkpoints int, prune_delta double, compact_delta double, fast boolean, pressure_after double"


_WHOLE = frozenset(f.split(" ")[0] for f in TURNS.split(", ") if f.split(" ")[1] in ("int", "long"))


def turn_dicts(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows as dictionaries of Python values, missing ones None; pandas makes whole numbers with missing ones among them fractions."""
    for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
        values = {k: (v.item() if hasattr(v, "item") else v) for k, v in row.items()}
        yield {k: int(v) if k in _WHOLE and v is not None else v for k, v in values.items()}


def _folded(turns: DataFrame, config: dict | None, states: DataFrame | None, ends: bool) -> DataFrame:
    """``step`` over each session's turns in order, from batch to batch with nothing but the state; plans as they come, or the states at the end."""
    config = config or DEFAULTS
    rows = as_turns(turns).withColumn("state", F.lit(None).cast("string"))
    if states is not None:
        rows = rows.unionByName(states.select("session_id", "state"), allowMissingColumns=True)
    columns = ["session_id", "state"] if ends else [c.split()[0] for c in PLANS.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits: dict[Any, dict] = {}
        session, state = None, None
        for pdf in batches:
            out = []
            for turn in turn_dicts(pdf):
                if state is None or turn["session_id"] != session:
                    if ends and state is not None:
                        out.append({"session_id": session, "state": state_text(state)})
                    session, state = turn["session_id"], initial_state()
                if turn["turn"] is None:
                    state = stored_state(turn["state"])
                    continue
                model = turn["model"]
                if model not in limits:
                    limits[model] = thresholds_for(config, model)
                state, plan = step(state, turn, config, limits[model])
                if not ends:
                    out.append({"session_id": session} | plan)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if ends and state is not None:
            yield pd.DataFrame([{"session_id": session, "state": state_text(state)}], columns=columns)

    placed = rows.repartition("session_id").sortWithinPartitions("session_id", F.col("turn").asc_nulls_first())
    return placed.mapInPandas(fold, "session_id string, state string" if ends else PLANS)


def fold_turns(turns: DataFrame, config: dict | None = None, states: DataFrame | None = None) -> DataFrame:
    """TURNS -> PLANS: ``step`` over each session's turns in order, from its state in ``states`` (session_id, state) or the initial one. A session is a sequence by its nature; sessions run in parallel, and a task holds one state and one batch."""
    return _folded(turns, config, states, False)


def final_states(turns: DataFrame, config: dict | None = None, states: DataFrame | None = None) -> DataFrame:
    """(session_id, state) after the turns, of every session in ``turns`` or ``states``: what the next ``fold_turns`` starts from."""
    return _folded(turns, config, states, True)


def decided(fresh: Column, config: dict | None = None) -> tuple[Column, Column]:
    """(action, reason) for rows of an analysis with the columns of ``with_thresholds``, a session without earlier state."""
    config = config or DEFAULTS
    p, q = F.col("pressure"), F.col("quality")
    prune = (p >= F.least(F.lit(ENTER_CAP), F.col("prune_enter"))) & (F.col("reclaimable_tokens") >= F.col("reclaimable_min"))
    checkpoint = (p >= F.col("checkpoint_enter")) & ~fresh
    compact = p >= F.least(F.lit(ENTER_CAP), F.col("compact_enter"))
    idle = (p < config["pressure"]["green"]) & (q > 0.6)
    shown = percent(p)
    action = F.when(idle, "none").when(prune, "prune").when(checkpoint, "checkpoint").when(compact, "compact").otherwise("none")
    reason = (
        F.when(idle, "pressure low and quality healthy")
        .when(prune, F.concat(F.lit("pressure "), shown, F.lit(" with ~"), F.col("reclaimable_tokens").cast("string"), F.lit(" reclaimable tokens")))
        .when(checkpoint, F.concat(F.lit("pressure "), shown, F.lit(" and no fresh checkpoint")))
        .when(compact, F.concat(F.lit("pressure "), shown, F.lit(" past compact threshold")))
        .otherwise(F.concat(F.lit("within policy (pressure "), shown, F.lit(", quality "), percent(q), F.lit(")")))
    )
    return action, reason


def recent_actions(fired: DataFrame, window: int = 10) -> DataFrame:
    """(session_id, turn, action) with n_before: the same action's firings in the ``window`` turns up to this one, itself left out."""
    from pyspark.sql import Window

    before = Window.partitionBy("session_id", "action").orderBy("turn").rangeBetween(1 - window, -1)
    return fired.withColumn("n_before", F.count(F.lit(1)).over(before))
