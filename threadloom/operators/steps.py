"""The automatic pass before every model call of a session: observe, decide, prune, reinject, escalate.

At a call the engine sees the messages before it. What a message counts for
then changes only when it comes, when it is superseded and when it leaves the
recent results, so a session's calls are measured by running sums over these
changes, not by classifying it anew for each call.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import tokens as tk
from threadloom.functions.rows import shares
from threadloom.operators import analysis, items, pins as pin, prune
from threadloom.operators.analysis import SUMS
from threadloom.operators.needles import first_seen
from threadloom.plans.config import DEFAULTS, prune_band, thresholds_for
from threadloom.plans.policy import PLANS, initial_state, step, stored_state, turn_dicts

#: Calls of a model: ``message_index`` is the place of the call, which sees the messages before it. ``tokens`` are those the host reports, if it does.
CALLS = "session_id string, turn int, message_index int, now_ms long, tokens long, context_window long, max_tokens long, model string, compact_event boolean, checkpoint_ok boolean, clean_at_ms long"
#: What ``context_steps`` gives beside a plan.
OBSERVED = "pressure double, quality double, raw_tokens long, total_tokens long, usable_tokens long, reclaimable_tokens long, message_count int, prune_actions int, pressure_after_prune double, clean_actions int, pressure_after_clean double, pins_missing int"
STEPS = f"{PLANS}, reinject boolean, {OBSERVED}"
_SEEN = tuple(f.split(" ")[0] for f in OBSERVED.split(", "))
#: Written into what is replaced; any time of this form has as many characters.
AT = "2024-01-01T00:00:00.000Z"


def bands(config: dict) -> list[tuple[int, int]]:
    """(stub_min, max_chars) by band, the most aggressive first; last what holds below all bands."""
    found = [(b["stubMinTokens"], b["foldMaxChars"]) for b in sorted(config["prune"]["bands"], key=lambda b: -b["pressureGte"])]
    return [*found, (config["limits"]["stubMinTokens"], config["limits"]["foldMaxChars"])]


def counted(rows: DataFrame, config: dict, at: str = AT) -> DataFrame:
    """Classified rows with what each adds to the sums of its session: SUMS, and saved_k and acts_k by band."""
    rows = prune.savings(rows, bands(config), at)
    sums = {f"{c}_tokens": F.when(F.col("class") == c, F.col("estimated_tokens")).otherwise(0) for c in analysis.CLASSES}
    return rows.withColumns({"raw_tokens": F.col("estimated_tokens"), **sums, "reclaimable_tokens": tk.reclaimable(config["limits"]["stubMinTokens"]), "message_count": F.lit(1).cast("long")})


def sum_names(config: dict) -> list[str]:
    return [*SUMS, *(f"{x}_{k}" for k in range(len(bands(config))) for x in ("saved", "acts"))]


def pieces(messages: DataFrame, pins: DataFrame | None = None, config: dict | None = None, parts: int | None = None) -> DataFrame:
    """Classified messages, a row for each stretch of calls that see one as it is: those after message ``since`` up to message ``until`` (null: all later)."""
    config = config or DEFAULTS
    toolish = F.col("role").isin("toolResult", "bashExecution")
    parts = parts or shares(messages)
    rows = items.with_facts(items.superseded(items.with_calls(messages, parts)))
    later = Window.partitionBy("session_id", F.when(toolish, 1).otherwise(0)).orderBy("message_index")
    rows = rows.withColumn("old_at", F.when(toolish, F.lead("message_index", config["limits"]["recentWindow"]).over(later)))
    starts = F.array_sort(F.array_distinct(F.filter(F.array("message_index", F.when(toolish, F.col("superseded_at")), "old_at"), lambda x: x.isNotNull())))
    rows = rows.withColumn("starts", starts).select("*", F.posexplode("starts").alias("piece", "since"))
    rows = rows.withColumns({
        "until": F.get("starts", F.col("piece") + 1),
        "superseded_by": F.when(F.col("superseded_at") <= F.col("since"), F.col("superseded_at")),
        "is_recent": F.coalesce(toolish & (F.col("old_at").isNull() | (F.col("since") < F.col("old_at"))), F.lit(False)),
        "is_latest_user": F.lit(False),
    })
    texts = messages.select("session_id", "message_index", F.lower(tk.message_text()).alias("text"))
    return items.pinned(items.judged(rows, config["limits"]["oversizedTokens"]), pins, texts, parts)


def _chosen(pressure: Column, config: dict, name: str) -> Column:
    """The sum of the band that a pressure reaches."""
    levels = sorted((b["pressureGte"] for b in config["prune"]["bands"]), reverse=True)
    out = F.when(pressure >= levels[0], F.col(f"{name}_0"))
    for k, level in enumerate(levels[1:], 1):
        out = out.when(pressure >= level, F.col(f"{name}_{k}"))
    return out.otherwise(F.col(f"{name}_{len(levels)}"))


def observed(messages: DataFrame, calls: DataFrame, pins: DataFrame | None = None, config: dict | None = None, parts: int | None = None) -> DataFrame:
    """CALLS with OBSERVED: the state of the context at each call, and what pruning it would do."""
    config = config or DEFAULTS
    parts = parts or shares(messages)
    names = sum_names(config)
    each = counted(pieces(messages, pins, config, parts), config).select("session_id", "since", "until", *names)
    change = F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("sign")))
    changes = each.select("session_id", *names, F.inline(change)).where("at is not null").select("session_id", "at", *((F.col(c) * F.col("sign")).cast("long").alias(c) for c in names))
    asked = calls.select("session_id", F.col("message_index").alias("at"), F.struct(*(f.split(" ")[0] for f in CALLS.split(", "))).alias("call"))
    rows = changes.unionByName(asked, allowMissingColumns=True)
    if pins is None:
        rows = rows.withColumn("pins", F.lit(None).cast("long"))
    else:
        active = pins.where("active").withColumn("needle", pin.needle()).select("session_id", "needle", "type")
        lost = active.where("needle <> '' or type <> 'file'").select("session_id", F.lit(-1).alias("at"), F.lit(1).cast("long").alias("pins"))
        seen = first_seen(pin.corpus_texts(messages), active, parts)
        found = active.join(seen, ["session_id", "needle"]).select("session_id", F.col("message_index").alias("at"), F.lit(-1).cast("long").alias("pins"))
        rows = rows.unionByName(lost, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    before = Window.partitionBy("session_id").orderBy("at", F.col("call").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition(parts, "session_id").withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in [*names, "pins"]}).where("call is not null")
    rows = rows.select("call.*", *names, F.col("pins").alias("pins_missing"))
    rows = analysis.calibration(rows.withColumns({"reported": F.col("tokens"), "estimated": F.col("raw_tokens")}), 20).drop("reported", "estimated")
    rows = analysis.metered(rows)
    after = lambda saved: analysis.clamp(analysis.estimated_total(F.col("raw_tokens") - saved) / F.col("usable_tokens"), 0.0, 2.0)
    made = {"prune_actions": _chosen(F.col("pressure"), config, "acts"), "pressure_after_prune": after(_chosen(F.col("pressure"), config, "saved")), "clean_actions": F.col("acts_0"), "pressure_after_clean": after(F.col("saved_0"))}
    rows = rows.withColumns(made)
    types = dict(f.split(" ") for f in OBSERVED.split(", "))
    return rows.select(*(f.split(" ")[0] for f in CALLS.split(", ")), *(F.col(c).cast(t).alias(c) for c, t in types.items()))


def planned(turn: dict[str, Any], plan: dict[str, Any]) -> dict[str, Any]:
    """A row of STEPS."""
    return {"session_id": turn["session_id"], **{k: turn[k] for k in _SEEN}, **plan, "reinject": not plan["fast"] and turn["pins_missing"] > 0}


def context_steps(messages: DataFrame, calls: DataFrame, pins: DataFrame | None = None, config: dict | None = None, states: DataFrame | None = None) -> DataFrame:
    """STEPS: the pass at each of ``calls``, over each session's state in order, from that in ``states`` (session_id, state) or the initial one.

    ``reinject`` says that the pass puts lost pins back; on the fast path, where
    nothing is to be done, it never does. A session without messages or
    calls has no rows.
    """
    config = config or DEFAULTS
    parts = shares(messages)
    rows = observed(messages, calls, pins, config, parts).withColumn("state", F.lit(None).cast("string"))
    if states is not None:
        rows = rows.unionByName(states.select("session_id", "state"), allowMissingColumns=True)
    columns = [f.split(" ")[0] for f in STEPS.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits: dict[Any, dict] = {}
        session, state = None, None
        for pdf in batches:
            out = []
            for turn in turn_dicts(pdf):
                if state is None or turn["session_id"] != session:
                    session, state = turn["session_id"], initial_state()
                if turn["turn"] is None:
                    state = stored_state(turn["state"])
                    continue
                if turn["model"] not in limits:
                    limits[turn["model"]] = thresholds_for(config, turn["model"])
                state, plan = step(state, turn, config, limits[turn["model"]])
                out.append(planned(turn, plan))
            if out:
                yield pd.DataFrame(out, columns=columns)

    placed = rows.repartition(parts, "session_id").sortWithinPartitions("session_id", F.col("turn").asc_nulls_first())
    return placed.mapInPandas(fold, STEPS)


def pruned_at(messages: DataFrame, steps: DataFrame, pins: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """(session_id, turn, message_index, kind, replacement, new_tokens): what each step of ``steps`` (session_id, turn, message_index, pressure, prune, manual) that prunes puts in place of messages."""
    config = config or DEFAULTS
    found = bands(config)
    stub, chars = prune_band(config, F.col("pressure"))
    at = steps.where("prune").select("session_id", "turn", F.col("message_index").alias("call_at"), F.when(F.col("manual"), found[0][0]).otherwise(stub).alias("stub_min"), F.when(F.col("manual"), found[0][1]).otherwise(chars).alias("max_chars"))
    seen = pieces(messages, pins, config).join(at, "session_id").where("since < call_at and (until is null or until >= call_at)")
    return prune.actions(seen, F.col("stub_min"), F.col("max_chars")).where("kind <> 'keep'").select("session_id", "turn", "message_index", "kind", "replacement", "new_tokens")
