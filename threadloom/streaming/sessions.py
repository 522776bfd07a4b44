"""The policy as turns arrive, and append-only audit tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.plans.config import DEFAULTS
from threadloom.plans.policy import PLANS, state_text, step, stored_state, turn_dicts


def plan_stream(turns: DataFrame, config: dict | None = None) -> DataFrame:
    """A stream of TURNS -> PLANS: each session's state lives in the state store between micro-batches; within one, its turns are taken in order."""
    config = config or DEFAULTS

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = stored_state(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for turn in turn_dicts(rows):
            now, plan = step(now, turn, config)
            out.append({"session_id": key[0]} | plan)
        state.update((state_text(now),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PLANS.split(", ")])

    return turns.groupBy("session_id").applyInPandasWithState(each, PLANS, "state string", "append", GroupStateTimeout.NoTimeout)


def append_audit(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start appending a stream's rows as JSON lines; the sink's own checkpoint makes each row appear once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
