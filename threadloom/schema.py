"""Tables of the session engine: ordered messages of many sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks what the engine itself wrote into a session.
ENGINE_ID = "threadloom"

BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments_json:string>>"

#: A message's position, not its time, orders a session. ``content_text`` and ``blocks`` exclude each other.
MESSAGES = (
    "session_id string, message_index int, role string, ts_ms long, content_text string, "
    f"blocks {BLOCKS}, tool_call_id string, tool_name string, is_error boolean, details_json string, "
    "command string, output string, exit_code int, cancelled boolean, custom_type string, summary string"
)
PINS = "session_id string, id string, type string, content string, created_at long, source_message_id string, expires string, active boolean"
TURNS = (
    "session_id string, turn int, now_ms long, pressure double, quality double, total_tokens long, usable_tokens long, "
    "reclaimable_tokens long, message_count int, pressure_after_prune double, compact_event boolean, checkpoint_ok boolean, model string, "
    "prune_actions int, clean_at_ms long"
)


def as_turns(df: DataFrame) -> DataFrame:
    """``df`` with every column of TURNS in order; those it lacks are null, others go."""
    return _shaped(df, TURNS)


def as_messages(df: DataFrame) -> DataFrame:
    """``df`` with every column of MESSAGES in order; those it lacks are null, others go."""
    return _shaped(df, MESSAGES)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    have = set(df.columns)
    fields = _parse_datatype_string(schema).fields
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))
