"""Sessions derived from plain event and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.schema import BLOCKS, as_messages

#: Events that go to one task.
SHARE_EVENTS = 50_000


def chat_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages: one session per conversation, in order of turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return as_messages(
        conversations.select(
            F.col("conv_id").cast("string").alias("session_id"),
            (F.row_number().over(order) - 1).alias("message_index"),
            "role",
            F.coalesce("text", F.lit("")).alias("content_text"),
        )
    )


def tool_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, user_id, event_type, value, props) with the tool call and result that each stands for, dealt by user into as many tasks as there are SHARE_EVENTS."""
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // SHARE_EVENTS))
    events = events.repartition(parts, "user_id")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    path = F.concat(F.lit("src/f"), (k % 7).cast("string"), F.lit(".py"))
    run = F.element_at(F.array(*map(F.lit, ("npm install", "git diff", "ls -la", "python main.py", "git status"))), (k % 5 + 1).cast("int"))
    kind = F.col("event_type")
    command = F.when(kind == "purchase", run).when(kind == "error", F.concat(F.lit("pytest tests/t"), (k % 3).cast("string")))
    arguments = (
        F.when((kind == "view") & (k % 2 == 0), F.format_string('{"path":"%s"}', path))
        .when(kind == "view", F.format_string('{"path":"%s","offset":%d,"limit":60}', path, k % 5 * 50))
        .when(kind == "click", F.format_string('{"pattern":"p%d","path":"src"}', k % 5))
        .when(kind == "signup", F.format_string('{"path":"%s"}', path))
        .otherwise(F.format_string('{"command":"%s"}', command))
    )
    first = F.when(kind == "error", F.when(k % 2 == 1, "3 failed, 7 passed").otherwise("10 passed")).otherwise("ok")
    body = F.repeat(F.concat(F.lit("output line "), k.cast("string"), F.lit("\n")), (F.floor("value") + 1).cast("int"))
    name = F.when(kind == "view", "read").when(kind == "click", "grep").when(kind == "signup", "edit").otherwise("bash")
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.row_number().over(order) - 1).alias("seq"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("tool_call_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        name.alias("name"),
        arguments.alias("arguments_json"),
        F.concat(first, F.lit("\n"), body).alias("text"),
        ((kind == "error") & (k % 2 == 1)).alias("is_error"),
    )


def tool_messages(events: DataFrame) -> DataFrame:
    """Sessions of one user message, then a call and its result per event of ``events``."""
    rows = tool_events(events)
    call = F.array(F.struct(F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("thinking"), F.col("tool_call_id").alias("id"), F.col("name"), F.col("arguments_json"))).cast(BLOCKS)
    result = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments_json"))).cast(BLOCKS)
    none = F.lit(None)
    each = F.array(
        F.struct((2 * F.col("seq") + 1).cast("int").alias("message_index"), F.lit("assistant").alias("role"), call.alias("blocks"), none.cast("string").alias("tool_call_id"), none.cast("string").alias("tool_name"), none.cast("boolean").alias("is_error")),
        F.struct((2 * F.col("seq") + 2).cast("int").alias("message_index"), F.lit("toolResult").alias("role"), result.alias("blocks"), F.col("tool_call_id"), F.col("name").alias("tool_name"), F.col("is_error")),
    )
    pairs = rows.select("session_id", "ts_ms", F.inline(each))
    start = events.select(F.col("user_id").cast("string").alias("session_id")).distinct().select("session_id", F.lit(0).alias("message_index"), F.lit("user").alias("role"), F.lit("work through the list").alias("content_text"))
    return as_messages(pairs).unionByName(as_messages(start))
