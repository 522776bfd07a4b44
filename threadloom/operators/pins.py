"""Pins: what a session must keep in view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions import tokens as tk
from threadloom.operators.needles import first_seen
from threadloom.schema import ENGINE_ID, as_messages


def add_pins(pins: DataFrame, new: DataFrame) -> DataFrame:
    """``pins`` and those of ``new`` that no active pin of the session has (type and content; files in any case). Content is trimmed, blank content ignored."""
    new = new.withColumn("content", tx.trim(F.col("content"))).where("content <> ''")
    key = F.when(F.col("type") == "file", F.lower("content")).otherwise(F.col("content"))
    have = pins.where("active").select("session_id", "type", key.alias("k")).distinct()
    fresh = new.withColumn("k", key).join(have, ["session_id", "type", "k"], "left_anti").dropDuplicates(["session_id", "type", "k"]).drop("k")
    return pins.unionByName(fresh, allowMissingColumns=True)


def remove_pin(pins: DataFrame, session_id: str, pin_id: str) -> DataFrame:
    return pins.where(~((F.col("session_id") == session_id) & (F.col("id") == pin_id)))


def corpus_texts(messages: DataFrame) -> DataFrame:
    """(session_id, message_index, text): lower-case texts of users, assistants and earlier pin messages, without what pruning wrote."""
    engine, kind = F.get_json_object("details_json", "$.engine"), F.get_json_object("details_json", "$.kind")
    own = F.coalesce(engine == ENGINE_ID, F.lit(False))
    pin_message = own & F.coalesce(kind == "pins", F.lit(False))
    rows = messages.where((~own | pin_message) & (F.col("role").isin("user", "assistant") | ((F.col("role") == "custom") & pin_message)))
    return rows.select("session_id", "message_index", F.lower(tk.message_text()).alias("text")).where("text <> ''")


def corpus(messages: DataFrame) -> DataFrame:
    """(session_id, corpus): ``corpus_texts`` of a session as one, by line."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "text"))), lambda x: x["text"]), "\n")
    return corpus_texts(messages).groupBy("session_id").agg(joined.alias("corpus"))


def needle() -> Column:
    """What of a pin must be in its session's corpus; blank for pins that never are, if they are no files."""
    return F.when(F.col("type") == "file", tx.trim(F.lower("content"))).otherwise(F.lower(tx.trim(F.substring("content", 1, 100))))


def missing_pins(messages: DataFrame, pins: DataFrame) -> DataFrame:
    """Active pins that their session's corpus does not hold; a blank pin always is missing unless it is a file. All pins of a session are looked for at once."""
    rows = pins.where("active").withColumn("needle", needle())
    seen = first_seen(corpus_texts(messages), rows).select("session_id", "needle", F.lit(True).alias("seen"))
    rows = rows.join(seen, ["session_id", "needle"], "left").select(*(F.col(c) for c in [*pins.columns, "needle", "seen"]))
    return rows.where(F.col("seen").isNull() & ((F.col("needle") != "") | (F.col("type") != "file"))).drop("needle", "seen")


def with_pins(messages: DataFrame, pins: DataFrame, now_ms: int) -> DataFrame:
    """``messages`` with one more at the end of each session that misses pins, holding all of them. A second pass adds nothing."""
    lost = missing_pins(messages, pins)
    label = F.when(F.col("type") == "file", F.concat(F.lit("pinned file: "), F.col("content"))).otherwise(F.col("content"))
    line = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), label)
    each = lost.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line")))).alias("all"))
    last = messages.groupBy("session_id").agg((F.max("message_index") + 1).alias("message_index"))
    text = F.concat(F.lit(f"[{ENGINE_ID}] Pinned context (must be respected across prune/compact/handoff):\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    details = F.to_json(F.struct(F.lit(ENGINE_ID).alias("engine"), F.lit("pins").alias("kind"), F.transform("all", lambda x: x["id"]).alias("pinIds")))
    added = each.join(last, "session_id", "left").select("session_id", F.coalesce("message_index", F.lit(0)).alias("message_index"), F.lit("custom").alias("role"), F.lit(now_ms).alias("ts_ms"), text.alias("content_text"), details.alias("details_json"), F.lit(f"{ENGINE_ID}-pins").alias("custom_type"))
    return as_messages(messages).unionByName(as_messages(added))
